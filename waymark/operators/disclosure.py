"""Disclosure-risk indicators: how many identifiers share a coarse description."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import bitmaps
from waymark.functions.islands import UTC_DAY
from waymark.functions.timefn import local
from waymark.params import LOCAL_TIMEZONE

NIGHT = (0, 4)


def identifier_days(t20: DataFrame, residential: str, sensors: DataFrame = None, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """One row per identifier and local date, with the sensors of the day as a set of words. Days may be written as they come;
    ``profile_of_days`` merges them. ``sensors`` is a dictionary (``functions.bitmaps``) that all days share; by default that
    of the rows. ``residential`` is a pattern for sensors in residential surroundings; an empty one names none."""
    sensors = bitmaps.small_dictionary(t20.select("sensor_name")) if sensors is None else sensors
    words = bitmaps.words_of(sensors.count())
    here = local("timestamp", tz)
    night = F.hour(here).between(*NIGHT).cast("int")
    home = F.lower("sensor_name").rlike(residential) if residential else F.lit(False)
    at = F.unix_seconds(here)
    names = sensors.select(F.col("value").alias("sensor_name"), "number")
    return t20.join(names, "sensor_name", "left").groupBy("source_address", F.to_date(here).alias("local_date")).agg(
        F.count("*").alias("n"),
        F.min(F.struct(at.alias("first"), "sensor_name")).alias("opens"),
        F.max(F.struct(at.alias("last"), "sensor_name")).alias("closes"),
        F.max(night).alias("night"), F.max(home.cast("int")).alias("home"),
        F.max(F.when(home, night).otherwise(0)).alias("home_night"), *bitmaps.word_sets(F.col("number"), words, "sensors"))


def profile_of_days(days: DataFrame) -> DataFrame:
    """One row per identifier: size, reach, first and last observation, night and home flags. Days are rows here and sensors
    are sets, so nothing is counted as distinct."""
    words = sum(c.startswith("sensors_") for c in days.columns)
    return (
        days.groupBy("source_address")
        .agg(
            F.sum("n").alias("n_rows"), F.count("*").alias("n_days"),
            F.min("opens").alias("opens"), F.max("closes").alias("closes"), F.max("night").alias("has_night"),
            F.max("home").alias("has_residential"), F.max("home_night").alias("has_residential_night"),
            *bitmaps.word_unions(words, "sensors"),
        )
        .select(
            "source_address", "n_rows", bitmaps.word_count(words, "sensors").alias("n_sensors"), "n_days",
            (F.col("closes.last") - F.col("opens.first")).alias("span_seconds"),
            F.col("opens.sensor_name").alias("first_sensor"),
            F.col("closes.sensor_name").alias("last_sensor"),
            F.floor(F.col("opens.first") / 1800).alias("first_half_hour"),
            F.floor(F.col("closes.last") / 1800).alias("last_half_hour"),
            "has_night", "has_residential", "has_residential_night",
        )
    )


def identifier_profile(t20: DataFrame, residential: str, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    return profile_of_days(identifier_days(t20, residential, tz=tz))


def _log_band(n):
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("long")


def _group_sizes(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy("signature").agg(F.count("*").alias("group_size"))


def coarse_signature(profile: DataFrame) -> DataFrame:
    """Group sizes by endpoints with absolute half-hours, days, sensors, log2 row band, night."""
    return _group_sizes(profile.select(F.concat_ws(
        "|", "first_sensor", F.col("first_half_hour").cast("string"), "last_sensor",
        F.col("last_half_hour").cast("string"), F.col("n_days").cast("string"),
        F.col("n_sensors").cast("string"), _log_band(F.col("n_rows")).cast("string"),
        F.col("has_night").cast("string"),
    ).alias("signature")))


def _band(n):
    return F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").otherwise("8+")


def routine_signature(profile: DataFrame) -> DataFrame:
    """Group sizes without dates: half-hours of the day and coarse bands."""
    return _group_sizes(profile.select(F.concat_ws(
        "|", "first_sensor", (F.col("first_half_hour") % 48).cast("string"), "last_sensor",
        (F.col("last_half_hour") % 48).cast("string"), _band(F.col("n_days")),
        _band(F.col("n_sensors")), _log_band(F.col("n_rows")).cast("string"),
        F.col("has_night").cast("string"),
    ).alias("signature")))


def daily_sequence(t20: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """Sensors of each identifier-day in order of first sight (at most one entry a sensor). Of rows laid out by identifier and
    ``utc_day``, only the sensors of the pieces of a local date move, one row a piece."""
    laid = [UTC_DAY] if UTC_DAY in t20.columns else []
    first_seen = t20.groupBy("source_address", *laid, F.to_date(local("timestamp", tz)).alias("local_date"), "sensor_name").agg(
        F.min("timestamp").alias("first_seen")
    )
    pieces = first_seen.groupBy("source_address", *laid, "local_date").agg(
        F.collect_list(F.struct("first_seen", "sensor_name")).alias("seen"))
    whole = pieces.groupBy("source_address", "local_date").agg(F.array_sort(F.flatten(F.collect_list("seen"))).alias("seen"))
    names = F.array_distinct(F.transform("seen", lambda s: s["sensor_name"]))
    return whole.select(
        "source_address", "local_date", F.array_join(names, ">").alias("sensor_sequence"),
        F.size(names).cast("long").alias("sensors_visited"))


def daily_sequence_sizes(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("local_date", "sensor_sequence", "sensors_visited").agg(
        F.count("*").alias("group_size")
    )


def _size_summary(sizes: DataFrame, label: str) -> DataFrame:
    n = F.col("group_size")
    return sizes.agg(
        F.sum(F.when(n == 1, n).otherwise(0)).alias(f"{label}_unique"),
        F.sum(F.when(n < 5, n).otherwise(0)).alias(f"{label}_in_groups_under_5"),
        F.max(n).alias(f"{label}_largest_group"),
    )


def _long(one_row: DataFrame, site: str) -> DataFrame:
    """One row of counters turned to (site, metric, value)."""
    names = one_row.columns
    entries = F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ])).alias("e")
    return one_row.select(entries).select(F.lit(site).alias("site"), "e.*")


def disclosure_indicators(t20: DataFrame, site: str, residential: str, stage=lambda df, name: df) -> DataFrame:
    """Long table (site, metric, value) of profile, signature and daily-path indicators. ``stage`` may write the
    profile and the daily paths, which several indicators read (see ``sources.tables.stager``)."""
    p = stage(identifier_profile(t20, residential), "profile")
    overview = p.agg(
        F.count("*").alias("identifiers"),
        F.count_if(F.col("n_rows") == 1).alias("one_row_identifiers"),
        F.count_if(F.col("n_rows") < 5).alias("under_five_rows"),
        F.count_if(F.col("n_rows") < 10).alias("under_ten_rows"),
        F.count_if(F.col("n_sensors") == 1).alias("one_sensor_identifiers"),
        F.count_if(F.col("n_days") == 1).alias("one_day_identifiers"),
        F.count_if(F.col("n_days") >= 2).alias("multi_day_identifiers"),
        F.count_if(F.col("span_seconds") >= 604800).alias("span_at_least_7d"),
        F.sum("has_night").alias("identifiers_with_night_observation"),
        F.sum("has_residential").alias("identifiers_at_residential_sensor"),
        F.sum("has_residential_night").alias("identifiers_at_residential_sensor_night"),
    )
    sequences = stage(daily_sequence_sizes(daily_sequence(t20)), "daily-sequences")
    tables = [
        overview,
        _size_summary(coarse_signature(p), "coarse_signature"),
        _size_summary(routine_signature(p), "routine_signature"),
        sequences.agg(F.sum("group_size").alias("identifier_days")),
        _size_summary(sequences, "daily_sequence"),
    ]
    result = _long(tables[0], site)
    for table in tables[1:]:
        result = result.unionByName(_long(table, site))
    return result


def as_percent(indicators: DataFrame, denominator: str = "identifiers") -> DataFrame:
    base = indicators.filter(F.col("metric") == denominator).select(
        "site", F.col("value").alias("_base")
    )
    return indicators.join(base, "site").withColumn(
        "percent", F.when(F.col("_base") != 0, F.col("value") * 100.0 / F.col("_base"))
    ).drop("_base")
