"""Packets to one second to 20 seconds, and source audits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.identifiers import canonical_address
from waymark.functions.islands import UTC_DAY
from waymark.functions.stats import median_of_few
from waymark.functions.timefn import floor_epoch
from waymark.operators import filters
from waymark.params import MAINTAINED_CLEANING, WINDOW_SECONDS, CleaningParams

KEY = ["timestamp", "source_address", "sensor_name"]


def key_of(rows: DataFrame) -> list:
    """The key of the rows; of rows laid out by identifier and ``utc_day``, with the day, so that they are not exchanged. The
    day follows from the time, and no second or 20 s window crosses it. The order is that of the stored stages."""
    return ["source_address", UTC_DAY, "timestamp", "sensor_name"] if UTC_DAY in rows.columns else KEY


def _by_key(rows: DataFrame):
    """The rows grouped by their key. Rows laid out by identifier and ``utc_day`` are sorted by it first: where the session lets sorted
    rows be aggregated as they come (``tables.SORTED``), their lists are then neither hashed nor written between two aggregations."""
    key = key_of(rows)
    return (rows.sortWithinPartitions(*key) if UTC_DAY in rows.columns else rows).groupBy(*key)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, *[c for c in rows.columns if c not in KEY])


def one_second(packets: DataFrame, rules: CleaningParams = MAINTAINED_CLEANING) -> DataFrame:
    """Median RSSI and packet count per identifier, sensor and (truncated) second."""
    kept = filters.exclude_subtypes(
        filters.rssi_between(packets, rules.rssi_min, rules.rssi_max), rules.exclude_subtypes
    )
    return _in_order(
        _by_key(kept.withColumn("timestamp", F.date_trunc("second", "timestamp")))
        .agg(
            F.min("source_address_randomized").alias("source_address_randomized"),
            median_of_few("strength").alias("rssi_median"),
            F.count("*").alias("packet_count"),
        )
    )


def deduplicate_one_second(rows: DataFrame) -> DataFrame:
    """One row per key: median of the medians, sum of the counts.

    Keys with conflicting flags are an input error; ``quality.flag_conflicts`` reports them.
    """
    return _in_order(_by_key(rows).agg(
        F.min("source_address_randomized").alias("source_address_randomized"),
        median_of_few("rssi_median").alias("rssi_median"),
        F.sum("packet_count").alias("packet_count"),
    ))


def twenty_second(cleaned: DataFrame) -> DataFrame:
    """Tumbling 20 s windows. ``rssi_sum`` adds the one-second medians, ``detections`` counts
    distinct seconds, never packets."""
    return _in_order(
        _by_key(cleaned.withColumn("timestamp", floor_epoch("timestamp", WINDOW_SECONDS)))
        .agg(
            median_of_few("rssi_median").alias("rssi_median"),
            F.sum("rssi_median").alias("rssi_sum"),
            F.count("*").alias("detections"),
        )
        .withColumn("strength_sum", F.col("detections") * 100.0 + F.col("rssi_sum"))
    )


def _one_form(raw: DataFrame) -> DataFrame:
    """Addresses in one form; those of rows laid out by address and ``utc_day`` were given it before."""
    return raw if UTC_DAY in raw.columns else raw.withColumn("source_address", canonical_address("source_address"))


def twenty_second_from_raw(raw: DataFrame, sensor_codes: DataFrame) -> DataFrame:
    """Restricted one-second source: map sensor codes, drop sentinels, deduplicate seconds,
    aggregate, keep windows with 1 to 20 seconds."""
    mapped = _one_form(map_sensor_codes(filters.drop_rssi_sentinels(raw), sensor_codes))
    seconds = _by_key(mapped).agg(median_of_few("rssi").alias("rssi_median"))
    return twenty_second(seconds).filter(F.col("detections").between(1, WINDOW_SECONDS))


def map_sensor_codes(rows: DataFrame, sensor_codes: DataFrame) -> DataFrame:
    """Captured sensor code to published sensor name; unmapped sensors are dropped."""
    codes = sensor_codes.select(
        F.col("id_last").alias("sensor_code"), F.col("id_sensor").alias("sensor_name")
    )
    return rows.drop("sensor_name").join(codes, "sensor_code").drop("sensor_code")


def source_audit(raw: DataFrame, sensor_codes: DataFrame) -> DataFrame:
    """One row of counters about a restricted one-second source, from a single aggregation
    of its rows per key and value."""
    mapped = _one_form(map_sensor_codes(raw, sensor_codes)).withColumn("rssi", F.col("rssi").cast("double"))
    accepted = (F.col("rssi") > -100) & (F.col("rssi") < 0)
    rounded = F.rint("rssi")
    per_key = (
        mapped.groupBy(*key_of(mapped))
        .agg(
            F.count("*").alias("mapped"),
            F.count_if(accepted).alias("n"),
            F.count_if((rounded > -100) & (rounded < 0)).alias("old"),
            F.count_if(accepted & (F.col("rssi") != rounded)).alias("fractional"),
        )
    )
    return per_key.agg(
        F.sum("mapped").alias("mapped_rows"),
        F.sum("n").alias("accepted_numeric_filter_rows"),
        F.sum("old").alias("accepted_old_rounded_filter_rows"),
        (F.sum("n") - F.sum("old")).alias("filter_row_difference"),
        F.count_if(F.col("n") > 0).alias("unique_one_second_keys"),
        F.count_if(F.col("n") > 1).alias("duplicated_one_second_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0))
        .alias("duplicate_excess_rows"),
        F.coalesce(F.max("n"), F.lit(0)).alias("maximum_rows_per_one_second_key"),
        F.sum("fractional").alias("fractional_rssi_rows"),
    )
