"""Revisits: on how many local days an identifier is observed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.islands import session_spans
from waymark.functions.stats import share, top_with_ties
from waymark.functions.timefn import local, local_date, local_hour
from waymark.operators.track import ID
from waymark.params import LOCAL_TIMEZONE

ONE_DAY, MIDDLE, HIGH = "1 day", "2–4 days", "5–7 days"


def revisits(
    located: DataFrame, gap_seconds: int = 7200, min_windows: int = 2, tz: str = LOCAL_TIMEZONE
) -> DataFrame:
    """Local dates on which any row of a qualifying trajectory lies.

    Trajectory pieces lie within a UTC day, so each carries the two or three local dates of its
    rows, daylight saving included, and the rows themselves are not needed again.
    """
    pieces = session_spans(
        located, ID, gap_seconds,
        {"n_windows": F.count("*"), "days": F.collect_set(local_date("timestamp", tz))}, order=("sensor_name",),
    )
    qualifying = (
        pieces.groupBy("source_address", "session_id")
        .agg(F.sum("n_windows").alias("n"), F.array_distinct(F.flatten(F.collect_list("days"))).alias("days"))
        .filter(F.col("n") >= min_windows)
    )
    dates = F.transform(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("days")))),
        lambda d: F.date_format(d, "yyyy-MM-dd"),
    )
    return (
        qualifying.groupBy("source_address")
        .agg(F.count("*").alias("n_qualifying_trajectories"), dates.alias("dates"))
        .select(
            "source_address", "n_qualifying_trajectories",
            F.size("dates").alias("n_observed_local_dates"),
            F.array_join("dates", ";").alias("observed_local_dates"),
            F.element_at("dates", 1).alias("first_local_date"),
            F.element_at("dates", -1).alias("last_local_date"),
            F.when(F.size("dates") == 1, "Single-day observed")
            .otherwise("Multi-day observed").alias("revisit_class"),
        )
    )


def observed_day_bands(rows: DataFrame, high: int = 5, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """Days with any row, no trajectory filter."""
    days = rows.groupBy("source_address").agg(
        F.countDistinct(local_date("timestamp", tz)).alias("n_days")
    )
    return days.withColumn(
        "observed_day_band",
        F.when(F.col("n_days") == 1, ONE_DAY).when(F.col("n_days") >= high, HIGH).otherwise(MIDDLE),
    )


def day_distribution(bands: DataFrame) -> DataFrame:
    return bands.groupBy("n_days", "observed_day_band").agg(F.count("*").alias("n"))


def band_summary(distribution: DataFrame) -> DataFrame:
    """Size and share of each band, and the range and median of its distinct day counts."""
    per_band = distribution.groupBy("observed_day_band").agg(
        F.sum("n").alias("total"), F.min("n_days").alias("x_min"), F.max("n_days").alias("x_max"),
        F.median("n_days").alias("x_mid"), F.max("n").alias("y_top"),
    )
    return share(per_band, "total", [])


def _extreme_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    wanted = bands.filter(F.col("observed_day_band").isin(ONE_DAY, HIGH))
    return rows.join(wanted.select("source_address", "observed_day_band"), "source_address")


def band_hourly_profile(rows: DataFrame, bands: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """Within-band share of identifier-hours, for the two extreme bands."""
    hours = rows.select("source_address", local_hour("timestamp", tz).alias("hour")).distinct()
    counts = _extreme_bands(hours, bands).groupBy("observed_day_band", "hour").agg(
        F.count("*").alias("n")
    )
    return share(counts, "n", ["observed_day_band"])


def band_sensor_difference(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Percentage-point difference of the two extreme bands' row shares by sensor."""
    counts = rows.groupBy("source_address", "sensor_name").agg(F.count("*").alias("n"))
    per_band = _extreme_bands(counts, bands).groupBy("observed_day_band", "sensor_name").agg(
        F.sum("n").alias("n")
    )
    wide = (
        share(per_band, "n", ["observed_day_band"])
        .groupBy("sensor_name").pivot("observed_day_band", [ONE_DAY, HIGH]).agg(F.first("pct"))
        .fillna(0.0)
        .withColumnsRenamed({ONE_DAY: "pct_one_day", HIGH: "pct_five_to_seven_days"})
    )
    diff = F.col("pct_one_day") - F.col("pct_five_to_seven_days")
    return wide.withColumn("diff", diff).withColumn("abs_diff", F.abs("diff")).withColumn(
        "dominant", F.when(F.col("diff") > 0, ONE_DAY).otherwise(HIGH)
    )


def top_differences(differences: DataFrame, k: int = 10) -> DataFrame:
    return top_with_ties(differences, "abs_diff", k)


def identifier_day_stats(rows: DataFrame, bands: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    per_day = rows.groupBy("source_address", local_date("timestamp", tz).alias("local_date")).agg(
        F.count("*").alias("n_detections"),
        F.countDistinct("sensor_name").alias("n_sensors"),
        ((F.unix_seconds(F.max("timestamp")) - F.unix_seconds(F.min("timestamp"))) / 60.0)
        .alias("duration_mins"),
    )
    return _extreme_bands(per_day, bands)


def identifier_day_summary(stats: DataFrame) -> DataFrame:
    """Medians are exact: counts, sensors and durations in 20 s steps have few distinct values."""
    return stats.groupBy("observed_day_band").agg(
        F.count("*").alias("n_identifier_days"),
        F.median("n_detections").alias("median_detections"),
        F.avg("n_detections").alias("mean_detections"),
        F.median("n_sensors").alias("median_sensors"),
        F.avg("n_sensors").alias("mean_sensors"),
        F.median("duration_mins").alias("median_duration"),
        F.avg("duration_mins").alias("mean_duration"),
    )


def visit_days(qualifying: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """Distinct start dates of qualifying trajectories, and the Single-/Multi-day type."""
    start = local(F.timestamp_seconds("start_epoch"), tz)
    return (
        qualifying.groupBy("source_address")
        .agg(F.countDistinct(F.to_date(start)).alias("n_days"))
        .withColumn("visit_type", F.when(F.col("n_days") == 1, "Single-day").otherwise("Multi-day"))
    )


def visit_type_summary(visits: DataFrame) -> DataFrame:
    counts = visits.groupBy("visit_type").agg(
        F.count("*").alias("n_identifiers"), F.median("n_days").alias("median_days"),
        F.avg("n_days").alias("mean_days"),
    )
    return share(counts, "n_identifiers", [])


def visit_day_distribution(visits: DataFrame) -> DataFrame:
    counts = visits.groupBy("n_days", "visit_type").agg(F.count("*").alias("n_identifiers"))
    return share(counts, "n_identifiers", [])


