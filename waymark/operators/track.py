"""Track: trajectories and origin-destination flows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.islands import session_spans, split_sessions
from waymark.functions.stats import top_with_ties
from waymark.functions.timefn import day_type, local
from waymark.params import LOCAL_TIMEZONE

ID = ["source_address"]


def split_trajectories(located: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Located rows with their trajectory number; a new one starts where the gap exceeds the limit."""
    return split_sessions(located, ID, gap_seconds, into="trajectory_id", order=("sensor_name",))


def trajectory_spans(located: DataFrame, gap_seconds: int) -> DataFrame:
    """Trajectory pieces per identifier and day, before they are merged across days."""
    at = F.struct("timestamp", "sensor_name")
    return session_spans(
        located, ID, gap_seconds,
        {"n_windows": F.count("*"), "opens": F.min(at), "closes": F.max(at),
         "sensors": F.collect_set("sensor_name")},
        order=("sensor_name",),
    ).withColumnRenamed("session_id", "trajectory_id")


def merge_spans(spans: DataFrame) -> DataFrame:
    return (
        spans.groupBy("source_address", "trajectory_id")
        .agg(
            F.min("start_epoch").alias("start_epoch"),
            F.max("end_epoch").alias("end_epoch"),
            F.sum("n_windows").alias("n_windows"),
            F.min("opens").alias("opens"),
            F.max("closes").alias("closes"),
            F.size(F.array_distinct(F.flatten(F.collect_list("sensors")))).alias("n_sensors"),
        )
        .select(
            "source_address", "trajectory_id", "start_epoch", "end_epoch",
            (F.col("end_epoch") - F.col("start_epoch")).alias("duration_seconds"),
            "n_windows", F.col("opens.sensor_name").alias("origin"),
            F.col("closes.sensor_name").alias("destination"), "n_sensors",
        )
        .withColumn(
            "is_od",
            ((F.col("n_windows") >= 2) & (F.col("origin") != F.col("destination"))).cast("int"),
        )
    )


def trajectory_summary(located: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Start, end, duration, windows, endpoints, distinct sensors and the OD flag."""
    return merge_spans(trajectory_spans(located, gap_seconds))


def od_trips(located: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    return trajectory_summary(located, gap_seconds).filter(F.col("is_od") == 1)


def od_matrix(trips: DataFrame) -> DataFrame:
    return trips.filter(F.col("is_od") == 1).groupBy("origin", "destination").agg(
        F.count("*").alias("n_trajectories"),
        F.countDistinct("source_address").alias("n_retained_identifiers"),
    )


def od_probability(trips: DataFrame) -> DataFrame:
    flows = trips.groupBy("origin", "destination").agg(F.count("*").alias("n_segments"))
    total = F.sum("n_segments").over(Window.partitionBy("origin"))
    return flows.withColumn("total_from", total).withColumn(
        "prob", F.col("n_segments") / F.col("total_from")
    )


def _start(tz):
    return local(F.timestamp_seconds("start_epoch"), tz)


def od_by_day_type(trips: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    return trips.groupBy("origin", "destination", day_type(_start(tz)).alias("day_type")).agg(
        F.count("*").alias("n_segments")
    )


def od_by_period(trips: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """Weekday mornings (7 to 10) and evenings (17 to 20), by trajectory start."""
    hour = F.hour(_start(tz))
    part = F.when(hour.between(7, 9), "Morning (7-10)").when(hour.between(17, 19), "Evening (17-20)")
    return (
        trips.filter(F.dayofweek(_start(tz)).between(2, 6))
        .withColumn("time_period", part)
        .filter(F.col("time_period").isNotNull())
        .groupBy("origin", "destination", "time_period").agg(F.count("*").alias("n_segments"))
    )


def od_top(flows: DataFrame, k: int = 7, within: list = ()) -> DataFrame:
    return top_with_ties(flows, "n_segments", k, within)


def od_by_band(located: DataFrame, bands: DataFrame, gap_seconds: int = 1800, k: int = 7) -> DataFrame:
    """Largest flows per observed-day band, with a route label."""
    flows = (
        od_trips(located, gap_seconds)
        .join(bands.select("source_address", "observed_day_band"), "source_address")
        .groupBy("observed_day_band", "origin", "destination")
        .agg(F.count("*").alias("n_segments"))
    )
    return od_top(flows, k, ["observed_day_band"]).withColumn(
        "route", F.concat_ws(" -> ", "origin", "destination")
    )
