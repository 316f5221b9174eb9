"""Activities: anchor clusters, detection episodes, stays and their summaries."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.islands import rows_of_sessions
from waymark.functions.stats import share, top_with_ties
from waymark.functions.timefn import epoch, local
from waymark.operators import folds
from waymark.operators.revisits import HIGH, ONE_DAY
from waymark.operators.track import trajectory_spans
from waymark.params import LOCAL_TIMEZONE, MAINTAINED, MetricParams

TRAJECTORY = folds.TRAJECTORY
EPISODE = [*TRAJECTORY, "cluster_id", "episode_id"]


def quality_filter(trajectories: DataFrame, p: MetricParams = MAINTAINED) -> DataFrame:
    """Trajectories with enough windows and sensors and an accepted duration."""
    return trajectories.filter(
        (F.col("n_windows") >= p.activity_min_windows)
        & (F.col("n_sensors") >= p.activity_min_sensors)
        & F.col("duration_seconds").between(p.activity_min_seconds, p.activity_max_seconds)
    )


def qualifying_rows(located: DataFrame, p: MetricParams = MAINTAINED) -> DataFrame:
    """Located rows of accepted trajectories, with the trajectory number.

    Totals per trajectory come from a window over its few day pieces; the rows themselves
    are read once more, to be picked by piece.
    """
    pieces = trajectory_spans(located, p.visit_gap_seconds)
    w = Window.partitionBy(*TRAJECTORY)
    totals = pieces.select(
        "source_address", "trajectory_id", "chunk", "piece",
        F.sum("n_windows").over(w).alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("sensors").over(w)))).alias("n_sensors"),
        (F.max("end_epoch").over(w) - F.min("start_epoch").over(w)).alias("duration_seconds"),
    )
    return rows_of_sessions(
        located, ["source_address"], p.visit_gap_seconds, quality_filter(totals, p),
        into="trajectory_id", order=("sensor_name",),
    )


def anchor_clusters(rows: DataFrame, metres: float = 75.0) -> DataFrame:
    """Rows with a cluster number: a row further than ``metres`` (strictly) from the cluster's
    first row opens the next cluster.

    The rows of a trajectory are folded in order, with the anchor as the only state, however many they are.
    """
    return folds.anchor_clusters(rows, metres)


def split_episodes(clustered: DataFrame, gap_seconds: int = 600) -> DataFrame:
    """Episode number within a cluster; a gap that reaches the limit starts the next one."""
    w = Window.partitionBy(*TRAJECTORY, "cluster_id").orderBy("timestamp", "sensor_name")
    gap = epoch("timestamp") - F.lag(epoch("timestamp")).over(w)
    return (
        clustered.withColumn("_gap", gap)
        .withColumn("episode_id", F.sum(F.when(
            F.col("_gap").isNull() | (F.col("_gap") >= gap_seconds), 1).otherwise(0)
        ).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .drop("_gap")
    )


def episode_summary(rows: DataFrame) -> DataFrame:
    """Start, end, windows, sensors, and the sensor seen most (lowest name on a tie)."""
    return (
        rows.groupBy(*EPISODE)
        .agg(
            F.min(epoch("timestamp")).alias("start_epoch"),
            F.max(epoch("timestamp")).alias("end_epoch"),
            F.count("*").alias("n_windows"),
            F.mode("sensor_name", deterministic=True).alias("primary_sensor"),
            F.size(F.collect_set("sensor_name")).alias("n_sensors"),
        )
        .withColumn("duration_seconds", F.col("end_epoch") - F.col("start_epoch"))
    )


def primary_sensor(rows: DataFrame, within: list) -> DataFrame:
    return rows.groupBy(*within).agg(
        F.mode("sensor_name", deterministic=True).alias("primary_sensor")
    )


def classify(episodes: DataFrame, min_seconds: int = 300) -> DataFrame:
    d = F.col("duration_seconds")
    return episodes.withColumn("is_stay", (d >= min_seconds).cast("int")).withColumn(
        "activity_type",
        F.when(d < min_seconds, "Pass-through").when(d < 900, "Short stay")
        .when(d < 3600, "Medium stay").otherwise("Long stay"),
    )


def episodes_of(rows: DataFrame, p: MetricParams = MAINTAINED) -> DataFrame:
    """Episodes of rows that already carry an accepted trajectory, in one pass over the sorted rows; the same as
    ``episode_summary(split_episodes(anchor_clusters(rows)))``."""
    found = folds.episodes(rows, p.activity_distance_metres, p.activity_continuity_gap_seconds)
    return classify(found, p.activity_min_duration_seconds)


def activities(located: DataFrame, p: MetricParams = MAINTAINED) -> DataFrame:
    return episodes_of(qualifying_rows(located, p), p)


def stay_summary(episodes: DataFrame) -> DataFrame:
    minutes = F.col("duration_seconds") / 60.0
    stay = F.col("is_stay") == 1
    return episodes.agg(
        F.count_if(F.col("episode_id") == 1).alias("total_spatial_clusters"),
        F.count("*").alias("total_episodes"),
        F.sum("is_stay").alias("n_stays"),
        (F.avg("is_stay") * 100).alias("pct_stays"),
        F.median(F.when(stay, minutes)).alias("median_duration"),
        F.avg(F.when(stay, minutes)).alias("mean_duration"),
    )


def type_distribution(episodes: DataFrame) -> DataFrame:
    return share(episodes.groupBy("activity_type").agg(F.count("*").alias("n")), "n", [])


def duration_bins(episodes: DataFrame) -> DataFrame:
    """Stays by left-closed duration class, in minutes."""
    m = F.col("duration_seconds") / 60.0
    label = (
        F.when(m < 10, "5-10").when(m < 15, "10-15").when(m < 30, "15-30")
        .when(m < 60, "30-60").when(m < 120, "60-120").otherwise("120+")
    )
    stays = episodes.filter(F.col("is_stay") == 1)
    return share(stays.groupBy(label.alias("duration_bin")).agg(F.count("*").alias("n")), "n", [])


def hourly_stays(episodes: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    hour = F.hour(local(F.timestamp_seconds("start_epoch"), tz))
    return episodes.groupBy(hour.alias("hour")).agg(
        F.count("*").alias("n_total"), F.sum("is_stay").alias("n_stays"),
        (F.avg("is_stay") * 100).alias("stay_rate"),
    )


def sensor_stays(episodes: DataFrame, sensors: DataFrame) -> DataFrame:
    minutes = F.when(F.col("is_stay") == 1, F.col("duration_seconds") / 60.0)
    return (
        episodes.groupBy("primary_sensor")
        .agg(F.count("*").alias("n_episodes"), F.sum("is_stay").alias("n_stays"),
             (F.avg("is_stay") * 100).alias("stay_rate"), F.avg(minutes).alias("avg_duration"))
        .join(sensors.select(F.col("sensor_name").alias("primary_sensor"), "x", "y"),
              "primary_sensor", "left")
    )


def top_stay_sensors(per_sensor: DataFrame, min_episodes: int = 100, k: int = 10) -> DataFrame:
    return top_with_ties(per_sensor.filter(F.col("n_episodes") >= min_episodes), "stay_rate", k)


def _with_extreme_bands(episodes: DataFrame, bands: DataFrame) -> DataFrame:
    wanted = bands.filter(F.col("observed_day_band").isin(ONE_DAY, HIGH))
    return episodes.join(wanted.select("source_address", "observed_day_band"), "source_address")


def stays_by_band(episodes: DataFrame, bands: DataFrame) -> DataFrame:
    minutes = F.when(F.col("is_stay") == 1, F.col("duration_seconds") / 60.0)
    return _with_extreme_bands(episodes, bands).groupBy("observed_day_band").agg(
        F.count("*").alias("n_episodes"), F.sum("is_stay").alias("n_stays"),
        (F.avg("is_stay") * 100).alias("stay_rate"),
        F.median(minutes).alias("median_duration"), F.avg(minutes).alias("mean_duration"),
    )


def types_by_band(episodes: DataFrame, bands: DataFrame) -> DataFrame:
    counts = _with_extreme_bands(episodes, bands).groupBy(
        "observed_day_band", "activity_type").agg(F.count("*").alias("n"))
    return share(counts, "n", ["observed_day_band"])


def trajectory_sensor_pairs(rows: DataFrame, episodes: DataFrame, sensors: DataFrame) -> DataFrame:
    """Trajectory-sensor pairs; Stay if any stay episode has that primary sensor."""
    pairs = rows.select(*TRAJECTORY, "sensor_name").distinct()
    stays = episodes.filter(F.col("is_stay") == 1).select(
        *TRAJECTORY, F.col("primary_sensor").alias("sensor_name"), F.lit(1).alias("_stay")
    ).distinct()
    return (
        pairs.join(stays, [*TRAJECTORY, "sensor_name"], "left")
        .withColumn("is_stay", F.coalesce("_stay", F.lit(0)))
        .drop("_stay")
        .join(sensors.select(F.col("id_sensor").alias("sensor_name"), "street_type"), "sensor_name")
        .withColumn("activity_type", F.when(F.col("is_stay") == 1, "Stay").otherwise("Pass-through"))
    )


def stay_ratio(pairs: DataFrame, by: list) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n_traj"), F.sum("is_stay").alias("n_stay"),
        F.sum(1 - F.col("is_stay")).alias("n_move"),
        (F.avg("is_stay") * 100).alias("stay_rate"),
        F.countDistinct("source_address").alias("n_identifiers"),
    )


def street_contrast(cross: DataFrame) -> DataFrame:
    """Stay rates of the two street types side by side per visit type, their gap in
    percentage points, and the pooled rate."""
    def rate(kind):
        return F.max(F.when(F.col("street_type") == kind, F.col("stay_rate")))

    return (
        cross.groupBy("visit_type")
        .agg(rate("Regular").alias("conventional"), rate("Pedestrian").alias("pedestrian"),
             (F.sum("n_stay") * 100.0 / F.sum("n_traj")).alias("mean_rate"))
        .withColumn("gap", F.col("pedestrian") - F.col("conventional"))
    )
