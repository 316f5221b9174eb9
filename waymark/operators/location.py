"""Location: strongest sensor, centroids, and their error against ground truth."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.stats import euclid, exact_quantiles
from waymark.functions.timefn import epoch
from waymark.functions.islands import DAY, UTC_DAY
from waymark.operators import filters
from waymark.operators.joins import nearest_asof

# Window widths of the error sweep, in seconds.
SWEEP_WIDTHS = (1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120)
METHODS = ("Proximity", "Centroid", "Wcentroid")


def restore_strength(public: DataFrame) -> DataFrame:
    """The public table omits the score that follows from two of its columns."""
    return public.withColumn("strength_sum", F.col("detections") * 100.0 + F.col("rssi_sum"))


def strongest_sensor(t20: DataFrame) -> DataFrame:
    """One row per identifier and window; ties go to the lowest sensor name.

    A ``min`` of an ordered struct combines on the map side, unlike a ranking window.
    """
    best = F.min(F.struct(
        (-F.col("strength_sum")).alias("weakness"), F.col("sensor_name"), F.col("detections"),
    )).alias("best")
    day = [UTC_DAY] if UTC_DAY in t20.columns else []
    return t20.groupBy("source_address", "timestamp", *day).agg(best).select(
        "timestamp", "source_address", F.col("best.sensor_name").alias("sensor_name"),
        (-F.col("best.weakness")).alias("strength_sum"),
        F.col("best.detections").alias("detections"), *day,
    )


def locate_proximity(t20: DataFrame, sensors: DataFrame) -> DataFrame:
    """Strongest sensor with its coordinates. The sensor table is joined as Spark sizes it;
    ``quality.unknown_sensors`` reports rows the inner join would drop."""
    day = [UTC_DAY] if UTC_DAY in t20.columns else []
    return strongest_sensor(t20).join(sensors.select("sensor_name", "x", "y"), "sensor_name").select(
        "timestamp", "source_address", "sensor_name", "x", "y", "strength_sum", "detections", *day
    )


def tied_windows(t20: DataFrame) -> DataFrame:
    """Identifier-windows whose best score is shared by several sensors."""
    day = [UTC_DAY] if UTC_DAY in t20.columns else []
    per_score = t20.groupBy("source_address", "timestamp", *day, "strength_sum").agg(
        F.count("*").alias("n")
    )
    return (
        per_score.groupBy("source_address", "timestamp", *day)
        .agg(F.max(F.struct("strength_sum", "n")).alias("top"))
        .filter(F.col("top.n") > 1)
        .select("source_address", "timestamp", F.col("top.strength_sum").alias("strength_sum"),
                F.col("top.n").alias("n_tied"))
    )


def window_strength(raw: DataFrame, widths=SWEEP_WIDTHS) -> DataFrame:
    """Sum of 100 + RSSI per identifier, sensor and window, for all widths in one job.

    Seconds are summed first; each width then adds up seconds, not raw rows. Rows laid out by identifier and ``utc_day`` stay
    where they are if no window crosses midnight, that is, if all widths divide the day.
    """
    laid = [UTC_DAY] if UTC_DAY in raw.columns else []
    day = laid if all(DAY % w == 0 for w in widths) else []
    seconds = (
        filters.drop_rssi_sentinels(raw)
        .withColumn("second", epoch("timestamp"))
        .groupBy("source_address", "sensor_name", "second", *laid)
        .agg(F.sum(F.lit(100) + F.col("rssi")).alias("s"))
    )
    window = ["source_address", "width", "window_start"]
    sums = (
        seconds.withColumn("width", F.explode(F.array(*[F.lit(int(w)) for w in widths])))
        .withColumn("window_start", F.col("second") - F.pmod(F.col("second"), F.col("width")))
        .groupBy(*window, *laid, "sensor_name").agg(F.sum("s").alias("strength_sum"))
    )
    if laid and not day:
        # What the days add to a window is summed where it lies and moves once, by window, so estimates of windows follow in place.
        sums = sums.repartition(*window).groupBy(*window, "sensor_name").agg(F.sum("strength_sum").alias("strength_sum"))
    return sums.withColumn("midpoint", F.col("window_start") + F.col("width") / 2.0)


def estimates(strengths: DataFrame, sensors: DataFrame) -> DataFrame:
    """Proximity, centroid and weighted centroid of every identifier-window, as columns."""
    placed = strengths.join(sensors.select("sensor_name", "x", "y"), "sensor_name")
    s, day = F.col("strength_sum"), [UTC_DAY] if UTC_DAY in strengths.columns else []
    return (
        placed.groupBy("source_address", *day, "width", "window_start", "midpoint")
        .agg(
            F.min(F.struct((-s).alias("weakness"), "sensor_name", "x", "y")).alias("best"),
            F.avg("x").alias("cx"), F.avg("y").alias("cy"),
            (F.sum(F.col("x") * s) / F.sum(s)).alias("wx"),
            (F.sum(F.col("y") * s) / F.sum(s)).alias("wy"),
        )
        .select("source_address", "width", "window_start", "midpoint",
                F.col("best.x").alias("px"), F.col("best.y").alias("py"), "cx", "cy", "wx", "wy")
    )


def by_method(est: DataFrame, *others: str) -> DataFrame:
    """Estimate columns turned to rows (method, x_est, y_est)."""
    def one(name, x, y):
        return F.struct(F.lit(name).alias("method"), F.col(x).alias("x_est"), F.col(y).alias("y_est"))

    stacked = F.explode(F.array(one("Proximity", "px", "py"), one("Centroid", "cx", "cy"),
                                one("Wcentroid", "wx", "wy"))).alias("m")
    return est.select("source_address", "width", "window_start", "midpoint", *others, stacked).select(
        "source_address", "width", "window_start", "midpoint", *others, "m.*"
    )


def location_error(est: DataFrame, gps: DataFrame, max_width: int = max(SWEEP_WIDTHS)) -> DataFrame:
    """Distance of each estimate to the nearest fix within half a window width.

    One as-of pass serves all widths and methods.
    """
    fixes = gps.select("source_address", epoch("timestamp").alias("fix_epoch"),
                       F.col("x").alias("x_gps"), F.col("y").alias("y_gps"))
    matched = nearest_asof(
        est, fixes, "source_address", "midpoint", "fix_epoch", ["x_gps", "y_gps"], max_width / 2.0
    ).filter(F.abs(F.col("matched_time") - F.col("midpoint")) <= F.col("width") / 2.0)
    error = euclid(F.col("x_est"), F.col("y_est"), F.col("x_gps"), F.col("y_gps"))
    return by_method(matched, "matched_time", "x_gps", "y_gps").withColumn("error", error)


def error_summary(errors: DataFrame, bucket_metres: float = 1.0) -> DataFrame:
    """Median, quartiles, mean and n by method and width; exact for any number of rows."""
    probs = {"median_error": 0.5, "q25": 0.25, "q75": 0.75}
    return exact_quantiles(errors, ["method", "width"], "error", probs, bucket_metres) \
        .withColumnRenamed("mean", "mean_error")


def ground_truth_rows(raw: DataFrame, gps: DataFrame) -> DataFrame:
    """Detections of identifiers that carried a GPS logger."""
    return raw.join(gps.select("source_address").distinct(), "source_address", "left_semi")


def best_covered_identifier(rows: DataFrame) -> DataFrame:
    """The identifier with most rows (lowest name on a tie)."""
    return (
        rows.groupBy("source_address").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "source_address").limit(1)
    )
