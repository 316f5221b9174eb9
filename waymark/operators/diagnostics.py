"""How flagged (randomized) and unflagged identifiers move together."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.stats import average_rank, exact_quantiles, pearson
from waymark.operators.filters import drop_invalid_addresses, locally_administered

SITE = ["site"]


def flagged(raw: DataFrame) -> DataFrame:
    """Valid addresses with their locally-administered flag."""
    return drop_invalid_addresses(raw).withColumn(
        "is_random", locally_administered("source_address")
    )


def flagged_shares(rows: DataFrame) -> DataFrame:
    """Share of flagged values among detections and among distinct addresses, by site."""
    is_random = F.col("is_random")
    addresses = rows.groupBy("site", "source_address", "is_random").agg(F.count("*").alias("n"))
    shares = addresses.groupBy("site").agg(
        F.sum("n").alias("n_detections"),
        (F.sum(F.when(is_random, F.col("n")).otherwise(0)) * 100.0 / F.sum("n"))
        .alias("det_pct_laa_flagged"),
        F.count("*").alias("n_distinct_addresses"),
        F.count_if(is_random).alias("n_laa_flagged_addresses"),
        F.count_if(~is_random).alias("n_laa_unflagged_addresses"),
        (F.count_if(is_random) * 100.0 / F.count("*")).alias("address_pct_laa_flagged"),
    )
    sensors = rows.groupBy("site").agg(F.countDistinct("sensor_name").alias("n_sensors"))
    return shares.join(sensors, "site").withColumn(
        "address_to_detection_share_ratio",
        F.col("address_pct_laa_flagged") / F.col("det_pct_laa_flagged"),
    )


def hourly_streams(rows: DataFrame, *by: str) -> DataFrame:
    """Distinct flagged and unflagged addresses per site (and ``by``) and hour."""
    s = F.unix_seconds("timestamp")
    hours = rows.select(
        "site", *by, (s - F.pmod(s, F.lit(3600))).alias("hour_epoch"), "source_address", "is_random"
    ).distinct()
    return hours.groupBy("site", *by, "hour_epoch").agg(
        F.count_if("is_random").alias("n_random"), F.count_if(~F.col("is_random")).alias("n_nonrandom")
    )


def stream_correlation(hourly: DataFrame) -> DataFrame:
    """Pearson and Spearman correlation of the two hourly streams."""
    linear = hourly.groupBy("site").agg(
        pearson("n_random", "n_nonrandom").alias("pearson_r"), F.count("*").alias("n_hours")
    )
    ranked = average_rank(hourly, "n_random", SITE, "rank_random")
    ranked = average_rank(ranked, "n_nonrandom", SITE, "rank_nonrandom")
    spearman = ranked.groupBy("site").agg(
        pearson("rank_random", "rank_nonrandom").alias("spearman_rho")
    )
    return linear.join(spearman, "site")


def sensor_correlation(hourly: DataFrame, min_hours: int = 10) -> DataFrame:
    """Pearson correlation by sensor; NULL with too few hours that have unflagged addresses."""
    supported = F.count_if(F.col("n_nonrandom") > 0) >= min_hours
    return hourly.groupBy("site", "sensor_name").agg(
        F.when(supported, pearson("n_random", "n_nonrandom")).alias("pearson_r"),
        F.count("*").alias("n_hours"),
    )


def sensor_diagnostics(hourly: DataFrame) -> DataFrame:
    """Level and spread of the hourly counts by sensor (hourly counts, so few distinct values)."""
    def columns(value, name):
        return [
            F.avg(value).alias(f"mean_{name}"),
            F.median(value).alias(f"median_{name}"),
            (F.count_if(F.col(value) <= 2) * 100.0 / F.count("*")).alias(f"pct_zero_{name}"),
            (F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0))).alias(f"cv_{name}"),
        ]

    return hourly.groupBy("site", "sensor_name").agg(
        *columns("n_random", "rand"), *columns("n_nonrandom", "nonrand")
    )


def sensor_detail(rows: DataFrame, hourly: DataFrame) -> DataFrame:
    """Correlation, detections and level of every sensor in one table."""
    key = ["site", "sensor_name"]
    detections = rows.groupBy(*key).agg(F.count("*").alias("n_detections"))
    return (
        sensor_correlation(hourly).join(detections, key, "left")
        .join(sensor_diagnostics(hourly), key, "left")
    )


def site_correlation_summary(per_sensor: DataFrame) -> DataFrame:
    """Distribution over sensors of the sensor correlations, by site."""
    r = per_sensor.filter(F.col("pearson_r").isNotNull())
    quantiles = exact_quantiles(
        r, SITE, "pearson_r", {"r_median": 0.5, "r_q25": 0.25, "r_q75": 0.75}, 0.05
    ).drop("n", "mean")
    counts = r.groupBy("site").agg(
        F.count("*").alias("n_sensors"),
        F.count_if(F.col("pearson_r") > 0.9).alias("n_above_09"),
        (F.count_if(F.col("pearson_r") > 0.9) * 100.0 / F.count("*")).alias("pct_above_09"),
    )
    return counts.join(quantiles, "site")


def fit_line(hourly: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Least-squares line of unflagged on flagged counts and its value at a quantile."""
    return hourly.groupBy("site").agg(
        F.regr_slope("n_nonrandom", "n_random").alias("slope"),
        F.regr_intercept("n_nonrandom", "n_random").alias("intercept"),
        F.percentile("n_random", F.lit(quantile)).alias("x_at"),
    ).withColumn("y_at", F.col("slope") * F.col("x_at") + F.col("intercept"))
