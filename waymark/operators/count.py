"""Count: distinct identifiers by place and time, patterns, sensor availability."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.timefn import day_type, local
from waymark.operators.filters import calendar
from waymark.operators.joins import fill_sensor_days
from waymark.params import LOCAL_TIMEZONE

MIDDAY = (11, 12, 13, 14)


def count_sensor_window(located: DataFrame) -> DataFrame:
    """Identifiers per window and sensor. Location leaves one row per identifier and window,
    so a plain count is the distinct count."""
    return located.groupBy("timestamp", "sensor_name").agg(
        F.count("*").alias("n_retained_identifiers")
    )


def hourly_counts(rows: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    return calendar(rows, tz).groupBy("hour_start", "day_type").agg(
        F.countDistinct("source_address").alias("n_devices")
    )


def hourly_pattern(rows: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """Mean and sample standard deviation over days, by hour of day and day type."""
    return (
        hourly_counts(rows, tz)
        .groupBy(F.hour("hour_start").alias("hour_of_day"), "day_type")
        .agg(F.avg("n_devices").alias("mean_devices"), F.stddev_samp("n_devices").alias("sd_devices"))
    )


def daily_hourly_counts(rows: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    return calendar(rows, tz).groupBy("local_date", F.col("local_hour").alias("hour_of_day")).agg(
        F.countDistinct("source_address").alias("n_devices")
    )


def sensor_counts(
    rows: DataFrame, sensors: DataFrame, hours=MIDDAY, tz: str = LOCAL_TIMEZONE
) -> DataFrame:
    """Identifiers per sensor and day type within some local hours, with coordinates."""
    return (
        calendar(rows, tz).filter(F.col("local_hour").isin(list(hours)))
        .groupBy("sensor_name", "day_type")
        .agg(F.countDistinct("source_address").alias("n_devices"))
        .join(sensors.select("sensor_name", "x", "y"), "sensor_name")
    )


def peak_hour(pattern: DataFrame) -> DataFrame:
    """Hour with the highest mean per day type; the earliest on a tie."""
    top = F.max(F.struct("mean_devices", (-F.col("hour_of_day")).alias("neg"))).alias("top")
    return pattern.groupBy("day_type").agg(top).select(
        "day_type", (-F.col("top.neg")).alias("peak_hour"),
        F.col("top.mean_devices").alias("peak_devices"),
    )


def weekend_weekday_ratio(rows: DataFrame, hours=MIDDAY, tz: str = "UTC") -> DataFrame:
    """Ratio of mean daily identifiers, and identifiers over the whole period.

    The default zone is UTC: this figure's rule takes dates and hours without conversion.
    """
    midday = calendar(rows, tz).filter(F.col("local_hour").isin(list(hours)))
    daily = midday.groupBy("sensor_name", "day_type", "local_date").agg(
        F.countDistinct("source_address").alias("n_daily")
    )
    wide = (
        daily.groupBy("sensor_name").pivot("day_type", ["Weekday", "Weekend"])
        .agg(F.avg("n_daily"))
        .withColumnsRenamed({"Weekday": "weekday", "Weekend": "weekend"})
        .withColumn("ratio", F.col("weekend") / F.col("weekday"))
    )
    total = midday.groupBy("sensor_name").agg(F.countDistinct("source_address").alias("total"))
    return total.join(wide, "sensor_name", "left")


def trips_per_day(od_trips: DataFrame, located: DataFrame, tz: str = "UTC") -> DataFrame:
    """Trips by day type, divided by the number of observed days of that type."""
    days = (
        located.select(F.to_date(local("timestamp", tz)).alias("d")).distinct()
        .groupBy(day_type(F.col("d")).alias("day_type")).agg(F.count("*").alias("n_days"))
    )
    trips = od_trips.groupBy(
        day_type(local(F.timestamp_seconds("start_epoch"), tz)).alias("day_type")
    ).agg(F.count("*").alias("n_trips"))
    return trips.join(days, "day_type", "left").withColumn(
        "trips_per_day", F.col("n_trips") / F.col("n_days")
    )


def sensor_daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sensor_name", F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("detections")
    )


def sensor_four_hourly(rows: DataFrame) -> DataFrame:
    s = F.unix_seconds("timestamp")
    return rows.groupBy("sensor_name", (s - F.pmod(s, F.lit(14400))).alias("bin_epoch")).agg(
        F.count("*").alias("detections")
    )


def sensor_summary(daily: DataFrame) -> DataFrame:
    return daily.groupBy("sensor_name").agg(
        F.count("*").alias("days_active"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("detections").alias("total_detections"),
        F.avg("detections").alias("avg_daily"),
    )


def sensor_uptime(located: DataFrame, sensors: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """30-minute slots with data per sensor and local date, against the best sensor-day."""
    here = local("timestamp", tz)
    slots = (
        located.select("sensor_name", F.to_date(here).alias("local_date"),
                       F.floor(F.unix_seconds("timestamp") / 1800).alias("slot"))
        .distinct()
        .groupBy("sensor_name", "local_date").agg(F.count("*").alias("n_slots"))
    )
    grid = fill_sensor_days(slots, sensors, slots, "n_slots")
    best = slots.agg(F.max("n_slots")).scalar()
    return grid.withColumn("coverage", F.bround(F.col("n_slots") / best, 2)).withColumn(
        "healthy", (F.col("coverage") >= 0.5).cast("int")
    )


def valid_days(uptime: DataFrame) -> DataFrame:
    return uptime.groupBy("local_date").agg(
        F.count("*").alias("n_sensors"),
        F.sum("healthy").alias("n_healthy"),
        F.bround(F.sum("healthy") * 100.0 / F.count("*"), 1).alias("pct_healthy"),
    )


def valid_dates(uptime: DataFrame, min_percent: float = 80.0) -> DataFrame:
    return valid_days(uptime).filter(F.col("pct_healthy") >= min_percent).select("local_date")
