"""Time expressions. The session time zone is UTC; local time is asked for by name."""

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from waymark.params import LOCAL_TIMEZONE


def use_utc(spark: SparkSession) -> SparkSession:
    """Calendar functions read the session zone, so the tables' contract pins it to UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def epoch(ts) -> Column:
    return F.unix_seconds(ts)


def floor_epoch(ts, seconds: int) -> Column:
    """Tumbling window start (an instant) by epoch floor, valid for any width."""
    s = F.unix_seconds(ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)))


def local(ts, tz: str = LOCAL_TIMEZONE) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_date(ts, tz: str = LOCAL_TIMEZONE) -> Column:
    return F.to_date(local(ts, tz))


def local_hour(ts, tz: str = LOCAL_TIMEZONE) -> Column:
    return F.hour(local(ts, tz))


def day_type(day) -> Column:
    """Saturday and Sunday are Weekend (dayofweek counts from Sunday = 1)."""
    return F.when(F.dayofweek(day).isin(1, 7), "Weekend").otherwise("Weekday")


def utc_text(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ntz_as_utc(ts) -> Column:
    """A zone-less wall clock that means UTC: same epoch, whatever the session zone."""
    return F.timestamp_micros(
        F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)
    )


def wall_clock_to_utc(ts, tz: str = LOCAL_TIMEZONE) -> Column:
    """A local wall clock stored as if it were UTC, moved to the instant it stands for."""
    return F.to_utc_timestamp(ts, tz)
