"""Queries that do their whole job: every row of their tables counts."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import count, diagnostics, filters
from waymark.plans import catalog
from waymark.plans.context import Context

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def c(spark):
    return Context(spark, SF)


def _query(spark, name):
    return catalog.queries()[name](spark, SF)


def _counts(rows):
    return {r[0]: r[1] for r in rows.groupBy("source_address").agg(F.count("*")).collect()}


def test_correlation_of_constant_streams(spark):
    """A constant stream has no correlation: NULL with too few hours, NaN otherwise, and no division by zero."""
    rows = [("a", "s01", h, 2, 3) for h in range(4)] + [("a", "s02", h, 2, h) for h in range(1, 13)]
    rows += [("b", "s03", h, h, 2 * h + 1) for h in range(1, 13)]
    hourly = spark.createDataFrame(rows, "site string, sensor_name string, hour_epoch long, n_random long, n_nonrandom long")
    got = {r["sensor_name"]: r["pearson_r"] for r in diagnostics.sensor_correlation(hourly).collect()}
    assert got["s01"] is None and got["s02"] != got["s02"] and got["s03"] == pytest.approx(1)
    flat = diagnostics.stream_correlation(hourly.filter("sensor_name = 's01'")).collect()[0]
    assert flat["pearson_r"] != flat["pearson_r"] and flat["spearman_rho"] != flat["spearman_rho"]


def test_night_persistence_on_every_night(spark, c):
    fixed = {r["source_address"] for r in filters.night_persistent(c.located).collect()}
    want = {i: n for i, n in _counts(c.located).items() if i not in fixed}
    assert {r["source_address"]: r["n"] for r in _query(spark, "filter_f10_night_persistence").collect()} == want


def test_valid_days_of_all_sensors(spark, c):
    days = [str(r[0]) for r in count.valid_dates(count.sensor_uptime(c.located, c.sensors)).collect()]
    day = F.to_date(F.from_utc_timestamp("timestamp", "Asia/Seoul")).cast("string")
    assert {r["source_address"]: r["n"] for r in _query(spark, "filter_f11_valid_days").collect()} == _counts(
        c.located.filter(day.isin(days)))


def test_bands_of_the_whole_week(spark, c):
    week = filters.local_period(c.t20, "2024-01-08 00:00:00", "2024-01-15 00:00:00")
    days = week.select("source_address", F.to_date(F.from_utc_timestamp("timestamp", "Asia/Seoul")).alias("d")).distinct()
    assert {r["source_address"]: r["n_days"] for r in _query(spark, "revisit_r2_observed_day_bands").collect()} == _counts(days)


def test_cleaned_rows_are_returned(spark, c):
    assert _query(spark, "clean_c3_cleaned_one_second").count() == c.cleaned.count()


def test_grid_counts_every_row(spark, c):
    assert _query(spark, "join_j7_zero_filled_grid").agg(F.sum("n")).collect()[0][0] == c.located.count()


def test_bands_of_all_days(spark, c):
    """F28-F35: days beyond one week count too."""
    day = F.to_date(F.from_utc_timestamp("timestamp", "Asia/Seoul")).alias("d")
    want = _counts(c.t20.select("source_address", day).distinct())
    assert {r["source_address"]: r["n_days"] for r in _query(spark, "revisit_r2_observed_day_bands").collect()} == want
    assert max(want.values()) > 7
    rows = _query(spark, "revisit_r7_identifier_day_stats").agg(F.sum("n_detections")).collect()[0][0]
    extreme = c.whole_bands.filter(F.col("observed_day_band") != "2–4 days").select("source_address")
    assert rows == c.t20.join(extreme, "source_address").count()
