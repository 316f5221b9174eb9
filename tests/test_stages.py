"""Stages and comparisons of rows laid out by identifier and day: what they cost by their plans, and that they give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from waymark import schemas
from waymark.functions import islands
from waymark.operators import aggregate, cleaning, joins, location, quality, release
from waymark.plans import catalog
from waymark.plans.context import Context
from waymark.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def c(spark):
    return Context(spark, SF)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("build", [lambda c: aggregate.one_second(c.packets_by_day), lambda c: aggregate.twenty_second(c.cleaned_by_day)])
def test_lists_of_a_stage_are_aggregated_once(spark, c, build):
    """A stage's lists were hashed, sorted, written and read again between two aggregations."""
    before = {key: spark.conf.get(key) for key in tables.SORTED}
    with tables.settings(spark, tables.SORTED):
        plan = plan_of(build(c))
    assert plan.count("collect_list") == plan.count("SortAggregate") == 1 and "ObjectHashAggregate" not in plan
    assert {key: spark.conf.get(key) for key in tables.SORTED} == before


def test_settings_are_put_back_after_an_error(spark):
    with pytest.raises(ZeroDivisionError), tables.settings(spark, tables.SORTED | {"waymark.none": "1"}):
        1 / 0
    assert spark.conf.get("waymark.none", None) is None
    assert all(spark.conf.get(key) != value for key, value in tables.SORTED.items())


def test_stages_hold_the_medians_of_their_rows(spark, c):
    kept = aggregate.filters.exclude_subtypes(aggregate.filters.rssi_between(c.packets))
    want = kept.groupBy(F.date_trunc("second", "timestamp").alias("timestamp"), "source_address", "sensor_name").agg(
        F.median("strength").alias("rssi_median"), F.count("*").alias("packet_count"))
    got = c.sec1.select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def _sessions(rows, gap):
    out, last = {}, {}
    for key, t in sorted(rows):
        number, start, end, n = out.get(key, [(0, None, None, 0)])[-1]
        if n and t - last[key] <= gap:
            out[key][-1] = (number, start, t, n + 1)
        else:
            out.setdefault(key, []).append((number + 1, t, t, 1))
        last[key] = t
    return sorted((key, *s) for key, sessions in out.items() for s in sessions)


@pytest.mark.parametrize("laid", [True, False])
def test_sessions_follow_from_cells(spark, laid):
    """Sessions over cells and midnights, gaps of the limit and one second more, repeated seconds; windows see cells, not rows."""
    rng = random.Random(4)
    rows, t = [], {key: rng.randrange(86000, 86400) for key in ("a", "b", "c")}
    for _ in range(900):
        key = rng.choice("abc")
        t[key] += rng.choice([0, 1, 3, 60, 299, 300, 301, 2000])
        rows.append((key, t[key]))
    df = spark.createDataFrame(rows, "source_address string, t long").select(
        F.timestamp_seconds("t").alias("timestamp"), "source_address", F.lit("s").alias("sensor_name"))
    if laid:
        df = df.withColumn("utc_day", F.floor(F.unix_seconds("timestamp") / 86400))
    got = cleaning.sessions(df, 300)
    columns = ["source_address", "session_id", "start_epoch", "end_epoch", "n_rows"]
    assert sorted(map(tuple, got.select(columns).collect())) == _sessions(rows, 300)
    assert islands.cells(df, ["source_address"], 300).count() < len(rows)
    plan = plan_of(got)  # the outermost steps come first
    assert "partial_count(1)" in plan[plan.rindex("Window"):]


def _exchanges_of_rows(plan):
    return [line for line in plan.splitlines() if "Exchange" in line and "timestamp" in line]


@pytest.mark.parametrize("name", ["set_u2_except_all", "release_x10_daily_difference"])
def test_two_tables_of_one_layout_are_read_where_they_lie(spark, name):
    """Both exchanged the windows of both tables by identifier and time before."""
    assert not _exchanges_of_rows(plan_of(catalog.queries()[name](spark, SF)))


@pytest.mark.parametrize("grain", ["day", "hour"])
def test_periods_of_laid_rows_are_put_together(c, grain):
    """A local day lies in two UTC days, so its identifiers are counted once and its windows in both."""
    laid, plain = release.period_totals(c.t20_by_day, grain), release.period_totals(c.t20, grain)
    assert sorted(map(tuple, laid.collect())) == sorted(map(tuple, plain.collect()))


def test_rules_of_a_packet_are_evaluated_once(spark):
    """A filter on the broken rules went below the projections that they are made of: each expression was evaluated for every rule
    and column again, in code too large to be compiled."""
    plan = catalog.queries()["check_v8_packet_domain"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 3 and plan.count("date_format(") == 1


def test_times_of_the_calendar_as_a_pattern_reads_them(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-02-30T00:00:00Z", "2023-02-29T01:01:01Z", "2024-02-29T23:59:59.123456789Z", "2024-02-29T24:00:00Z",
             "2024-02-29T23:60:00Z", "2024-02-29T23:59:60Z", "0000-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "2024-13-01T00:00:00Z",
             "2024-00-01T00:00:00Z", "2024-01-00T00:00:00Z", "1582-10-10T00:00:00Z", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00", None, "",
             " 2024-01-01T00:00:00Z", "2024-01-01T00:00:00+00:00", "1900-02-29T00:00:00Z", "2000-02-29T00:00:00.5Z"]
    text = F.col("timestamp")
    whole = F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" "))
    by_pattern = text.isNull() | ~text.rlike(quality.UTC_TEXT) | F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss")).isNull()
    rows = spark.createDataFrame([(t,) for t in texts], "timestamp string").select(by_pattern.alias("a"), quality.invalid_utc_text().alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and 0 < sum(r["b"] for r in rows) < len(texts)


def test_the_slim_report_moves_the_planted_rows_only(spark, c):
    """Both tables were exchanged by all their columns before."""
    public = c.landed_by_day(tables.slim(c.t20_by_day), "slim")
    plan = plan_of(joins.multiset_difference(tables.slim(c.t20_planted_by_day), public))
    assert plan.count("Exchange") == 1 == plan.count("Exchange hashpartitioning(source_address")
    assert tables.slim(c.t20).columns == schemas.TWENTY_SECOND_PUBLIC.names


def test_the_five_metrics_are_found_where_the_windows_lie(spark, monkeypatch):
    """The Location table is written in buckets from rows that stay in theirs, and trajectories are split in place."""
    plans, landed = [], Context.landed_by_day

    def kept(self, df, name):
        plans.append(plan_of(df))
        return landed(self, df, name)

    monkeypatch.setattr(Context, "landed_by_day", kept)
    result = catalog.queries()["clean_c5_five_metrics_rows"](spark, SF)
    assert len(plans) == 1 and "Exchange hashpartitioning" not in plans[0]
    assert not any("_chunk" in line.split("ENSURE")[0] for line in plan_of(result).splitlines() if "Exchange" in line)


def test_windows_over_midnight_move_once(spark, c):
    """The sums of windows were exchanged by window and sensor, and the parts of estimates again by window."""
    rows = c.packets_by_day.withColumnRenamed("strength", "rssi")
    laid = location.estimates(location.window_strength(rows, (20, 70)), c.sensors)
    plain = location.estimates(location.window_strength(rows.drop("utc_day"), (20, 70)), c.sensors)
    moves = [line for line in plan_of(laid).splitlines() if "Exchange hashpartitioning" in line and "window_start" in line]
    assert len(moves) == 1 and "sensor_name" not in moves[0]
    assert laid.count() == plain.count() and laid.exceptAll(plain.select(laid.columns)).isEmpty()
