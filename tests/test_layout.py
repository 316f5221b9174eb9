"""The library without the operators for training data: it imports, and registers its own queries."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from waymark.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_imports_without_llm(tmp_path, pipeline_stays):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [
        n for n in names if n in ("llm", ".git", "__pycache__") or n == "corpus_pipeline.py" and not pipeline_stays])
    os.makedirs(copy / "waymark" / "llm" / "__pycache__")  # what a deletion may leave behind
    code = "import __spark_entry__ as e, sys; print(len(e.queries()), len(e.oracle_sql())); import check"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]


def _exchanges_above_the_expansion(df):
    """Exchanges that move rows of packets: those with the expansion (a Generate) below them."""
    def walk(node):
        below = [walk(node.children().apply(i)) for i in range(node.children().size())]
        expanded = node.nodeName() == "Generate" or any(e for e, _ in below)
        return expanded, sum(n for _, n in below) + (node.nodeName() == "Exchange" and any(e and g for (e, _), g in zip(
            below, ["explode(sequence(0" in node.toString()] * len(below))))

    limit = "spark.sql.adaptive.enabled"
    before = df.sparkSession.conf.get(limit)
    df.sparkSession.conf.set(limit, "false")
    try:
        return walk(df._jdf.queryExecution().executedPlan())[1]
    finally:
        df.sparkSession.conf.set(limit, before)


def test_packets_are_not_exchanged_on_the_way_to_windows(spark):
    """Events are dealt by identifier and day before they become packets; seconds, windows and duplicates follow in place."""
    from waymark.operators import aggregate
    from waymark.plans.context import Context
    c = Context(spark, "/root/testdata/sf0.001")
    seconds = aggregate.one_second(c.packets_by_day)
    for rows in (seconds, aggregate.twenty_second(seconds), aggregate.twenty_second_from_raw(c.raw_by_day, c.district)):
        assert _exchanges_above_the_expansion(rows) == 0
    assert _exchanges_above_the_expansion(aggregate.one_second(c.packets)) == 1


def test_tasks_grow_with_the_events(spark, monkeypatch):
    from waymark.sources import synthetic
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(synthetic, "EVENTS_A_TASK", 50)
    assert synthetic.parts(spark, sf) == 20
    assert synthetic.packets_by_day(spark, sf).rdd.getNumPartitions() == 20


def test_median_of_few_is_the_median(spark):
    from pyspark.sql import functions as F
    from waymark.functions.stats import median_of_few
    rows = spark.createDataFrame([(g, v) for g, vs in enumerate(
        [[None], [3], [4, 1], [2, None, 9, 7], [5, 5, 1, 8], [-3, -80, -41, -41, -12]]) for v in vs], "g int, v int")
    got = rows.groupBy("g").agg(median_of_few("v").alias("few"), F.median("v").alias("all")).collect()
    assert len(got) == 6 and all(r.few == r.all for r in got)


def test_scopes_are_compared_by_addresses_read_once(spark):
    df = catalog.queries()["release_x5_scope_overlap"](spark, "/root/testdata/sf0.001")
    assert "explode(sequence(0" not in df._jdf.queryExecution().executedPlan().toString()


def test_rekey_reads_its_table_once_for_all_columns(spark):
    """Once for the identifiers and once for the rows; each more column used to read and join it again."""
    from waymark.operators import release
    rows = spark.range(9).selectExpr("explode(sequence(0, id)) AS n", "id").selectExpr(
        "CONCAT('a', n) AS source_address", "CONCAT('b', id) AS device_address", "'' AS mac_address")
    keyed = release.rekey(rows, "scope", bytes(range(32)), b"domain")
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence") <= 4
    got = keyed.distinct().collect()
    assert len(got) == 45 and {r["mac_address"] for r in got} == {""} and len({r["source_address"] for r in got}) == 9


def test_runs_are_dealt_before_they_become_packets(spark):
    """The same packets as in the capture table, each run in one partition, and no packet is exchanged or sorted."""
    from waymark.sources import synthetic
    sf = "/root/testdata/sf0.001"
    runs = synthetic.packets_text_by_run(spark, sf)
    plan = runs._jdf.queryExecution().executedPlan().toString()  # the outermost steps come first
    assert plan.index("explode(sequence(k") < min(plan.index("Exchange"), plan.index("Sort"))
    tasks = runs.select("run", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(tasks) == 17 == len({r["run"] for r in tasks}) == len({r["p"] for r in tasks})
    assert runs.filter("run <> sensor_name").isEmpty()
    plain = synthetic.packets_text(spark, sf)
    assert runs.count() == plain.count()
    assert runs.drop("run").exceptAll(plain).isEmpty()


def test_windows_within_a_day_are_not_exchanged(spark):
    """Windows and estimates of located rows follow where the rows lie, unless a window may cross midnight; the sums are the same."""
    from waymark.operators import location
    from waymark.plans.context import Context
    c = Context(spark, "/root/testdata/sf0.001")
    widths = (20, 60)
    laid = location.estimates(location.window_strength(c.packets_by_day.withColumnRenamed("strength", "rssi"), widths), c.sensors)
    plain = location.estimates(location.window_strength(c.packets.withColumnRenamed("strength", "rssi"), widths), c.sensors)
    assert _exchanges_above_the_expansion(laid) == 0 < _exchanges_above_the_expansion(plain)
    keys = ["source_address", "width", "window_start", "px", "py"]
    assert laid.count() == plain.count() and laid.select(keys).exceptAll(plain.select(keys)).isEmpty()
    crossing = location.window_strength(c.packets_by_day.withColumnRenamed("strength", "rssi"), (20, 70))
    assert "utc_day" not in crossing.columns


def test_multiset_difference_groups_its_rows_once(spark):
    from waymark.operators.joins import multiset_difference
    left = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a"), (3, "b")], "k long, v string")
    right = spark.createDataFrame([(1, None), (2, "a"), (2, "a"), (4, None)], "k long, v string")
    got = multiset_difference(left, right)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        (1, None, "left_only"), (1, None, "left_only"), (3, "b", "left_only"), (2, "a", "right_only"), (4, None, "right_only")], key=repr)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


@pytest.mark.parametrize("name", ["check_v12_table_equality", "check_v14_rebuild", "check_v18_location_agreement", "release_x9_location_impact"])
def test_tables_of_one_layout_are_compared_where_they_lie(spark, monkeypatch, name):
    """No row is exchanged by identifier between tables in buckets of identifier and day."""
    from waymark.plans.context import Context
    plans, setting = [], "spark.sql.requireAllClusterKeysForCoPartition"

    def stage(self):
        return lambda df, _: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df

    before = spark.conf.get(setting)
    monkeypatch.setattr(Context, "stage", stage)
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    joins = [p for p in plans if "FullOuter" in p]
    assert len(joins) == 1 and spark.conf.get(setting) == before
    assert not any("Exchange hashpartitioning" in line and "timestamp" in line for line in joins[0].splitlines())


def test_daily_paths_of_laid_rows_move_as_pieces(spark):
    """The same paths from rows with and without their UTC day, a local date in two of them and a sensor seen in both."""
    from waymark.operators import disclosure
    rows = spark.createDataFrame([(0, "a", "s2"), (20, "a", "s1"), (40, "a", "s2"), (54000, "a", "s3"), (86400, "a", "s1"), (86420, "a", "s4"),
                                  (141000, "a", "s1"), (60, "b", "s1")], "t long, source_address string, sensor_name string")
    rows = rows.select(F.timestamp_seconds(F.col("t") + 1705276800).alias("timestamp"), "source_address", "sensor_name",
                       F.floor((F.col("t") + 1705276800) / 86400).alias("utc_day"))
    got = sorted(map(tuple, disclosure.daily_sequence(rows).select("source_address", "sensor_sequence", "sensors_visited").collect()))
    plain = sorted(map(tuple, disclosure.daily_sequence(rows.drop("utc_day")).select("source_address", "sensor_sequence", "sensors_visited").collect()))
    assert got == plain == [("a", "s1", 1), ("a", "s2>s1", 2), ("a", "s3>s1>s4", 3), ("b", "s1", 1)]
    laid = disclosure.daily_sequence(rows.repartition(8, "source_address", "utc_day"))
    assert "sensor_name" not in "".join(
        line for line in laid._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)


def test_revisits_of_another_zone_keep_the_layout(spark):
    """Pieces of trajectories are found where the located rows lie; only their summaries are exchanged."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.queries()["revisit_r1_new_york"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "Exchange hashpartitioning(source_address" in plan and "_chunk" not in "".join(
        line.split("ENSURE")[0] for line in plan.splitlines() if "Exchange" in line)
