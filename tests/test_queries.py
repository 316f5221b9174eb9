"""All registered queries of the library next to their SQL counterparts at sf0.001, the same results under
another partitioning, and an identifier that holds a third of all rows.

``python check.py /root/testdata/sf0.01`` compares them on more rows."""

import os

import pytest
from helpers import BASE, located, seconds
from pyspark.sql import functions as F

import check
import __spark_entry__ as entry
from waymark.operators import activities, aggregate, cleaning, filters, track
from waymark.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_every_query_has_sql():
    """The library's own queries; those of the training-data operators have tests of their own."""
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", catalog.queries())
def test_query_matches_sql(spark, name):
    text, _, ok = check.compare(spark, check.database(SF), SF, name)
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["origin", "destination", "n_trajectories", "n_retained_identifiers"]
    assert df.count() > 0


def test_results_do_not_depend_on_partitioning(spark):
    from waymark.plans.context import Context
    rows_ = Context(spark, SF).located
    expected = sorted(map(tuple, track.trajectory_summary(rows_).collect()))
    other = rows_.repartition(23).orderBy(F.rand(seed=4))
    assert sorted(map(tuple, track.trajectory_summary(other).collect())) == expected


def test_hot_identifier_is_spread(spark):
    """One identifier with a third of all rows: no task of the row-level windows gets them all."""
    hot = [(t, "hot", f"s{t // 4000 % 3}", float(t // 4000 % 3 * 100), 0.0) for t in range(0, 86400 * 10, 60)]
    rest = [(t, f"id{i}", "s0", 0.0, 0.0) for i in range(200) for t in range(0, 2880 * 50, 1000)]
    rows_ = located(spark, hot + rest)
    numbered = track.split_trajectories(rows_, 1800)
    assert numbered.filter("source_address = 'hot'").agg(F.max("trajectory_id")).first()[0] == 1
    # Windows over rows are by identifier and day; windows by identifier alone are over aggregates.
    plan = numbered._jdf.queryExecution().optimizedPlan()
    nodes, row_windows = [plan], 0
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window":
            spec = node.partitionSpec().mkString(",")
            inner, rows_below = [*below], True
            while inner:
                x = inner.pop()
                rows_below = rows_below and x.nodeName() != "Aggregate"
                inner += [x.children().apply(i) for i in range(x.children().size())]
            assert "_chunk" in spec or not rows_below
            row_windows += rows_below
        nodes += below
    assert row_windows >= 1
    summary = track.trajectory_summary(rows_, 1800).filter("source_address = 'hot'").first()
    assert (summary.start_epoch, summary.n_windows) == (BASE, len(hot))
    assert activities.activities(rows_).filter("source_address = 'hot'").count() == 0


@pytest.mark.parametrize("step", [
    cleaning.remove_stationary, filters.drop_rare, filters.drop_night_persistent,
    lambda rows: aggregate.twenty_second(cleaning.clean(rows, deduplicate=False)),
])
def test_anti_joins_spread_an_identifier(spark, step):
    """Rows meet the list on (identifier, salt): with no broadcast, no row goes to a task for its identifier alone."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        plan = step(seconds(spark, [(t, "hot", "s0") for t in range(10)]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    joins = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert joins and all("_salt" in line for line in joins)
