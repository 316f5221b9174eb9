"""Folds over sorted rows against the rules written as plain loops, and in constant memory."""

import random
import resource

import pyarrow as pa
import pytest
from helpers import BASE, located
from pyspark.sql import functions as F

from waymark.operators import activities as act
from waymark.operators import folds


def numbered(rows):
    """(trajectory, t, sensor, x, y) -> the same with cluster and episode, by the rule's words."""
    out, key = [], None
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        trip, t, _, x, y = row
        if trip != key:
            key, anchor, cluster, episode = trip, (x, y), 1, 1
        elif ((x - anchor[0]) ** 2 + (y - anchor[1]) ** 2) ** 0.5 > 75:
            anchor, cluster, episode = (x, y), cluster + 1, 1
        elif t - last >= 600:
            episode += 1
        last = t
        out.append((*row, cluster, episode))
    return out


def sample():
    rng, rows = random.Random(8), []
    for trip in range(30):
        t = 0
        for _ in range(rng.choice([1, 2, 40, 300])):
            t += rng.choice([20, 20, 20, 580, 599, 600, 601, 620])
            rows.append((f"id{trip % 7}:{trip}", t, f"s{rng.randrange(4)}", float(rng.choice([0, 45, 60, 75, 76, 300])), float(rng.choice([0, 60]))))
    return rows


def trajectories(spark, rows):
    return located(spark, [(t, trip.split(":")[0], sensor, x, y) for trip, t, sensor, x, y in rows]).drop("source_address").join(
        spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, trip string, t long, sensor string, x double, y double").select(
            F.split("trip", ":")[0].alias("source_address"), F.split("trip", ":")[1].cast("long").alias("trajectory_id"), "i",
            F.timestamp_seconds(F.col("t") + BASE).alias("timestamp"), F.col("sensor").alias("sensor_name"), "x", "y"),
        ["timestamp", "sensor_name", "x", "y"]).dropDuplicates(["i"])


def test_clusters_and_episodes_follow_the_rule(spark):
    rows = sample()
    df = trajectories(spark, rows).repartition(9)
    expected = numbered(rows)
    got = act.anchor_clusters(df).withColumn("t", F.unix_seconds("timestamp") - BASE).select(
        F.concat_ws(":", "source_address", "trajectory_id"), "t", "sensor_name", "cluster_id")
    assert sorted(map(tuple, got.collect())) == sorted((r[0], r[1], r[2], r[5]) for r in expected)
    by_windows = act.episode_summary(act.split_episodes(act.anchor_clusters(df)))
    at_once = folds.episodes(df, 75.0, 600)
    assert sorted(map(tuple, at_once.select(*by_windows.columns).collect())) == sorted(map(tuple, by_windows.collect()))
    assert at_once.count() == len({(r[0], r[5], r[6]) for r in expected})


def test_null_places_are_near_everything_and_empty_tables_give_none(spark):
    rows = located(spark, [(0, "a", "s", 0.0, 0.0), (20, "a", "s", None, 0.0), (40, "a", "s", 100.0, 0.0)])
    rows = rows.withColumn("trajectory_id", F.lit(1).cast("long"))
    assert [r.cluster_id for r in act.anchor_clusters(rows).orderBy("timestamp").collect()] == [1, 1, 2]
    assert act.anchor_clusters(rows.limit(0)).count() == 0 and folds.episodes(rows.limit(0), 75.0, 600).count() == 0


def batches(n, size, trips=1):
    for a in range(0, n, size):
        at = range(a, min(n, a + size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"id{i * trips // n}" for i in at]), pa.array([1] * len(at), pa.int64()), pa.array([20 * i for i in at], pa.int64()),
             pa.array([f"s{i // 50 % 9}" for i in at]), pa.array([float(i // 50 % 9 * 80) for i in at]), pa.array([0.0] * len(at))],
            ["source_address", "trajectory_id", "t", "sensor_name", "x", "y"])


@pytest.mark.parametrize("size", [1000, 9973])
def test_a_trajectory_of_a_million_rows_in_flat_memory(size):
    """What is held at a time does not grow with the trajectory."""
    list(folds.episode_rows(batches(60_000, size), 75.0, 600))              # what any run takes
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    episodes = sum(1 for _ in folds.episode_rows(batches(1_000_000, size), 75.0, 600))
    rows, last = 0, 0
    for batch, numbers in folds.cluster_numbers(batches(1_000_000, size), 75.0):
        assert len(numbers) == batch.num_rows and numbers[0] - last <= 1
        rows, last = rows + batch.num_rows, numbers[-1]
    grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before     # KB
    assert rows == 1_000_000 and last == episodes == 20_000 and grown < 40_000, grown


def test_results_do_not_depend_on_batches():
    whole = list(folds.episode_rows(batches(20_000, 20_000, trips=7), 75.0, 600))
    assert whole == list(folds.episode_rows(batches(20_000, 333, trips=7), 75.0, 600)) and len({r[0] for r in whole}) == 7
