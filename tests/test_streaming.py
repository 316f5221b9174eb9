"""Streams over several batches: what they emit and what they still hold make up the batch result."""

import random

from helpers import BASE, located, seconds

from waymark.operators import activities, cleaning, track
from waymark.streaming import flows, stateful

ROWS = [(t, f"id{i}", "s0") for i in range(3) for t in (0, 300, 601, 5000 + 40 * i, 9000)]


def emitted(spark, tmp_path, table, flow):
    source = str(tmp_path / "source")
    for part in ("t < 1000", "t >= 1000 AND t < 9000", "t >= 9000"):
        table.selectExpr("*", "unix_seconds(timestamp) - 1705276800 AS t").filter(part).drop("t") \
            .write.mode("append").parquet(source)
    stream = flows.read_packets_stream(spark, source, table.schema, files_per_batch=1)
    out = str(tmp_path / "out")
    watermark = flows.run_available(flow(stream), out, str(tmp_path / "progress"))
    return spark.read.parquet(out), watermark


def test_windows_of_a_finished_archive(spark, tmp_path):
    table = seconds(spark, ROWS)
    got, watermark = emitted(spark, tmp_path, table, flows.twenty_second_direct)
    rest = flows.twenty_second_direct(flows.open_windows(table, watermark, 20))
    assert rest.count() == 3 and got.count() == 12
    assert sorted(map(tuple, got.unionByName(rest).collect())) == \
        sorted(map(tuple, flows.twenty_second_direct(table).collect()))


def test_sessions_of_a_finished_archive(spark, tmp_path):
    """300 s joins, 301 s splits, and the last session of each identifier is still open."""
    table, keys = seconds(spark, ROWS), ["source_address", "sensor_name"]
    got, watermark = emitted(spark, tmp_path, table, flows.sensor_sessions)
    held = flows.sensor_sessions(flows.open_sessions(table, keys, watermark, 300))
    rest = flows.still_open(held, watermark, 300)
    assert rest.count() == 3
    expected = cleaning.sessions(table).select(*got.columns)
    assert sorted(map(tuple, got.unionByName(rest).collect())) == sorted(map(tuple, expected.collect()))


def test_trajectories_without_a_watermark_are_the_batch_result(spark):
    table = located(spark, [(*r, 0.0, 0.0) for r in ROWS])
    held = flows.trajectories(flows.open_sessions(table, ["source_address"], None, 1800))
    got = flows.still_open(held, None, 1800).select("source_address", "start_epoch", "end_epoch", "n_windows")
    expected = track.trajectory_summary(table).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def restarted(spark, tmp_path, table, flow, cuts):
    """One run for each part of the archive, on one checkpoint; what each run had told so far."""
    source, out, seen = str(tmp_path / "source"), str(tmp_path / "out"), []
    spark.conf.set("spark.sql.shuffle.partitions", "2")     # as many state stores
    known = table.selectExpr("*", "unix_seconds(timestamp) - 1705276800 AS t")
    for low, high in zip([0, *cuts], [*cuts, 10 ** 9]):
        known.filter(f"t >= {low} AND t < {high}").drop("t").write.mode("append").parquet(source)
        stream = flows.read_packets_stream(spark, source, table.schema)
        watermark = stateful.run_available(flow(stream), out, str(tmp_path / "progress"))
        seen.append(sorted(map(tuple, spark.read.parquet(out).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return seen, spark.read.parquet(out), watermark


def test_stationary_identifiers_are_told_once_across_restarts(spark, tmp_path):
    stay = [(t, "stay", "s0") for t in range(0, 20000, 200)]
    at_limit = [(t, "limit", "s0") for t in range(0, 7201, 300)]           # exactly the limit is not beyond it
    gap = [(t, "gap", "s0") for t in [*range(0, 7000, 300), *range(7300, 14000, 300)]]
    two = [(t, "two", f"s{t // 300 % 2}") for t in range(0, 12000, 300)]   # seen by two sensors in turn: gaps of 600 s
    late = [(t, "late", "s1") for t in range(17000, 24401, 250)]           # still open when the archive ends
    table = seconds(spark, stay + at_limit + gap + two + late)
    seen, told, watermark = restarted(spark, tmp_path, table, stateful.stationary, (5000,))
    assert seen == [[], [("stay", BASE + 7400)]]
    whole = stateful.stationary_of_archive(told, table, watermark)
    expected = {r[0] for r in cleaning.stationary_identifiers(table).collect()}
    assert {r[0] for r in whole.collect()} == expected == {"stay", "late"}


def test_clusters_across_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(t, f"id{i}", f"s{(t // 400 + i) % 3}", float((t // 400 + i) % 3 * 80), 0.0)
            for i in range(6) for t in range(0, 60000, 20) if rng.random() < (0.4 if t % 20000 < 6000 else 0.0)]
    rows += [(t, "long", "s0", 0.0, 0.0) for t in range(0, 60000, 600)]    # a trajectory beyond the accepted duration
    rows += [(t, "open", "s0", 0.0, 0.0) for t in range(58000, 59900, 20)] # one that the archive's end leaves open
    rows += [(t, "id0", "s0", 0.0, 0.0) for t in range(59700, 59900, 20)]  # and rows beyond the last watermark after closed ones
    table = located(spark, rows)
    seen, told, watermark = restarted(spark, tmp_path, table, stateful.clusters, (15000,))
    got = stateful.clusters_of_archive(told, table, watermark)
    kept = activities.qualifying_rows(table)
    expected = activities.split_episodes(activities.anchor_clusters(kept)).selectExpr(
        "source_address", "trajectory_id", "cluster_id", "episode_id", "unix_seconds(timestamp)", "sensor_name")
    expected = sorted(map(tuple, expected.collect()))
    assert sorted(map(tuple, got.collect())) == expected and not any(r[0] == "long" for r in expected)
    # Rows come with the run in which their trajectory ends, each once, and most by the stream itself.
    assert 0 < len(seen[0]) < len(seen[1]) < len(expected) < 1.2 * len(seen[1])
    assert set(seen[0]) <= set(seen[1]) <= set(expected)
