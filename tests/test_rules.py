"""Boundaries that are easy to get wrong, on literals and against plain loops."""

import random
from dataclasses import replace

import pytest
from helpers import BASE, located, seconds
from pyspark.sql import functions as F

from waymark import schemas
from waymark.functions.islands import split_sessions, with_gaps
from waymark.functions.stats import average_rank, exact_quantiles, share, top_with_ties
from waymark.operators import activities as act
from waymark.operators import aggregate, cleaning, count, filters, joins, location, quality, revisits, track
from waymark.params import MAINTAINED, CleaningParams
from waymark.plans import stages
from waymark.sources import tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_strength_tie_goes_to_lowest_name(spark):
    t20 = spark.createDataFrame(
        [("a", "A02", 50.0), ("a", "A01", 50.0), ("b", "A01", 10.0), ("b", "A02", 11.0), ("c", "A03", 0.0)],
        "source_address string, sensor_name string, strength_sum double",
    ).withColumn("timestamp", F.timestamp_seconds(F.lit(BASE))).withColumn("detections", F.lit(1))
    best = rows(location.strongest_sensor(t20), "source_address", "sensor_name", "strength_sum")
    assert best == [("a", "A01", 50.0), ("b", "A02", 11.0), ("c", "A03", 0.0)]
    assert rows(location.tied_windows(t20), "source_address", "n_tied") == [("a", 2)]


def test_track_gap_is_exclusive(spark):
    rows_ = located(spark, [(t, "a", "A01", 0.0, 0.0) for t in (0, 1800, 3601)])
    assert rows(track.split_trajectories(rows_, 1800), "trajectory_id") == [(1,), (1,), (2,)]
    summary = track.trajectory_summary(rows_, 1800)
    assert rows(summary, "trajectory_id", "n_windows", "is_od") == [(1, 2, 0), (2, 1, 0)]


def test_episode_gap_is_inclusive_and_distance_strict(spark):
    line = [(0, "A01", 0.0), (20, "A02", 75.0), (40, "A03", 75.1), (60, "A01", 0.0),
            (659, "A01", 0.0), (1259, "A01", 0.0)]
    rows_ = located(spark, [(t, "a", s, x, 0.0) for t, s, x in line])
    got = rows(act.activities(rows_), "cluster_id", "episode_id", "duration_seconds", "n_windows")
    # 75 m stays, 75.1 m opens cluster 2, its return (75.1 m away) cluster 3; 600 s splits, 599 s does not
    assert got == [(1, 1, 20, 2), (2, 1, 0, 1), (3, 1, 599, 2), (3, 2, 0, 1)]


def test_activity_classes(spark):
    df = spark.createDataFrame([(299,), (300,), (899,), (900,), (3599,), (3600,)], "duration_seconds long")
    got = rows(act.classify(df), "duration_seconds", "is_stay", "activity_type")
    assert got == [(299, 0, "Pass-through"), (300, 1, "Short stay"), (899, 1, "Short stay"),
                   (900, 1, "Medium stay"), (3599, 1, "Medium stay"), (3600, 1, "Long stay")]


def test_stationary_limit(spark):
    def at(last):
        return seconds(spark, [(t, "a", "A01") for t in [*range(0, last, 300), last]] + [(9, "a", "A02"), (5, "b", "A01")])

    assert rows(cleaning.remove_stationary(at(7200)), "source_address").count(("a",)) > 0
    assert rows(cleaning.remove_stationary(at(7201)), "source_address") == [("b",)]
    historical = CleaningParams(stationary_inclusive=True)
    assert rows(cleaning.remove_stationary(at(7200), historical), "source_address") == [("b",)]


def test_session_gap_301_splits(spark):
    got = cleaning.sessions(seconds(spark, [(t, "a", "A01") for t in (0, 300, 601)]))
    assert rows(got, "session_id", "duration_seconds", "n_rows") == [(1, 300, 2), (2, 0, 1)]


def test_local_midnight(spark):
    rows_ = located(spark, [(t - 86400, "a", "A01", 0.0, 0.0) for t in (53980, 54000, 54020)])
    # 14:59:40Z, 15:00:00Z and 15:00:20Z: one trajectory on two Korean dates
    got = rows(revisits.revisits(rows_), "n_qualifying_trajectories", "observed_local_dates")
    assert got == [(1, "2024-01-14;2024-01-15")]
    only = located(spark, [(t - 86400, "a", "A01", 0.0, 0.0) for t in (57600, 57620)])
    assert rows(revisits.revisits(only), "observed_local_dates") == [("2024-01-15",)]
    assert rows(revisits.revisits(located(spark, [(0, "a", "A01", 0.0, 0.0)])), "source_address") == []


def test_empty_and_flagged_inputs(spark):
    none = located(spark, [(0, "a", "A01", 0.0, 0.0)]).limit(0)
    assert track.trajectory_summary(none).count() == 0
    assert act.activities(none).count() == 0
    assert revisits.revisits(none).count() == 0
    assert cleaning.clean(seconds(spark, [(0, "a", "A01", 1), (1, "a", "A01", 1)])).count() == 0


def test_filters(spark):
    p = spark.createDataFrame([(-80, "Beacon"), (-30, "data"), (-81, "data"), (-29, "data"), (-50, "PROBE-response")],
                              "strength int, subtype string")
    assert filters.rssi_between(p).count() == 3
    assert filters.exclude_subtypes(p).count() == 3 and filters.exclude_subtypes(p, ()).count() == 5
    raw = spark.createDataFrame([(-100,), (-99,), (-1,), (0,), (-255,)], "rssi int")
    assert rows(filters.drop_rssi_sentinels(raw), "rssi") == [(-99,), (-1,)]
    with pytest.raises(ValueError):
        filters.rssi_between(p, -130, 0)
    a = spark.createDataFrame([("AA:BB:CC:DD:EE:FF",), ("a8:bb:cc:dd:ee:ff",), ("00:00:00:00:00:00",),
                               ("FF:ff:ff:ff:ff:ff",), ("aabbccddeeff",)], "source_address string")
    kept = filters.drop_invalid_addresses(a).withColumn("r", filters.locally_administered("source_address"))
    assert rows(kept, "source_address", "r") == [("AA:BB:CC:DD:EE:FF", True), ("a8:bb:cc:dd:ee:ff", False)]
    label = spark.createDataFrame([("206 (front)",), ("lab",)], "l string")
    assert rows(label.select(filters.plain_sensor_label("l").alias("l")), "l") == [("206",), ("lab",)]


def test_time_text(spark):
    good = ["2024-02-29T00:00:00Z", "2024-01-01T23:59:59.123456789Z"]
    bad = ["2023-02-29T00:00:00Z", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00", "2024-01-01T00:00:00+00:00",
           "2024-01-01T24:00:00Z", "2024-01-01T00:00:00.1234567890Z", None]
    df = spark.createDataFrame([(t,) for t in good + bad], "timestamp string")
    assert rows(df.filter(~quality.invalid_utc_text()), "timestamp") == [(t,) for t in sorted(good)]
    assert rows(df.filter(~quality.invalid_utc_text(whole_second=True)), "timestamp") == [(good[0],)]


def test_deduplicate_takes_median_of_medians(spark):
    df = seconds(spark, [(0, "a", "A01")]).withColumn(
        "rssi_median", F.explode(F.array(F.lit(-50.0), F.lit(-54.0), F.lit(-60.0), F.lit(-61.0))))
    assert rows(aggregate.deduplicate_one_second(df), "rssi_median", "packet_count") == [(-57.0, 4)]


def test_top_with_ties_and_share(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 1), ("e", 9)], "k string, n long")
    assert rows(top_with_ties(df, "n", 2), "k") == [("a",), ("b",), ("c",), ("e",)]
    assert rows(share(df, "n", []), "k", "pct")[0] == ("a", 20.0)


def test_average_rank(spark):
    df = spark.createDataFrame([("s", v) for v in (3, 1, 3, 7)], "site string, v long")
    assert rows(average_rank(df, "v", ["site"], "r"), "v", "r") == [(1, 1.0), (3, 2.5), (3, 2.5), (7, 4.0)]


@pytest.mark.parametrize("width", [0.01, 1.0, 1000.0])
def test_exact_quantiles_match_linear_interpolation(spark, width):
    import numpy as np
    rng = random.Random(5)
    data = [("a", rng.random() * 50) for _ in range(997)] + [("b", 7.25)] * 500 + [("b", rng.random()) for _ in range(8)]
    data += [("c", 1.5)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, width).collect()}
    for g in "abc":
        values = [v for k, v in data if k == g]
        assert [got[g].q25, got[g].q50, got[g].q75] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))
        assert got[g].n == len(values) and got[g]["mean"] == pytest.approx(np.mean(values))


def test_nearest_asof_against_all_pairs(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(0, 20000) + 0.5 * rng.randrange(2), i) for i in range(300)]
    right = sorted({(rng.choice("abc"), rng.randrange(0, 20000)) for _ in range(400)} | {("a", 3600), ("a", 3598)})
    left += [("a", 3599.0, 300), ("b", 7200.0, 301)]
    expected = []
    for k, t, i in left:
        near = min(((abs(u - t), u) for r, u in right if r == k), default=None)
        expected.append((i, near[1] if near and near[0] <= 60 else None))
    a = spark.createDataFrame(left, "k string, t double, i int")
    b = spark.createDataFrame([(k, u, float(u)) for k, u in right], "k string, u long, p double")
    got = joins.nearest_asof(a, b, "k", "t", "u", ["p"], 60.0, chunk_seconds=600).select("i", "p").collect()
    assert sorted((r.i, r.p) for r in got) == sorted(expected)


def test_pairs_within_against_all_pairs(spark):
    rng = random.Random(1)
    pts = [(f"s{i}", rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(60)]
    s = spark.createDataFrame(pts, "sensor_name string, x double, y double")
    expected = sorted((a[0], b[0]) for a in pts for b in pts
                      if ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 110)
    assert rows(joins.pairs_within(s, 110.0), "origin", "destination") == expected


def _plain_islands(data, gap, inclusive):
    expected = {}
    for k in {k for k, _ in data}:
        number, last = 0, None
        for t in sorted(t for j, t in data if j == k):
            if last is None or (t - last >= gap if inclusive else t - last > gap):
                number += 1
            expected[k, t], last = number, t
    return expected


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("chunk", [50, 1000, 86400])
def test_islands_do_not_depend_on_chunks(spark, inclusive, chunk):
    rng = random.Random(chunk)
    data = sorted({(rng.choice("aaaab"), rng.randrange(0, 5000)) for _ in range(500)})
    df = spark.createDataFrame(data, "k string, t long").withColumn("timestamp", F.timestamp_seconds("t"))
    got = split_sessions(df, ["k"], 20, into="s", inclusive=inclusive, chunk_seconds=chunk)
    assert {(r.k, r.t): r.s for r in got.collect()} == _plain_islands(data, 20, inclusive)
    gaps = {(r.k, r.t): r.g for r in with_gaps(df, ["k"], into="g", chunk_seconds=chunk).collect()}
    for k in "ab":
        times = [t for j, t in data if j == k]
        assert [gaps[k, t] for t in times] == [None] + [b - a for a, b in zip(times, times[1:])]


def test_anchor_clusters_against_loop(spark):
    rng = random.Random(9)
    data = [(20 * i, who, f"s{p}", float(p * 40), 0.0) for who in ("a", "b") for i in range(120)
            for p in [rng.randrange(6)]]
    got = act.anchor_clusters(act.qualifying_rows(located(spark, data)))
    expected = []
    for who in ("a", "b"):
        cluster, anchor = 0, None
        for t, w, s, x, y in data:
            if w != who:
                continue
            if anchor is None or abs(x - anchor) > 75:
                cluster, anchor = cluster + 1, x
            expected.append((who, t + BASE, cluster))
    assert rows(got.withColumn("t", F.unix_seconds("timestamp")), "source_address", "t", "cluster_id") == sorted(expected)


def test_quality_limits(spark):
    rows_ = located(spark, [(t, "a", "A01", 0.0, 0.0) for t in (0, 3600, 7200)]
                    + [(t, "b", "A01", 0.0, 0.0) for t in (0, 3600, 7220)]
                    + [(t, "c", "A01", 0.0, 0.0) for t in (0, 20)])
    assert {r[0] for r in rows(act.qualifying_rows(rows_), "source_address")} == {"a"}
    longer = replace(MAINTAINED, activity_max_seconds=9000)
    assert {r[0] for r in rows(act.qualifying_rows(rows_, longer), "source_address")} == {"a", "b"}


def test_uptime_counts_missing_days_as_zero(spark):
    sensors = spark.createDataFrame([("A01",), ("A02",)], "sensor_name string")
    rows_ = located(spark, [(t, "a", "A01", 0.0, 0.0) for t in (0, 1800, 3600)] + [(86400, "a", "A02", 0.0, 0.0)])
    got = rows(count.sensor_uptime(rows_, sensors), "sensor_name", "n_slots", "healthy")
    assert got == [("A01", 0, 0), ("A01", 3, 1), ("A02", 0, 0), ("A02", 1, 0)]


def test_revisit_dates_follow_daylight_saving(spark):
    """New York on 2024-03-10: midnight is 05:00 UTC that day and 04:00 UTC the next."""
    midnight = 1710046800  # 2024-03-10 05:00 UTC
    times = [midnight - 20, midnight, midnight + 23 * 3600 - 20, midnight + 23 * 3600]
    rows_ = located(spark, [(t - BASE, f"id{i}", "A01", 0.0, 0.0) for i, t in enumerate(times)])
    got = rows(revisits.revisits(rows_, min_windows=1, tz="America/New_York"), "source_address", "observed_local_dates")
    assert got == [("id0", "2024-03-09"), ("id1", "2024-03-10"), ("id2", "2024-03-10"), ("id3", "2024-03-11")]


def test_metrics_refuse_unknown_sensors(spark):
    t20 = spark.createDataFrame(
        [("a", "A01", 50.0), ("a", "A99", 60.0)], "source_address string, sensor_name string, strength_sum double",
    ).withColumn("timestamp", F.timestamp_seconds(F.lit(BASE))).withColumn("detections", F.lit(1))
    known = spark.createDataFrame([("A01", 0.0, 0.0)], "sensor_name string, x double, y double")
    with pytest.raises(quality.ContractError, match="A99"):
        stages.five_metrics(t20, known)
    assert stages.five_metrics(t20.filter("sensor_name = 'A01'"), known)["location"].count() == 1


def test_packets_need_every_column(spark, tmp_path):
    path = str(tmp_path / "packets")
    names = [n for n in schemas.PACKETS_RAW.names if n != "channel"]
    spark.createDataFrame([], schemas.PACKETS_RAW).select(*names).write.parquet(path)
    with pytest.raises(quality.ContractError, match="channel"):
        tables.read_packets(spark, path)
