"""The synthetic capture end to end: frozen stage counts and every metric row."""

import pytest
from helpers import MOVING, STAYING, fixture_packets, fixture_sensors
from pyspark.sql import functions as F

from waymark import schemas
from waymark.operators import aggregate, cleaning, quality
from waymark.plans import stages


@pytest.fixture(scope="module")
def run(spark):
    packets = fixture_packets(spark).cache()
    seconds = aggregate.one_second(packets).cache()
    cleaned = cleaning.clean(seconds).cache()
    t20 = aggregate.twenty_second(cleaned).cache()
    metrics = stages.five_metrics(t20, fixture_sensors(spark))
    return packets, seconds, cleaned, t20, {k: [tuple(r) for r in v.collect()] for k, v in metrics.items()}


def test_stage_counts(run):
    packets, seconds, cleaned, t20, metrics = run
    assert packets.count() == 1396
    assert seconds.count() == 698
    assert seconds.filter("source_address_randomized = 1").count() == 80
    assert cleaned.count() == 242
    assert t20.count() == 34
    assert aggregate.twenty_second(seconds).count() == 414
    assert {k: len(v) for k, v in metrics.items()} == {
        "location": 32, "count": 32, "track_trajectories": 3, "track_od": 1, "revisits": 2, "activities": 2}


def test_location_rows(run):
    rows = sorted(run[4]["location"])
    day1 = [("A01", 0.0, 679.0), ("A01", 0.0, 736.0), ("A01", 0.0, 760.0), ("A01", 0.0, 760.0),
            ("A02", 75.0, 679.0), ("A02", 75.0, 736.0), ("A02", 75.0, 760.0), ("A02", 75.0, 760.0)]
    expected = [(f"2024-01-15T00:{20 * i // 60:02d}:{20 * i % 60:02d}Z", MOVING, s, x, 0.0, v, 20)
                for i, (s, x, v) in enumerate(day1)]
    expected += [(f"2024-01-15T00:{(600 + 20 * i) // 60:02d}:{20 * i % 60:02d}Z", STAYING, "A02", 75.0, 0.0, 47.0, 1)
                 for i in range(22)]
    expected += [("2024-01-16T00:00:00Z", MOVING, "A01", 0.0, 0.0, 740.0, 20),
                 ("2024-01-16T00:00:20Z", MOVING, "A02", 75.0, 0.0, 740.0, 20)]
    assert rows == sorted(expected)


def test_count_rows(run):
    assert all(r[2] == 1 for r in run[4]["count"])
    assert {r[:2] for r in run[4]["count"]} == {(r[0], r[2]) for r in run[4]["location"]}


def test_track_rows(run):
    assert sorted(run[4]["track_trajectories"]) == [
        (MOVING, 1, "2024-01-15T00:00:00Z", "2024-01-15T00:02:20Z", 140, 8, "A01", "A02", 1),
        (MOVING, 2, "2024-01-16T00:00:00Z", "2024-01-16T00:00:20Z", 20, 2, "A01", "A02", 1),
        (STAYING, 1, "2024-01-15T00:10:00Z", "2024-01-15T00:17:00Z", 420, 22, "A02", "A02", 0)]
    assert run[4]["track_od"] == [("A01", "A02", 2, 1)]


def test_revisit_rows(run):
    assert sorted(run[4]["revisits"]) == [
        (MOVING, 2, 2, "2024-01-15;2024-01-16", "2024-01-15", "2024-01-16", "Multi-day observed"),
        (STAYING, 1, 1, "2024-01-15", "2024-01-15", "2024-01-15", "Single-day observed")]


def test_activity_rows(run):
    assert sorted(run[4]["activities"]) == [
        (MOVING, 1, 1, 1, "2024-01-15T00:00:00Z", "2024-01-15T00:02:20Z", 140, 8, "A01", 2, 0, "Pass-through"),
        (STAYING, 1, 1, 1, "2024-01-15T00:10:00Z", "2024-01-15T00:17:00Z", 420, 22, "A02", 1, 1, "Short stay")]


def test_contracts(run):
    packets, seconds, cleaned, t20, _ = run
    quality.require_types(t20, schemas.TWENTY_SECOND)
    quality.require_types(seconds.select(*schemas.ONE_SECOND.names), schemas.ONE_SECOND)
    quality.require(quality.twenty_second_violations(t20), "20 s table")
    quality.require(quality.duplicate_keys(t20), "20 s key")
    quality.require(quality.rebuild_differences(cleaned, t20), "rebuild")
    text = packets.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    quality.require(quality.packet_violations(text), "packets")
    with pytest.raises(quality.ContractError):
        quality.require(quality.packet_violations(text.withColumn("channel", F.lit(15))), "packets")
    with pytest.raises(quality.ContractError):
        quality.require_columns(text.select("type", "timestamp"), ["timestamp", "type"])
