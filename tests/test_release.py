"""Pseudonyms, release differences, content scan."""

import hashlib
import hmac

import pytest
from helpers import BASE
from pyspark.sql import functions as F

from waymark.functions import identifiers
from waymark.operators import disclosure, quality, release, scan

KEY = b"01234567890123456789012345678901"
DOMAIN = b"test/domain/v1"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def t20(spark, data):
    return spark.createDataFrame(data, "w long, source_address string, sensor_name string, m double").select(
        F.timestamp_seconds(F.col("w") + BASE).alias("timestamp"), "source_address", "sensor_name",
        F.col("m").alias("rssi_median"), F.col("m").alias("rssi_sum"), F.lit(1).cast("long").alias("detections"),
        (F.col("m") + 100).alias("strength_sum"))


def test_release_pseudonym_is_hmac(spark):
    ids = spark.createDataFrame([("abcdef0123456789",), ("0123456789abcdef",)], "source_address string")
    mapping = dict(rows(release.build_mapping(ids, "set-a", KEY, DOMAIN), "internal", "public"))
    for name, public in mapping.items():
        message = DOMAIN + b"\0set-a\0" + name.encode()
        assert public == hmac.new(KEY, message, hashlib.sha256).hexdigest()[:32]
    assert release.mapping_collisions(release.build_mapping(ids, "set-a", KEY, DOMAIN)).count() == 0


def test_key_is_in_no_plan(spark):
    ids = spark.createDataFrame([("a" * 16,)], "source_address string")
    df = release.rewrite_ids(ids, release.build_mapping(ids, "d", KEY, DOMAIN))
    plan = df._jdf.queryExecution().toString()
    for secret in (KEY.decode(), KEY.hex(), DOMAIN.decode()):
        assert secret not in plan
    with pytest.raises(ValueError):
        release.build_mapping(ids, "d", b"short", DOMAIN)


def test_capture_pseudonyms_read_flag_first(spark):
    raw = spark.createDataFrame([(a,) for a in (
        "AA:BB:CC:DD:EE:FF", "a8-bb-cc-dd-ee-ff", "a8:bb:cc:dd:ee:ff", "00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff",
        "01:00:5e:00:00:01", "bad")], "source_address string")
    got = rows(release.capture_pseudonyms(raw, "site", KEY, DOMAIN), "address", "randomized", "identifier")
    assert [r[:2] for r in got] == [("a8:bb:cc:dd:ee:ff", 0), ("aa:bb:cc:dd:ee:ff", 1)]
    message = DOMAIN + b"\x00\x04site\x00a8:bb:cc:dd:ee:ff"
    assert got[0][2] == hmac.new(KEY, message, hashlib.sha256).hexdigest()[:32]


def test_legacy_hash_vector(spark):
    df = spark.createDataFrame([(" AA:BB:CC:DD:EE:FF ",)], "a string")
    assert rows(df.select(identifiers.legacy_identifier("a").alias("h")), "h") == [("c1582e87c8022218",)]


def test_rekey_keeps_blanks_and_other_columns(spark):
    df = spark.createDataFrame([(1, "AbC", " "), (2, "abc ", None), (3, "x", "y")],
                               "n int, source_address string, mac_address string")
    got = release.rekey(df, "scope", KEY, DOMAIN)
    expected = hmac.new(KEY, DOMAIN + b"scope\0abc", hashlib.sha256).hexdigest()[:32]
    out = rows(got, "n", "source_address", "mac_address")
    assert out[0] == (1, expected, "") and out[1] == (2, expected, "")
    assert len(out[2][1]) == 32 and len(out[2][2]) == 32
    assert {r[0] for r in rows(release.already_public(got), "column")} == {"source_address", "mac_address"}


@pytest.mark.parametrize("value", [None, "", "NOT-HEX", "abc"])
def test_mapping_refuses_other_forms(spark, value):
    ids = spark.createDataFrame([("a" * 16,), (value,)], "source_address string")
    mapping = release.build_mapping(ids, "d", KEY, DOMAIN)
    with pytest.raises(Exception, match="accepted form"):
        mapping.collect()
    with pytest.raises(Exception, match="accepted form"):
        release.rewrite_ids(ids, mapping).collect()


def test_rewrite_refuses_rows_without_pseudonym(spark):
    mapping = release.build_mapping(
        spark.createDataFrame([("a" * 16,)], "source_address string"), "d", KEY, DOMAIN)
    for stray in (None, "b" * 16):
        table = spark.createDataFrame([("a" * 16,), (stray,)], "source_address string")
        with pytest.raises(Exception, match="without a pseudonym"):
            release.rewrite_ids(table, mapping).collect()


def test_colliding_pseudonyms_are_refused(spark):
    mapping = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "internal string, public string")
    with pytest.raises(Exception, match="share a pseudonym"):
        release._injective(mapping, "internal", "public").collect()


def test_rekey_refuses_pseudonyms(spark):
    df = spark.createDataFrame([("aa:bb:cc:dd:ee:0f",), ("0" * 32,)], "source_address string")
    with pytest.raises(Exception, match="pseudonyms already"):
        release.rekey(df, "scope", KEY, DOMAIN).collect()


def test_row_and_location_impact(spark):
    a = t20(spark, [(0, "i", "A", -50.0), (20, "i", "A", -50.0), (40, "i", "A", -50.0)])
    b = t20(spark, [(0, "i", "A", -50.0), (20, "i", "A", -51.0), (20, "i", "B", -40.0), (60, "j", "A", -1.0)])
    r = release.row_impact(a, b).first()
    assert (r.current_rows, r.candidate_rows, r.matched_keys, r.candidate_only_keys, r.current_only_keys) == (3, 4, 2, 2, 1)
    assert (r.matched_rows_with_changed_values, r.rows_changed_detections, r.fully_unchanged_rows,
            r.changed_union_rows) == (1, 0, 1, 4)
    n = release.location_impact(a, b).first()
    assert (n.same_location_assignments, n.changed_location_assignments,
            n.candidate_only_device_windows, n.current_only_device_windows) == (1, 1, 1, 1)
    d = release.period_diff_summary(release.period_diff(a, b, "day"), "day").first()
    assert d.periods == 1 and d.max_abs_device_difference == 1


def test_table_differences(spark):
    a = t20(spark, [(0, "i", "A", -50.0), (20, "i", "A", -50.0)])
    b = t20(spark, [(0, "i", "A", -50.0 + 1e-12), (20, "i", "A", -49.0), (40, "i", "A", -50.0)])
    got = quality.table_differences(a, b, ["timestamp", "source_address", "sensor_name"], ["rssi_median"])
    assert rows(got, "difference") == [("changed",), ("right_only",)]


def test_daily_sequence_orders_by_first_sight(spark):
    df = t20(spark, [(0, "i", "B", -50.0), (20, "i", "A", -50.0), (40, "i", "B", -50.0), (20, "i", "C", -50.0)])
    assert rows(disclosure.daily_sequence(df), "sensor_sequence", "sensors_visited") == [("B>A>C", 3)]


def test_scan_reports_classes_and_never_values(spark):
    address, token = "aa:bb:cc:dd:ee:" + "0f", "ghp_" + "a1b2c3d4" * 4
    secret = "release" + "_key = '" + "ab" * 20 + "'"
    texts = spark.createDataFrame([
        (1, f"see internal_source_address and {address}."), (2, f"x {token}"), (3, secret), (4, "a" + address + "0"),
        (5, "z " * 50000 + address)], "id int, text string")
    found = scan.content_findings(texts, "id", "text")
    assert rows(found, "id", "finding") == [
        (1, "MAC-like value"), (1, "private identifier-mapping field"), (2, "GitHub access token"),
        (3, "assigned credential or key material"), (5, "MAC-like value")]
    assert address not in repr(found.collect())


def test_stage_is_written_once_and_again_when_cleared(spark):
    from waymark.sources import tables
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    for _ in range(2):
        assert tables.staged_once(spark, "test", "numbers", build).count() == 5
    assert built == [1]
    key = (spark.sparkContext.applicationId, "test", "numbers")
    tables._stages[key] = (tables._stages[key][0] + "-cleared", tables._stages[key][1])
    assert tables.staged_once(spark, "test", "numbers", build).count() == 5
    assert built == [1, 1]
