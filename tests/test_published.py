"""Tables replaced as a whole, checks in the writing pass, the ledger of files, and distinct counts by bitmaps."""

import pytest
from helpers import located
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from waymark.functions import bitmaps
from waymark.operators import disclosure, release
from waymark.operators.quality import ContractError
from waymark.sources import published, tables
from waymark.streaming import ledger


def table(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("v"), "id").alias("v"))


def failing(spark, at):
    return table(spark, 1000).repartition(8).withColumn("v", F.when(F.col("id") == at, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))


def test_a_version_appears_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(PySparkException):
        published.publish(failing(spark, 5), path)
    assert published.Files(spark, path).names(path) == []
    published.publish(table(spark, 10), path)
    first = published.read_published(spark, path)
    for bad in (failing(spark, 999), table(spark, 20).withColumn("v", F.when(F.col("id") != 7, F.col("v")))):
        with pytest.raises((PySparkException, ContractError)):
            published.publish(bad, path, published.required(["id", "v"]))
        assert published.read_published(spark, path).count() == 10
    # What a killed writer leaves, a version without a manifest and a manifest never renamed, changes nothing.
    table(spark, 3).write.parquet(f"{path}/v-killed")
    published.Files(spark, path).write_text(f"{path}/_current-v-killed", "{")
    assert published.publish(table(spark, 20), path, published.required(["id", "v"]))["rows"] == 20
    assert published.read_published(spark, path).count() == 20 and first.count() == 10       # a reader that has begun goes on
    published.publish(table(spark, 30), path)
    versions = [n for n in published.Files(spark, path).names(path) if n.startswith("v-")]
    assert len(versions) == 3 and "v-killed" in versions and published.current(spark, path)["rows"] == 30


def test_plain_tables_survive_a_failing_overwrite(spark, tmp_path):
    path = str(tmp_path / "plain")
    tables.write_table(table(spark, 10), path)
    with pytest.raises(PySparkException):
        tables.write_table(failing(spark, 3), path)
    assert spark.read.parquet(path).count() == 10
    tables.write_table(table(spark, 4), path)
    assert spark.read.parquet(path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["plain"]


def test_rules_see_rows_that_a_later_filter_drops_in_one_scan(spark, tmp_path):
    path = str(tmp_path / "in")
    table(spark, 100).withColumn("n", F.when(F.col("id") != 50, F.col("id"))).write.parquet(path)
    rows, watch = published.observed(spark.read.parquet(path), published.required(["n", "v"]))
    kept = rows.filter("n >= 90")
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    with pytest.raises(ContractError, match="1 rows break 'n is null'"):
        published.publish(kept, str(tmp_path / "out"), watches=[watch])
    assert not published.Files(spark, path).exists(str(tmp_path / "out" / "_current"))


def test_ledger_after_a_killed_run(spark, tmp_path):
    source, out, book, done = (str(tmp_path / n) for n in ("in", "out", "book", "done"))
    table(spark, 100).repartition(5).write.parquet(source)
    schema, tries = table(spark, 0).schema, []

    def keep(rows):
        return rows.filter("id % 2 = 0")

    def killed(rows):
        tries.append(1)
        if len(tries) == 2:
            keep(rows).write.parquet(f"{out}/batch=1")
            raise RuntimeError("killed")
        return keep(rows)

    def run(rule):
        ledger.extract(ledger.captures(spark, source, schema, files_per_batch=2), rule, out, book, done)

    with pytest.raises(StreamingQueryException):
        run(killed)
    assert ledger.entries(spark, book).count() == 2
    assert ledger.extracted(spark, out, book).count() == ledger.entries(spark, book).agg(F.sum("kept")).first()[0]
    run(keep)
    table(spark, 7).coalesce(1).write.mode("append").parquet(source)
    run(keep)
    run(keep)
    entries = ledger.entries(spark, book)
    assert entries.count() == entries.select("file").distinct().count() == 6
    assert tuple(entries.agg(F.sum("rows"), F.sum("kept")).first()) == (107, 54)
    assert ledger.extracted(spark, out, book).count() == 54 and entries.filter("bytes > 0").count() == 6


def test_bitmaps_merge_over_days_and_runs(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 3 AS day", "concat('d', id * 7919 % 701) AS device")
    first = tables.stager(spark, "bitmaps-1")(bitmaps.numbered(rows.filter("day = 0").select("device")), "d")
    more = tables.stager(spark, "bitmaps-2")(bitmaps.numbered(bitmaps.unknown(rows.select("device"), first), run=1), "d")
    known = first.unionByName(more)
    assert known.select("number").distinct().count() == known.count() == 701
    maps = bitmaps.bitmaps(rows.distinct(), known, ["day"], "device")
    expected = {r.day: r.n for r in rows.groupBy("day").agg(F.countDistinct("device").alias("n")).collect()}
    assert {r.day: r.n for r in bitmaps.counted(maps, ["day"], "n").collect()} == expected
    assert bitmaps.counted(maps, [], "n").first().n == 701
    words = rows.withColumn("number", F.expr("cast(substr(device, 2) AS int)")).groupBy("day").agg(
        *bitmaps.word_sets(F.col("number"), bitmaps.words_of(701), "w"))
    assert {r[0]: r[1] for r in words.select("day", bitmaps.word_count(11, "w")).collect()} == expected


def test_no_row_is_copied_for_a_distinct_count(spark):
    t20 = located(spark, [(t, f"id{t // 20 % 5}", f"s{t // 20 % 3}", 0.0, 0.0) for t in range(0, 4000, 20)]).withColumns(
        {"rssi_sum": F.lit(-50.0), "rssi_median": F.lit(-50.0)})
    for df in (tables.dataset_manifest(t20, "x"), release.dataset_overview(t20), disclosure.identifier_profile(t20, "s0"),
               disclosure.disclosure_indicators(t20, "x", "s0")):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
    got = tables.dataset_manifest(t20, "x").first()
    assert (got.n_records, got.n_devices, got.n_sensors) == (200, 5, 3)
    assert tables.dataset_manifest(t20.limit(0), "x").first().n_devices == 0
    assert release.dataset_overview(t20).first().device_windows == 200
