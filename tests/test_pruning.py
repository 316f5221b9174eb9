"""Folders pruned at run time, and the content scan's literal prefilter against its patterns alone."""

import re

from helpers import located
from pyspark.sql import functions as F

from waymark.operators import cleaning, filters, scan, track
from waymark.sources import tables


def files_read(df):
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        for name in ("initialPlan", "executedPlan"):
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" and name == "executedPlan":
                nodes.append(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found.append((node.metadata().get("PartitionFilters").get(), node.metrics().get("numFiles").get().value()))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_dates_prune_folders_at_run_time(spark, tmp_path):
    rows = located(spark, [(d * 86400 + 600, f"id{k}", "s0", 0.0, 0.0) for d in range(20) for k in range(5)])
    path = str(tmp_path / "by-date")
    tables.write_by_date(rows.withColumn("local_date", F.to_date("timestamp")), path)
    days = tables.day_table(spark, str(tmp_path / "days"), rows.groupBy(F.to_date("timestamp").alias("local_date")).agg(
        (F.count("*") * 0 + F.dayofyear(F.first("timestamp"))).alias("n")))
    whole = spark.read.parquet(path)
    kept = filters.keep_folders(whole, days.filter("n >= 33"))
    assert kept.count() == 10 and kept.columns[0] == "local_date"
    scans = [(f, n) for f, n in files_read(kept) if "local_date" in f]
    assert len(scans) == 1 and "dynamicpruning" in scans[0][0] and scans[0][1] == 2
    assert [n for f, n in files_read(filters.keep_folders(whole, days)) if "local_date" in f] in ([20], [])


def test_prefilter_loses_nothing(spark):
    texts = ["", None, "aa:bb:cc:dd:ee:ff", "AA-BB-CC-dd-ee-ff.", "aa:bb:cc:dd:ee:ff0", "1a:2b", "-----begin RSA PRIVATE KEY-----", "AKIA" + "A1" * 8,
             "akia" + "a1" * 8, "GHP_" + "a" * 20, "github_pat_" + "b" * 25, "gho" + "c" * 30, "AIza" + "d" * 35, "xoxb-" + "e" * 20, "https://u:passw@h",
             "http://user@host", "API-Key = '" + "f" * 32 + "'", "password:" + "g" * 24, "my_password=" + "h" * 30, "release.key", "a KEY_FILE b", "the Mapping_Path", "BSSID", "ssid",
             "token" * 3, "PassWD = " + "0" * 40, "secretkey=" + "x/" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, _text string").withColumn("_low", F.lit("x")).drop("_low")
    got = {(r.k, r.finding) for r in scan.content_findings(df, "k", "_text").collect()}
    expected = set()
    for k, text in enumerate(texts):
        for name, words in scan.MARKERS.items():
            if any(w in (text or "").lower() for w in words):
                expected.add((k, name))
        for name, pattern in scan.PATTERNS.items():
            if re.search(pattern, text or ""):
                expected.add((k, name))
    assert got == expected and len({f for _, f in got}) == 11
    assert sum(r.n_texts for r in scan.content_scan(df, "k", "_text").collect()) == len(expected)


def test_rows_in_buckets_are_not_exchanged(spark, tmp_path):
    rows = located(spark, [(t, f"id{k}", f"s{t // 4000 % 3}", 0.0, 0.0) for k in range(9) for t in range(0, 200_000, 700 + 100 * k)])
    table = tables.write_by_identifier_day(rows, "by_identifier_day", str(tmp_path / "buckets"), 8)
    got, plain = track.split_trajectories(table, 1800), track.split_trajectories(rows, 1800)
    assert sorted(map(tuple, got.drop("utc_day").collect())) == sorted(map(tuple, plain.collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for make in (lambda r: track.split_trajectories(r, 1800), cleaning.sessions):
            exchanged = 0
            plan = make(spark.table("by_identifier_day"))._jdf.queryExecution().executedPlan().toString()
            # Every exchange lies above an aggregate: what moves are summaries.
            for line, below in zip(plan.splitlines(), [plan.splitlines()[i + 1:] for i in range(len(plan.splitlines()))]):
                if "Exchange" in line:
                    depth = len(line) - len(line.lstrip(" :+-"))
                    inner = []
                    for x in below:
                        if len(x) - len(x.lstrip(" :+-")) <= depth:
                            break
                        inner.append(x)
                    exchanged += 1
                    assert any("Aggregate" in x for x in inner), line
            assert exchanged >= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE by_identifier_day")
