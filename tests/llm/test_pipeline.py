"""The pipeline on the smallest tables, and the queries with SQL against it."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from waymark.llm import decontaminate, pii, quality, textops

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near duplicates", "benchmark decontamination", "personal data", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:5] == docs.columns and 0 < out.count() < docs.count()
    assert out.filter(r"text RLIKE '@mail[0-9]'").isEmpty()
    assert out.groupBy("doc_id").count().filter("count > 1").isEmpty()


def test_pipeline_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_only_contaminated_rows_go_under_null_and_repeated_ids(spark, tmp_path):
    item = " ".join(f"word{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(None, "one clean text"), (None, None), (7, "another clean text"), (7, None), (8, "one clean text")]
    docs = spark.createDataFrame(
        clean + [(None, f"before {item} after"), (7, f"{item} after"), (9, item)], "doc_id long, text string")
    got = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(clean, key=repr) and got.columns == docs.columns


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_every_stage_against_brute_force(spark, tmp_path):
    """All five stages on the whole small table, each on what the one before kept, next to plain Python or SQL."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    stages = dict(corpus_pipeline.STAGES)

    def run(name, rows):
        return textops.staged(stages[name](spark, rows, SF), "brute")

    rows = docs.collect()
    scores = quality.predict([r.text for r in rows], quality.train(docs, labels))
    good = run("quality classifier", docs)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r, s in zip(rows, scores) if s >= quality.THRESHOLD}

    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    sets, head = [shingle_set(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    single = run("near duplicates", good)
    assert {r.doc_id for r in single.collect()} == {rows[i].doc_id for i in range(len(rows)) if find(i) == i}

    rows, cache = single.collect(), decontaminate.CoreHash()
    own = [decontaminate.word_hashes(r.text, cache) for r in rows]
    gone = set()
    for item in items:
        words = decontaminate.word_hashes(item.text, cache)
        if len(words) >= decontaminate.SEED:
            near = [i for i, w in enumerate(own) if len(w) and len(np.intersect1d(w, words)) >= len(set(words.tolist())) / 3]
            for i in near:      # fewer common words cannot reach half of the item
                best = decontaminate.smith_waterman([words], [own[i]])[0]
                if best / (decontaminate.MATCH * len(words)) >= decontaminate.SCORE:
                    gone.add(rows[i].doc_id)
    clean = run("benchmark decontamination", single)
    assert {r.doc_id for r in rows} - {r.doc_id for r in clean.collect()} == gone

    rows = {r.doc_id: r for r in clean.collect()}
    model = pii.train(pii.labelled_table(clean))
    masked = run("personal data", clean)
    for r in masked.collect():
        before = rows[r.doc_id].text
        (_, spans), = pii._spans([before], model)
        assert r.text == pii.masked(before, spans) and r.n_chars == len(r.text)

    masked.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.execute(f"SELECT doc_id, domain, tokens, epochs FROM ({entry.oracle_sql()['op5_source_mixing']})").fetchall()
    got = run("mixing", masked).select("doc_id", "mix_domain", "mix_tokens", "mix_epochs").collect()
    assert sorted(map(tuple, got)) == sorted(expected) and got


@pytest.mark.parametrize("name", ["op3_chat_formatting", "op5_source_mixing", "op8_warc_records"])
def test_sql(spark, name):
    text, _, ok = check.compare(spark, check.database(SF), SF, name)
    assert ok, text


def test_all_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
