"""Near duplicates against all pairs of sets, the sketch against its probabilities, and SQL."""

import random

import numpy as np
import pytest

import check
from waymark.llm import jaccard, setsketch
from waymark.llm.setsketch import ByteWords, Similar, Sketcher


def words_set(text):
    words, out = [], []
    for c in text or "":
        if c in " \t\n\v\f\r":
            words.append("")
        else:
            words = words or [""]
            words[-1] += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    words = [w for w in words if w]
    if 0 < len(words) < 5:
        out = [tuple(words)]
    return set(out) | {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(doc_id, n, component, kept) rows by comparing all sets."""
    sets = [words_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                label[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), least, least is None or doc_id == least))
    return sorted(out, key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
    return words


def corpus():
    rng = random.Random(3)
    texts = []
    for family in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 20, 60, 300, 700]))]
        texts += [" ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 3, 5]))) for _ in range(14)]
    chain = [f"c{k}" for k in range(400)]                       # each is near the next only
    texts += [" ".join(chain[k * 12:k * 12 + 200]) for k in range(12)]
    texts += ["One two", "one  TWO", "one two", "É e", "é e", None, "", " \t\n", "a b c d e", "A B\u000bC\fD E", "a b c d e a b c d e"]
    texts += ["same words here to be found again"] * 40
    rows = list(enumerate(texts))
    rows += [(None, texts[0]), (None, "alone without an id and nothing near it"), (None, None), (3, texts[40]), (3, texts[41]), rows[50], rows[50]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 5])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, node int, key string").repartition(6)
    got = setsketch.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert setsketch.near_duplicates(df.limit(0)).count() == 0


def test_links_between_members_that_no_leader_holds(spark, monkeypatch):
    """With stars of no use (no link survives), the rest finds every link."""
    monkeypatch.setattr(setsketch, "star_links", lambda docs, nodes, met: docs.sparkSession.createDataFrame([], "a long, b long"))
    rows = corpus()[:120]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    sketcher, similar = Sketcher(), Similar()
    grams = rng.integers(1 << 63, size=9000, dtype=np.uint64)
    whole = sketcher.registers(grams)
    assert (np.maximum(sketcher.registers(grams[:5000]), sketcher.registers(grams[4000:])) == whole).all()
    for wanted in (0.5, 0.85, 0.95):
        errors, equal = [], []
        for _ in range(40):
            common = int(wanted * 1000)
            pool = rng.integers(1 << 63, size=2000 - common, dtype=np.uint64)
            a, b = pool[:1000 - (1000 - common) // 2], pool[(1000 - common) // 2:][:1000]
            n, m = len(a), len(b)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            r, s = sketcher.registers(a).astype(int), sketcher.registers(b).astype(int)
            found = similar.estimate([n], [m], [(r > s).sum()], [(r < s).sum()])[0]
            errors.append(found - true)
            equal.append((r == s).mean() - setsketch.alike(true))
            if true >= 0.85:
                assert similar.likely([n], [m], [(r > s).sum()], [(r < s).sum()])[0]
        assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.05 and abs(np.mean(equal)) < 0.02
    assert not similar.likely([1000], [1000], [90], [90])[0] and not similar.likely([1000], [840], [0], [0])[0]


def test_band_plan_meets_its_recall():
    bands, rows = setsketch.band_plan()
    miss = (1 - setsketch.alike(0.85) ** rows) ** bands
    assert miss < 1 - setsketch.RECALL + 1e-12 and bands * rows <= setsketch.REGISTERS


def test_very_long_text_and_a_bounded_memory_of_words():
    known = ByteWords()
    text = " ".join(f"word{k}" for k in range(200_000)).encode()
    assert len(setsketch.gram_set(text, known)) == 200_000 - 4
    assert known.held <= setsketch.WORD_BYTES


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    text, _, ok = check.compare(spark, check.database(sf), sf, "op12_setsketch_duplicates")
    assert ok, text


def test_a_node_meets_its_registers_once(spark):
    """Whatever the number of its bands, so that members of large groups are not multiplied by a join."""
    nodes = spark.createDataFrame([(i, bytearray([i] * 4)) for i in range(6)], "node long, registers binary")
    rows = spark.createDataFrame([(b, i, 0, 9, 1) for b in range(40) for i in range(6)], "band long, node long, label long, n long, blocks int")
    got = setsketch._with_registers(rows, nodes)
    plain = rows.join(nodes, "node").select(got.columns)
    assert got.count() == 240 and got.exceptAll(plain).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join Inner") < plan.index("Aggregate")


def test_a_settled_group_meets_the_rest_only(spark, monkeypatch):
    """A bucket of one large component and a few others makes rows in proportion to its size, and all pairs between components
    meet once (43 members in 9 blocks made 387 rows before)."""
    monkeypatch.setattr(setsketch, "BLOCK", 5)
    nodes = spark.createDataFrame([(i, bytearray([i] * 4)) for i in range(43)], "node long, registers binary")
    met = spark.createDataFrame([(128, i, 9) for i in range(43)], "band long, node long, n long")
    labels = spark.createDataFrame([(i, 0) for i in range(40)], "node long, label long")
    rows = setsketch.open_blocks(nodes, met, labels, "test").collect()
    assert len(rows) == 40 + 3 * 9
    groups = {}
    for r in rows:
        groups.setdefault((r["x"], r["y"]), []).append(r)
    pairs = []
    for part in groups.values():
        facing = setsketch._facing(np.array([r["side"] for r in part]), np.array([r["label"] for r in part]))
        pairs += [tuple(sorted((part[i]["node"], part[j]["node"]))) for i, j in zip(*np.nonzero(facing))]
    assert sorted(pairs) == [(a, b) for a in range(43) for b in range(max(40, a + 1), 43)]


def test_the_leader_is_near_to_most(spark):
    """Edited copies share bands with their source; the source leads their buckets, whatever its number."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(edited(rng, base, 2)) for _ in range(60)] + [" ".join(base)]
    nodes = setsketch.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumnRenamed("doc_id", "node")
    met = setsketch.buckets(nodes).collect()
    held = {r["band"] for r in met if r["node"] == 60}
    assert held and all(r["leader"] == 60 for r in met if r["band"] in held)


def test_only_filters_of_a_fixed_size_are_broadcast(spark, monkeypatch):
    """Tables that grow with the texts went through the driver as long as their files were small, salted ones eight times."""
    plans, staged = [], setsketch.staged

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(setsketch, "staged", kept)
    monkeypatch.setattr(jaccard, "staged", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        out = setsketch.near_duplicates(spark.createDataFrame(corpus(), "doc_id long, text string"))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(plans) > 15 and all("__chunk" in line for line in joins)
