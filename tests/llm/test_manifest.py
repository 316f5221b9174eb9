"""The manifest against a tree in plain Python, for ragged groups of every size, and against SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import check
from waymark.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path_of(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        first = i - i % fanout
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + fanout])))
        i //= fanout
    return out


def brute(rows, fanout=2):
    groups = {}
    for row in rows:
        groups.setdefault("" if row[2] is None else "=" + row[2], []).append(row)
    names = sorted(groups, key=str.encode)
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [tree([leaf_of(r) for r in groups[n]], fanout) for n in names]
    top = tree([t[-1][0] for t in trees], fanout)
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            path = path_of(trees[k], i, fanout) + path_of(top, k, fanout)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = leaf_of((*row[:3], row[3] + 1, row[4])) if hit else leaf_of(row)
            for left, right in path:
                node = h(left + node + right)
            out.append((row[0], leaf_of(row), trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(sizes):
    rows, at = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((at, f"s{at % 3}" if at % 5 else None, lang, at if at % 4 else None, f"tëxt {at}" if at % 6 else None))
            at += 1
    return rows


@pytest.mark.parametrize("segment", [2, 4, 4096])
def test_ragged_groups_against_brute_force(spark, segment):
    sizes = {None: 1, "": 2, "a": 3, "b": 4, "c": 5, "d": 9, "e": 17, "é": 33, "z": 40, "Z": 70}
    rows = rows_of(sizes)
    rows += [(None, None, None, None, None), (None, "x", "a", 1, ""), (None, "x", "a", 1, "")] + rows[20:24]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", leaf string, seg int").repartition(7)
    got = manifest.digest(df, segment)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == brute(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("fanout", [3, 5])
def test_paths_of_other_fanouts(spark, fanout):
    rows = rows_of({"a": 60, "b": 7, "c": 1, "d": 26})
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout, segment=fanout)
    got = got.withColumn("ok", manifest.folded(F.col("leaf"), F.col("path")) == F.col("root"))
    found = sorted([(r.doc_id, r.leaf, r.subroot, r.root, h("".join(p.left + p.right for p in r.path))) for r in got.collect()], key=repr)
    assert found == sorted([r[:5] for r in brute(rows, fanout)], key=repr) and got.filter("NOT ok").isEmpty()


def test_many_groups_one_row_and_no_row(spark):
    rows = rows_of({f"l{k}": 1 for k in range(50)})
    assert sorted(map(tuple, manifest.digest(spark.createDataFrame(rows, SCHEMA), 4).collect()), key=repr) == brute(rows)
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert [tuple(r) for r in manifest.digest(one).collect()] == brute(rows[:1])
    assert manifest.digest(one.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    text, _, ok = check.compare(spark, check.database(sf), sf, "op13_merkle_manifest")
    assert ok, text
