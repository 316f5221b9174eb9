"""Operator 7, n-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Texts are lower-cased words; equal word lists are copies, and only one of them goes on. Two lists are linked if the
sets of their runs of ``WORDS`` words have a Jaccard similarity of at least ``THRESHOLD``. The numbers of bands and rows
are the ones with the most rows that still meet ``RECALL`` for pairs at the threshold, within ``HASHES`` hash functions.

1. One pass gives each text its key (a hash of its words) and a hash for each band.
2. Band hashes are shuffled. Lists that share a band hash belong to one candidate component, found
   by passing minima between lists and bands until nothing changes; no pairs are formed.
3. A component is cut into blocks of about ``BLOCK`` lists, and every pair of its blocks is verified on the full
   sets by one matrix product. A task holds two blocks. What leaves it is a row for each list: the number of its
   links, and the least list of its part of the component. So no list of pairs ever exists, and a group of thousands of near
   copies is spread over many tasks with all its links counted.
4. The parts of a component are joined to classes as in step 2.

Defined cases: null and empty texts are copies of one another; a text of fewer words than ``WORDS`` has one
n-gram, all its words; repeated rows are copies; a null id takes part and gets its class; an empty table gives no
rows; further columns are ignored, and kept by ``without_near_copies``.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.textops import WordHash, shingles, staged, tidy, with_hit, with_made, without

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
HASHES = 256
BLOCK = 192
SALTS = 8


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple:
    """(bands, rows): the most rows a band for which pairs at the threshold share a band with the wanted recall."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-threshold ** rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("the recall needs more hash functions")
    return best


def words_of(text: str) -> list:
    return (text or "").lower().split()


def key_of(words: list) -> bytes:
    return xxhash.xxh3_128_digest("\n".join(words).encode("utf-8", "surrogatepass"))


def _gram_set(words: list, cache: WordHash) -> np.ndarray:
    return np.unique(shingles(cache.of(words), WORDS))


def signatures(docs: DataFrame, threshold: float = THRESHOLD, seed: int = 11) -> DataFrame:
    """doc_id, key, bands: one hash for each band; no bands for a text without words."""
    bands, rows = band_plan(threshold)
    rng = np.random.default_rng(seed)
    factor = rng.integers(1 << 31, size=bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offset = rng.integers(1 << 32, size=bands * rows, dtype=np.uint32)
    band_seed = rng.integers(1 << 62, size=bands, dtype=np.uint64)

    def minima(grams):
        """Minimum of each hash function, over pieces so that long texts need no large array."""
        low = np.full(len(factor), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(grams), 2048):
            x = (grams[a:a + 2048] >> np.uint64(32)).astype(np.uint32)
            low = np.minimum(low, (factor[:, None] * x[None, :] + offset[:, None]).min(axis=1))
        return low.reshape(bands, rows).astype(np.uint64)

    def hashed(low):
        total = band_seed.copy()
        for r in range(rows):
            total = (total ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        return total.view(np.int64)

    def read(batches):
        cache = WordHash()
        for batch in batches:
            keys, found = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                keys.append(key_of(words))
                found.append(hashed(minima(shingles(cache.of(words), WORDS))) if words else np.zeros(0, np.int64))
            sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(values))],
                ["doc_id", "key", "bands"])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, key binary, bands array<long>")


def components(edges: DataFrame, small=lambda rows: rows) -> DataFrame:
    """node, label of the (node, band) graph: nodes that share a band, directly or in steps, get one label, their least node.

    Minima go from nodes to bands and back until no label changes; minima are combined before each shuffle, and
    each round is written, so lost executors cost one round at most. ``small`` may say how the smaller sides of joins are moved.
    """
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    low, labels = edges.groupBy("band").agg(F.min("node").alias("low")), None
    while True:
        # A band may hold a third of all nodes: its minimum goes to every salt.
        spread = low.select("band", "low", salts)
        moved = edges.join(small(spread), ["band", "salt"]).groupBy("node").agg(F.min("low").alias("label"))
        # Labels are nodes themselves, so a node may go on to the label of its label at once.
        # Nodes that are their own label cannot take anyone further; a label of many nodes is spread over salts.
        ahead = moved.filter("label < node").select(F.col("node").alias("label"), F.col("label").alias("further"), salts)
        salted = moved.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        now = staged(salted.join(small(ahead), ["label", "salt"], "left").select(
            "node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if labels is not None and now.join(small(labels), ["node", "label"], "left_anti").isEmpty():
            return now
        labels = now
        low = edges.join(small(labels), "node").groupBy("band").agg(F.min("label").alias("low"))


def _verified(rows: list, threshold: float):
    """Links and least connected node of the lists of two blocks, or of one with itself."""
    nodes, copies, sides = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows])
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    column = column[place]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, len(shared), 8192):
        low, high = np.searchsorted(column, [a, a + 8192])
        x = np.zeros((len(sets), min(8192, len(shared) - a)), np.float32)
        x[owner[low:high], column[low:high] - a] = 1
        common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    if sides[0] != sides[-1] or len(set(sides.tolist())) > 1:
        linked &= sides[:, None] != sides[None, :]
    links = (linked * copies[None, :]).sum(1)
    head = np.full(len(sets), -1)
    for i in sorted(range(len(sets)), key=nodes.__getitem__):
        if head[i] < 0:
            head[i], todo = i, [i]
            while todo:
                more = np.flatnonzero(linked[todo.pop()] & (head < 0))
                head[more] = i
                todo += more.tolist()
    return [(k, int(n), nodes[h]) for k, n, h in zip(nodes, links, head)]


def verify(blocks: DataFrame, threshold: float) -> DataFrame:
    """``blocks``: component, a, b, node, n_copies, side, grams. Gives component, node, links, head."""
    schema = pa.schema([("component", pa.int64()), ("node", pa.int64()), ("links", pa.int64()), ("head", pa.int64())])

    def read(batches):
        group, rows, out = None, [], []

        def flush():
            nonlocal rows, out
            unique = list({r[0]: r for r in rows}.values())
            out += [(group[0], *r) for r in _verified(unique, threshold)] if unique else []
            rows = []

        for batch in batches:
            for *at, node, n, side, grams in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if at != group:
                    flush()
                    group = at
                rows.append((node, n, side, grams))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        tidy()

    return (blocks.select("component", "a", "b", "node", "n_copies", "side", "grams")
            .repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")
            .mapInArrow(read, "component long, node long, links long, head long"))


def _with_grams(texts: DataFrame) -> DataFrame:
    """_id, _key and grams of each text; equal rows of a batch once."""
    def read(batches):
        cache = WordHash()
        for batch in batches:
            found = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                at = doc_id, key_of(words)
                if at not in found:
                    found[at] = _gram_set(words, cache).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], pa.int64()), pa.array([k for _, k in found], pa.binary()),
                 pa.array(found.values(), pa.binary())], ["_id", "_key", "grams"])
        tidy()

    return texts.select("doc_id", "text").mapInArrow(read, "_id long, _key binary, grams binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, class_id (least id of the class), n_links (other documents at least ``threshold`` similar), and
    head: whether the words are those of the one list of the class that stays, the least in (id, key), null ids last."""
    rows = staged(signatures(docs, threshold), "signatures")
    lists = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.min("bands").alias("bands"))
    lists = staged(lists.withColumn("node", F.monotonically_increasing_id()), "lists")  # fixed once written
    member = lists.select("node", F.explode("bands").alias("band"))
    full = staged(member.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"), "bands")
    meeting = with_hit(member, "band", full).filter("__hit").drop("__hit")
    component = components(staged(meeting.join(full, "band"), "edges"))
    sizes = component.groupBy("label").agg(F.count("*").alias("n")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = component.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    wanted = salted.join(sizes, ["label", "salt"]).select(
        "node", F.col("label").alias("component"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    about = lists.select("node", "key", F.col("doc_id").alias("_id"), "n_copies")
    wanted = staged(wanted.join(about, "node"), "wanted")
    texts = with_hit(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", wanted.select("_id")).filter("__hit")
    # By the words as well, since null and repeated ids stand in many rows.
    texts = _with_grams(texts).join(
        wanted.withColumnRenamed("_id", "own"), F.col("_id").eqNullSafe(F.col("own")) & (F.col("_key") == F.col("key")))
    sets = texts.select("component", "blocks", "node", "n_copies", "grams").withColumn(
        "side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = (sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other")))
    found = staged(verify(blocks, threshold), "verified")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # Parts with one head are tied; each list is tied to the head of each of its parts.
    label = components(staged(found.select("node", F.col("head").alias("band")).distinct(), "ties"))
    label = label.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    least = label.join(about, "node").groupBy("label").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "key")).alias("least"))
    least = least.select("label", F.col("least._id").alias("class_id"), F.col("least.key").alias("head"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = label.join(least, ["label", "salt"]).join(links, "node").select(
        "node", "class_id", "head", "links", F.lit(True).alias("near"))
    told = about.join(near, "node", "left").filter("n_copies > 1 OR near").select(
        "key", F.coalesce("class_id", "_id").alias("class_id"),
        (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce(F.col("head") == F.col("key"), F.lit(True)).alias("head"))
    salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(SALTS)).cast("int").alias("salt")
    return rows.select("doc_id", "key", salt).join(salted, ["key", "salt"], "left").select(
        "doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("head", F.lit(True)).alias("head"))


def join(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "n_links")


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one with the least id; a class of null ids keeps one row as well."""
    found = staged(classes(docs, threshold), "rows")
    stays = F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    keep = found.filter(stays)
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    twice = staged(twice, "twice")
    copies = found.filter(~stays).select("doc_id")
    kept = without(docs, "doc_id", staged(copies.union(twice).distinct(), "gone"))
    if twice.isEmpty():
        return kept
    # Ids in several rows: there the words decide which row is meant, and one of equal rows stays. Whole rows go as one
    # struct, so that no column of theirs can clash with the names here.
    again = keep.join(twice, keep["doc_id"].eqNullSafe(twice["doc_id"]), "left_semi").select(
        F.col("doc_id").alias("id"), "key").distinct()
    some = with_hit(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"),
                                F.col("text").alias("own_text")), "own_id", twice).filter("__hit").drop("__hit")
    keyed = with_made(some, "own_text", "own", "binary", lambda texts: [key_of(words_of(t)) for t in texts])
    more = keyed.join(again, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("key")))
    return kept.unionByName(more.dropDuplicates(["id", "key"]).select("row.*"))
