"""Operator 10, benchmark decontamination: rare n-gram seeds join passages to items, then Smith-Waterman alignment.

1. One scan for all items: every run of ``SEED`` words of a text is looked up in a filter of fixed size that holds the n-grams of
   the items. Neighbouring hits make a passage: the words from an item's length before the first to one after the last. Equal
   passages are one from here on, however many documents hold them.
2. How many documents hold an n-gram is counted, for n-grams of the items only. Of every ``WINDOW`` consecutive hits of a passage
   the rarest is a seed. So each part of a passage keeps its own rarest n-grams, even where none is rare.
3. Seeds are joined with the n-grams of the items; a frequent seed is spread over salts.
4. Each pair of passage and item with at least ``HITS`` different common n-grams close together is aligned, words as letters:
   windows of four item lengths laid every two, so a copy of up to an item's length lies whole in one of them. ``score`` is the best local
   alignment as a share of the item's alignment with itself.

Neither the benchmark nor the documents pass through the driver; what every task gets is the filter (``FILTER_BITS`` bits) and the
lengths of the longest and the shortest item.

Defined cases: words are lower-cased and lose punctuation at their edges; null and empty texts hold nothing; items of
fewer than ``SEED`` words cannot be found; a document id in several rows or a repeated item
id counts once with its best score; an empty table gives no pairs; further columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.textops import WordHash, shingles, staged, tidy

SEED = 3
HITS = 2
WINDOW = 2
SALTS = 8
CELLS = 1 << 19  # passages aligned at once, in words
SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 24
PASSAGE_BYTES = 1 << 22  # of words that a batch of pairs holds
_EDGE = ".,;:!?()[]{}<>\"'*#%&$|«»¿¡"


class CoreHash(WordHash):
    """Hash of the lower-cased word without punctuation at its edges; 0 if nothing is left."""

    def __missing__(self, word):
        core = word.strip(_EDGE)
        if core == word:
            return super().__missing__(word)
        value = self[word] = self[core] if core else 0
        return value


def word_hashes(text: str, cache: CoreHash) -> np.ndarray:
    ids = cache.of((text or "").lower().split())
    return ids[ids != 0] if len(ids) and not ids.all() else ids


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _grams(words: np.ndarray) -> np.ndarray:
    return shingles(words, SEED) if len(words) >= SEED else np.zeros(0, np.uint64)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id, words, grams of the items that can be found."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def read(batches):
        cache = CoreHash()
        for batch in batches:
            rows = [(i, word_hashes(t, cache)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [(i, w) for i, w in rows if len(w) >= SEED]
            if rows:
                yield _rows(schema, [i for i, _ in rows], [w.tobytes() for _, w in rows],
                            [np.unique(_grams(w)).view(np.int64).tolist() for _, w in rows])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    return rows.mapInArrow(read, "item_id long, words binary, grams array<long>").withColumn("item", F.monotonically_increasing_id())


def filter_of(items: DataFrame) -> np.ndarray:
    """A bit for each slot that an n-gram of some item falls in: 2 ^ ``FILTER_BITS`` bits, whatever the benchmark."""
    slot = F.shiftrightunsigned(F.col("gram"), 64 - FILTER_BITS)
    slots = items.select(F.explode("grams").alias("gram")).select(slot.alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = words.toPandas()
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def passages_of(docs: DataFrame, maybe, longest: int, need: int) -> DataFrame:
    """doc_id, pid, words, at, grams: passages with at least ``need`` different hits, and where the hits are."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches):
        cache, bits = CoreHash(), maybe.value
        for batch in batches:
            owners, bodies, places, found, held = [], [], [], [], 0
            schema = pa.schema([("doc_id", batch.column(0).type), ("words", pa.binary()), ("at", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64()))])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = word_hashes(text.as_py(), cache)
                grams = _grams(words)
                hits = np.flatnonzero(bits[_slot(grams)])
                if len(hits) < need:
                    continue
                for part in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * longest) + 1):
                    if len(part) > 1 and len(np.unique(grams[part])) >= need or need == 1:
                        begin, end = max(0, int(part[0]) - longest), min(len(words), int(part[-1]) + SEED + longest)
                        owners.append(doc_id)
                        bodies.append(words[begin:end].tobytes())
                        places.append((part - begin).tolist())
                        found.append(grams[part].view(np.int64).tolist())
                        held += len(bodies[-1]) + 12 * len(part)
                if held > PASSAGE_BYTES:
                    yield _rows(schema, owners, bodies, places, found)
                    owners, bodies, places, found, held = [], [], [], [], 0
            if owners:
                yield _rows(schema, owners, bodies, places, found)
        tidy()

    rows = docs.mapInArrow(read, f"doc_id {kind}, words binary, at array<int>, grams array<long>")
    return rows.withColumn("pid", F.xxhash64("words")).withColumn("check", F.md5("words"))


def _salted(big: DataFrame, small: DataFrame, key, by: str) -> DataFrame:
    """Inner join on ``key``; a key may hold a third of the rows of ``big``, which are spread by ``by``."""
    keys = [key] if isinstance(key, str) else key
    big = big.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.join(small, [*keys, "salt"]).drop("salt")


def seeds_of(passages: DataFrame, owners: DataFrame, items: DataFrame) -> DataFrame:
    """pid, gram: of every ``WINDOW`` consecutive hits the rarest, by the documents whose passages hold it."""
    own = items.select(F.explode("grams").alias("gram")).distinct()
    counted = passages.join(owners.groupBy("pid").agg(F.count("*").alias("docs")), "pid")
    hits = counted.select("pid", "docs", F.posexplode("grams").alias("k", "gram"))
    n = hits.groupBy("gram").agg(F.sum("docs").alias("n")).join(own, "gram")   # without what only the filter takes for a hit
    rare = _salted(hits, n, "gram", "pid").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("k", "n", "gram"))).alias("hits"))
    rarity = F.transform("hits", lambda h: F.struct(h["n"].alias("n"), h["gram"].alias("gram")))
    last = F.greatest(F.size("hits") - WINDOW, F.lit(0))
    picks = F.transform(F.sequence(F.lit(0), last), lambda s: F.array_min(F.slice(rarity, s + 1, F.lit(WINDOW))))
    return rare.select("pid", F.explode(F.array_distinct(picks)).alias("p")).select("pid", "p.gram")


def _windows(at: np.ndarray, grams: np.ndarray, n: int, size: int):
    """(begin, end) of the windows of an item of ``n`` words that hold enough different hits of it."""
    window = at // (2 * n)
    low, high = (at % (2 * n) < n) & (window > 0), at % (2 * n) >= n
    window, grams = np.concatenate([window, window[low] - 1, window[high] + 1]), np.concatenate([grams, grams[low], grams[high]])
    pairs = np.unique(np.stack([window.astype(np.int64), grams.view(np.int64)]), axis=1)
    for w, count in zip(*np.unique(pairs[0], return_counts=True)):
        if count >= min(HITS, n - SEED + 1):
            yield int(max(0, 2 * n * w - n)), int(min(size, 2 * n * (w + 1) + n))


def smith_waterman(items: list, passages: list) -> np.ndarray:
    """Best local alignment of each item with its passage, all pairs at once, row by row."""
    n, m = max(map(len, items)), max(map(len, passages))
    left = np.zeros((len(items), n), np.uint64)
    right = np.ones((len(items), m), np.uint64)     # paddings differ from one another
    live = np.zeros((len(items), n), bool)
    for k, (a, b) in enumerate(zip(items, passages)):
        left[k, :len(a)], right[k, :len(b)], live[k, :len(a)] = a, b, True
    row = np.zeros((len(items), m + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    slope = -GAP * np.arange(m, dtype=np.int32)
    for i in range(n):
        step = row[:, :-1] + np.where(left[:, i, None] == right, MATCH, MISMATCH)
        cell = np.maximum(np.maximum(step, row[:, 1:] + GAP), 0)
        # Gaps along the passage: a running maximum of the values, each raised by its distance.
        row[:, 1:] = np.maximum.accumulate(cell + slope, axis=1) - slope
        row[~live[:, i]] = 0
        best = np.maximum(best, row.max(axis=1))
    return best


def shares(pairs: list) -> list:
    """Score of each (item words, passage words) pair of bytes. Equal pairs are aligned once, long ones in smaller groups."""
    score = dict.fromkeys(pairs)
    todo = sorted(score, key=lambda p: len(p[0]), reverse=True)
    while todo:
        size = max(1, min(256, CELLS // max(1, len(todo[0][0]) // 2)))
        part, todo = todo[:size], todo[size:]
        items, own = ([np.frombuffer(p[k], np.uint64) for p in part] for k in (0, 1))
        best = smith_waterman(items, own)
        score.update(zip(part, (best / (MATCH * np.array([len(w) for w in items]))).tolist()))
    return [score[p] for p in pairs]


def aligned(pairs: DataFrame, least: float) -> DataFrame:
    """pid, item, score of the pairs of passages and items (pid, item, words, at, grams, item_words, item_grams) that score enough."""
    schema = pa.schema([("pid", pa.int64()), ("item", pa.int64()), ("score", pa.float64())])

    def scored(held):
        best = {}
        for (pid, item, _), share in zip(held, shares([p for _, _, p in held])):
            if share >= least:
                best[pid, item] = max(share, best.get((pid, item), 0))
        if best:
            yield _rows(schema, [p for p, _ in best], [i for _, i in best], list(best.values()))

    def read(batches):
        for batch in batches:
            held, size = [], 0
            for pid, item, words, at, grams, own, known in zip(*batch.columns):
                words, own = words.as_py(), own.as_py()
                hits = np.array(grams.as_py(), np.int64)
                mine = np.isin(hits, np.array(known.as_py(), np.int64))
                for a, z in _windows(np.array(at.as_py(), np.int64)[mine], hits[mine], len(own) // 8, len(words) // 8):
                    held.append((pid.as_py(), item.as_py(), (own, words[8 * a:8 * z])))
                    size += 8 * (z - a)
                    if size > PASSAGE_BYTES:
                        yield from scored(held)
                        held, size = [], 0
            yield from scored(held)
        tidy()

    return pairs.select("pid", "item", "words", "at", "grams", "item_words", "item_grams").mapInArrow(read, "pid long, item long, score double")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE, key: Column = None) -> DataFrame:
    """doc_id, item_id, score of the pairs whose score is at least ``least``; ``key`` may name rows by other than their id."""
    spark = docs.sparkSession
    docs = docs.select((F.col("doc_id").cast("long") if key is None else key).alias("doc_id"), "text")
    items = staged(items_of(benchmark), "items")
    size = F.octet_length("words") / 8
    longest, shortest = items.agg(F.max(size).cast("int"), F.min(size).cast("int")).first()
    if longest is None:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, score double")
    maybe = spark.sparkContext.broadcast(filter_of(items))
    found = staged(passages_of(docs, maybe, longest, min(HITS, shortest - SEED + 1)), "passages")
    maybe.unpersist()
    # Equal passages once: their number is a hash of their words, checked by another one.
    owners = found.select("doc_id", "pid", "check")
    passages = staged(found.groupBy("pid", "check").agg(F.min_by(F.struct("words", "at", "grams"), "check").alias("p")).select("pid", "p.*"), "distinct")
    postings = items.select("item", F.explode("grams").alias("gram"))
    pairs = staged(_salted(seeds_of(passages, owners, items), postings, "gram", "pid").select("pid", "item").distinct(), "seeded")
    own = items.select("item", F.col("words").alias("item_words"), F.col("grams").alias("item_grams"))
    scores = staged(aligned(_salted(pairs.join(passages, "pid"), own, "item", "pid"), least), "scores")
    named = scores.join(items.select("item", "item_id"), "item").groupBy("pid", "item_id").agg(F.max("score").alias("score"))
    told = _salted(owners.select("doc_id", "pid", F.xxhash64("doc_id").alias("row")), named, "pid", "row")
    return told.groupBy("doc_id", "item_id").agg(F.round(F.max("score"), 6).alias("score"))
