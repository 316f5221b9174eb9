"""Operator 12, near duplicates by SetSketch registers.

A text's set is its distinct runs of ``WORDS`` words. Its sketch has ``REGISTERS`` registers; each is the least of the set's
exponentially distributed hash values on an exponential scale of base ``BASE``, truncated to a byte: floor(1 - log_BASE(least)).
The registers of a union are the maxima of the registers, so long texts are sketched in pieces and merged. Two registers are equal
with a probability that depends on the similarity only, close to it, so bands of registers find candidates; and the counts of
greater, less and equal registers together give the likelihood of a similarity, with which candidates are sifted. Links are
confirmed on full sets: 100 * intersection >= 85 * union.

1. ``sketches``: one pass over the texts. Equal sets are one node from here on.
2. ``buckets``: nodes that share the registers of a band. Bands and rows miss a pair at the threshold once in ``1 / (1 - RECALL)``.
3. ``star``: each node against the leader of the buckets it shares most with, the node that meets most others: one pair a node,
   sifted, then verified. Verified links make components, so a group of thousands of near copies is settled by as many pairs as
   it has members.
4. ``forest``: buckets whose members are still in several components. Their members meet in blocks, sketches only and once,
   those of a bucket's largest component only with the others, and the likeliest pairs between components that make a forest
   are verified: at most one a member.
5. ``rest``: in the groups that still hold several components the sets of all nodes with a likely partner in another
   component meet. So every candidate pair between components is decided; no pairs are written but the links of a
   spanning forest, and a block holds a bounded number of shingles.
6. Components of all links; the least id of a component names it.

Defined cases: null and empty texts, and texts of white space, have no shingles and are linked with nothing; a text of
fewer words than ``WORDS`` has one shingle, all its words; repeated rows and equal sets are linked, all in one component; a null id
takes part and gets the least id of its component, null if all are null (then all its rows are kept); an empty table gives no rows;
further columns are ignored, whatever their names.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.jaccard import components
from waymark.llm.textops import exchanged, mix, shingles, staged, tidy, with_hit

WORDS = 5
LINK = (85, 100)        # intersection to union
REGISTERS = 256
BASE, RATE = 1.1, 20.0  # scale of the registers, and rate of the exponential values: sets up to 10^9 fit a byte
RECALL = 0.999999
DOUBT = 5.0             # standard deviations by which a sketch must speak against a link
BLOCK = 256             # nodes a block
BLOCK_GRAMS = 400_000   # shingles a block
SALTS = 8
NUMBER = 7              # bits of a band's number
WORD_BYTES = 8 << 20    # of words a task remembers


# The sketch -----------------------------------------------------------------------------------------------------------

def _log_base(x):
    return np.log(x) / math.log(BASE)


def _unlike(x):
    """Probability that a register of one set is greater, ``x`` being the share of its own elements less the other's common ones."""
    return -_log_base(1 - np.clip(x, 1e-12, 1) * (BASE - 1) / BASE)


def alike(similarity: float) -> float:
    """Least probability over all sizes that registers of sets of this similarity are equal."""
    u = np.linspace(similarity / (1 + similarity), 1 / (1 + similarity), 33)
    return float((1 - _unlike(u - (1 - u) * similarity) - _unlike(1 - u - u * similarity)).min())


def band_plan(similarity: float = LINK[0] / LINK[1], recall: float = RECALL) -> tuple:
    """(bands, rows): the most rows a band for which the bands that the recall needs fit the registers."""
    best, p = None, alike(similarity)
    for rows in range(1, REGISTERS + 1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-p ** rows))
        if bands * rows <= REGISTERS:
            best = bands, rows
    return best


class Sketcher:
    """Registers of sets of 64-bit hashes."""

    def __init__(self, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(1 << 31, size=(REGISTERS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.offset = rng.integers(1 << 32, size=(REGISTERS, 1), dtype=np.uint32)

    def registers(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(REGISTERS, np.uint8)
        for a in range(0, len(grams), 2048):
            x = (grams[a:a + 2048] >> np.uint64(32)).astype(np.uint32)
            least = (self.factor * x + self.offset).min(axis=1)
            # The least uniform value gives the least exponential one, by the inverse of the distribution.
            value = -np.log1p(-(least + 0.5) / 2.0 ** 32) / RATE
            out = np.maximum(out, np.clip(np.floor(1 - _log_base(value)), 0, 255).astype(np.uint8))
        return out


class Similar:
    """Joint likelihood of the similarity, given how many registers are greater, less and equal. It is concave, so the sign of
    its slope tells on which side of a similarity its maximum lies."""

    def __init__(self, similarity: float = LINK[0] / LINK[1], doubt: float = DOUBT):
        self.similarity, self.slack = similarity, doubt ** 2 / 2
        p = alike(similarity)
        self.fewest = REGISTERS * p - doubt * math.sqrt(REGISTERS * p * (1 - p))    # equal registers

    def _parts(self, n, m, j):
        u = n / (n + m)
        return u, _unlike(u - (1 - u) * j), _unlike(1 - u - u * j)

    def log_likelihood(self, n, m, greater, less, j):
        _, p, q = self._parts(n, m, j)
        return greater * np.log(p) + less * np.log(q) + (REGISTERS - greater - less) * np.log(np.maximum(1 - p - q, 1e-12))

    def slope(self, n, m, greater, less, j):
        u, p, q = self._parts(n, m, j)
        step = (BASE - 1) / BASE / math.log(BASE)
        dp, dq = -(1 - u) * step * BASE ** p, -u * step * BASE ** q
        return greater * dp / p + less * dq / q - (REGISTERS - greater - less) * (dp + dq) / np.maximum(1 - p - q, 1e-12)

    def estimate(self, n, m, greater, less):
        """The similarity of the greatest likelihood; all arguments are arrays."""
        n, m, greater, less = (np.asarray(x, np.float64) for x in (n, m, greater, less))
        low, high = np.zeros(len(n)), np.minimum(n, m) / np.maximum(n, m)
        for _ in range(16):
            middle = (low + high) / 2
            up = self.slope(n, m, greater, less, middle) > 0
            low, high = np.where(up, middle, low), np.where(up, high, middle)
        return (low + high) / 2

    def likely(self, n, m, greater, less) -> np.ndarray:
        """Whether the sets may be as similar as a link needs: sizes allow it, and the sketch is not ``doubt`` deviations against it."""
        n, m, greater, less = (np.asarray(x, np.float64) for x in (n, m, greater, less))
        out = (np.minimum(n, m) >= self.similarity * np.maximum(n, m) - 1e-9) & (REGISTERS - greater - less >= self.fewest)
        at = np.flatnonzero(out)
        below = at[self.slope(n[at], m[at], greater[at], less[at], self.similarity) < 0]
        if len(below):
            a = n[below], m[below], greater[below], less[below]
            gain = self.log_likelihood(*a, self.estimate(*a)) - self.log_likelihood(*a, self.similarity)
            out[below] = gain <= self.slack
        return out


# Texts ----------------------------------------------------------------------------------------------------------------

class ByteWords(dict):
    """word as bytes -> 64-bit hash; remembers words up to a number of bytes."""

    held = 0

    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self.held += len(word) + 120
            if self.held > WORD_BYTES:
                self.clear()
                self.held = 0
            self[word] = value
        return value


def gram_set(text, known: ByteWords) -> np.ndarray:
    """Sorted distinct shingle hashes of a text given as UTF-8: A-Z are lowered, words end at the six ASCII white spaces, which
    is what ``lower`` and ``split`` of bytes do."""
    words = (text or b"").lower().split()
    return np.unique(shingles(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), WORDS))


def _key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, key, registers; key and registers are null for an empty set."""
    def read(batches):
        sketcher, known = Sketcher(), ByteWords()
        for batch in batches:
            n, keys, registers = [], [], []
            for text in batch.column(1):
                grams = gram_set(text.as_py(), known)
                n.append(len(grams))
                keys.append(_key(grams) if len(grams) else None)
                registers.append(sketcher.registers(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(registers, pa.binary())], ["doc_id", "n", "key", "registers"])
        tidy()

    return _texts(docs).mapInArrow(read, "doc_id long, n long, key binary, registers binary")


def bands_of(nodes: DataFrame) -> DataFrame:
    """node, band, n: a hash of the registers of each band, the band's number in its last ``NUMBER`` bits; n goes along."""
    bands, rows = band_plan()
    if bands > 1 << NUMBER:
        raise ValueError("more bands than their numbers have bits for")
    number = np.arange(bands, dtype=np.uint64)
    seeds = np.random.default_rng(7).integers(1 << 62, size=bands, dtype=np.uint64)

    def read(batches):
        for batch in batches:
            if batch.num_rows:
                r = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in batch.column(1)])[:, :bands * rows]
                r = r.reshape(len(r), bands, rows).astype(np.uint64)
                total = np.broadcast_to(seeds, r.shape[:2]).copy()
                for k in range(rows):
                    total = mix(total * np.uint64(257) + r[:, :, k])
                total = total >> np.uint64(NUMBER) << np.uint64(NUMBER) | number
                node, n = (np.repeat(batch.column(k).to_numpy(), bands) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total.reshape(-1).view(np.int64)), pa.array(n)], ["node", "band", "n"])

    return nodes.select("node", "registers", "n").mapInArrow(read, "node long, band long, n long")


def _salted(big: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on ``key``; a key may hold a third of the rows of ``big``, which are spread by ``by``, and one row of ``small``."""
    big = big.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return big.join(exchanged(small), [key, "salt"]).drop("salt")


def buckets(nodes: DataFrame) -> DataFrame:
    """band, node, n, leader of all buckets of two nodes or more. The leader is the node that meets most others over all its
    bands, then the least: in a group of near copies the text they were made from, which most of them are near to."""
    members = bands_of(nodes)
    full = members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    full = staged(full, "full-bands")
    meeting = with_hit(members, "band", full.select("band")).filter("__hit").drop("__hit")
    meeting = staged(_salted(meeting, full, "band", "node"), "meeting")
    degrees = meeting.groupBy("node").agg(F.sum("size").alias("degree"))
    met = meeting.select("band", "node", "n").join(exchanged(degrees), "node")
    leaders = met.groupBy("band").agg(F.min(F.struct((-F.col("degree")).alias("order"), "node")).alias("least"))
    leaders = staged(leaders.select("band", F.col("least.node").alias("leader")), "leaders")
    return staged(_salted(meeting.select("band", "node", "n"), leaders, "band", "node"), "buckets")


# Pairs ----------------------------------------------------------------------------------------------------------------

def _counts(a: np.ndarray, b: np.ndarray) -> tuple:
    return (a > b).sum(-1), (a < b).sum(-1)


def _read(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), np.uint8) for x in column])


def sifted(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be linked; further columns: n_a, n_b, r_a, r_b."""
    def read(batches):
        similar = Similar()
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                found = similar.likely(n, m, *_counts(_read(batch.column(4)), _read(batch.column(5))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(found))

    return pairs.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(read, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are as similar as a link needs."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return LINK[1] * common >= LINK[0] * (len(a) + len(b) - common)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, grams of the wanted nodes (node, doc_id, key), from the rows of their ids. A repeated row gives a repeated set."""
    rows = with_hit(_texts(docs), "doc_id", wanted.select("doc_id")).filter("__hit").drop("__hit")

    def read(batches):
        known = ByteWords()
        for batch in batches:
            found = {}
            for text in batch.column(1):
                grams = gram_set(text.as_py(), known)
                if len(grams):
                    found[_key(grams)] = grams.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())],
                                             ["key", "grams"])
        tidy()

    return rows.mapInArrow(read, "key binary, grams binary").join(exchanged(wanted.select("node", "key")), "key").select("node", "grams")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Of the pairs (a, b) those that are linked by their full sets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = exchanged(wanted).join(nodes, "node")
    sets = staged(sets_of(docs, wanted.select("node", "doc_id", "key")), f"{name}-sets")
    # The partners of b go to as many groups as their number asks for, each with the set of b in front.
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
    member = _salted(exchanged(pairs.withColumn("node", F.col("a"))).join(sets, "node").select("a", "b", "grams"), sizes, "b", "a")
    member = member.select("b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("part"), "a", "grams")
    front = sets.withColumnRenamed("node", "b").join(exchanged(sizes), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(-1).cast("long").alias("a"), "grams")

    def read(batches):
        group, lead = None, None
        for batch in batches:
            found = []
            for b, part, a, grams in zip(*[batch.column(i) for i in range(4)]):
                at = b.as_py(), part.as_py()
                grams = np.frombuffer(grams.as_py(), np.uint64)
                if a.as_py() < 0:
                    group, lead = at, grams
                elif at == group and linked(grams, lead):
                    found.append((a.as_py(), at[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return (member.unionByName(front).repartition("b", "part").sortWithinPartitions("b", "part", "a").mapInArrow(read, "a long, b long"))


def star_links(docs: DataFrame, nodes: DataFrame, met: DataFrame) -> DataFrame:
    """a, b: verified links of nodes with the least node of the buckets they share most with."""
    shared = met.filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("times"))
    pairs = shared.groupBy("node").agg(F.max(F.struct("times", (-F.col("leader")).alias("leader"))).alias("best"))
    pairs = pairs.select(F.col("node").alias("a"), (-F.col("best.leader")).alias("b"))
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    lead = met.select(F.col("leader").alias("node")).distinct()
    lead = exchanged(lead).join(nodes, "node")
    lead = lead.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    likely = staged(sifted(_salted(exchanged(pairs).join(left, "a"), lead, "b", "a")), "likely-stars")
    return verified(docs, nodes, likely, "star")


def _grouped(batches, keys: int):
    """Rows of consecutive equal keys as tuples of Arrow scalars; a group is held as a list."""
    group, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            if row[:keys] != group:
                if rows:
                    yield group, rows
                group, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield group, rows


def _facing(side: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which nodes of a group are to be compared: of different components and, where two blocks meet, of different blocks."""
    out = label[:, None] != label[None, :]
    if side.min() != side.max():
        out &= side[:, None] != side[None, :]
    return np.triu(out, 1)


def _likely_pairs(n, registers, wanted, similar, band: int) -> tuple:
    """The wanted pairs (i, j) of a group that may be linked, with their equal registers. A pair is taken in the first
    band it shares only."""
    bands, rows = band_plan()
    first, second, equal = [], [], []
    near = np.minimum(n[:, None], n[None, :]) >= similar.similarity * np.maximum(n[:, None], n[None, :]) - 1e-9
    for i in range(len(n)):
        js = np.flatnonzero(wanted[i] & near[i])
        if len(js):
            same = registers[js] == registers[i]
            keep = same.sum(axis=1) >= similar.fewest
            js, same = js[keep], same[keep]
            before = same[:, :band * rows].reshape(len(js), band, rows).all(axis=2).any(axis=1)
            js, same = js[~before], same[~before].sum(axis=1)
            if len(js):
                greater, less = _counts(registers[i], registers[js])
                found = similar.likely(np.full(len(js), n[i]), n[js], greater, less)
                first.append(np.full(int(found.sum()), i))
                second.append(js[found])
                equal.append(same[found])
    if not first:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(first), np.concatenate(second), np.concatenate(equal)


def _common(sets: list) -> np.ndarray:
    """Sizes of the intersections of all sets, by products of their incidence matrix, some columns at a time."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    shared = int((times > 1).sum())
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for a in range(0, shared, 4096):
        low, high = np.searchsorted(column, [a, a + 4096])
        x = np.zeros((len(sets), min(4096, shared - a)), np.float32)
        x[owner[low:high], column[low:high] - a] = 1
        out += x @ x.T
    return out


def _forest(first, second, label: np.ndarray) -> list:
    """Of the pairs of a group, in the order given, those that join its components."""
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(first.tolist(), second.tolist()):
        a, b = find(int(label[i])), find(int(label[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _with_registers(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (node, label, n, band and further columns) with the registers of their nodes. A node meets its registers once, with
    all of its bands, of which it has a bounded number: a member of a large group is in most of them."""
    more = [c for c in rows.columns if c not in ("node", "label", "n")]
    bands = rows.groupBy("node", "label", "n").agg(F.collect_list(F.struct(*more)).alias("at"))
    met = exchanged(bands).join(nodes.select("node", "registers"), "node")
    return met.select("node", "label", "n", "registers", F.inline("at"))


def _plan_of_blocks(size: str, grams: str, main_size: str, main_grams: str) -> list:
    """split, rest, blocks: how an open bucket is cut. Members of its largest component need not meet each other, so they get
    blocks of their own, after those of the rest, and meet the blocks of the rest only, where that makes fewer rows. So a
    bucket whose members are settled but for a few makes rows in proportion to its size."""
    def cut(n, g):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(g / BLOCK_GRAMS)).cast("int")

    n, g, m, h = (F.col(c) for c in (size, grams, main_size, main_grams))
    whole, rest, main = cut(n, g), cut(n - m, g - h), cut(m, h)
    split = m * rest + (n - m) * (rest + main) < n * whole
    return [split.alias("split"), F.when(split, rest).otherwise(whole).alias("rest"),
            F.when(split, rest + main).otherwise(whole).alias("blocks")]


def open_blocks(nodes: DataFrame, met: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """band, x, y, node, label, side, n, registers: the members of buckets that hold several components, in pairs of blocks."""
    told = staged(met.select("band", "node", "n").join(exchanged(labels), "node", "left").select(
        "band", "node", "n", F.coalesce("label", "node").alias("label")), f"{name}-buckets")
    parts = told.groupBy("band", "label").agg(F.count("*").alias("size"), F.sum("n").alias("grams"),
                                              F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"))
    open_ = parts.groupBy("band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.sum("size").alias("size"), F.sum("grams").alias("grams"),
        F.sum("members").alias("members"), F.max(F.struct("size", "grams", "label")).alias("main")).filter("low < high")
    # Buckets of the same members are worked on once, in the first of their bands.
    number = F.col("band").bitwiseAND((1 << NUMBER) - 1)
    open_ = open_.groupBy("size", "members", "low", "high").agg(F.min_by(F.struct("band", "grams", "main"), number).alias("one"))
    open_ = staged(open_.select("one.band", F.col("one.main.label").alias("main"), *_plan_of_blocks(
        "size", "one.grams", "one.main.size", "one.main.grams")), f"{name}-bands")
    rows = with_hit(told, "band", open_.select("band")).filter("__hit").drop("__hit")
    rows = _salted(rows, open_, "band", "node").withColumn("own", F.col("split") & (F.col("label") == F.col("main")))
    rows = staged(rows.select("band", "node", "n", "label", "own", "rest", "blocks"), f"{name}-members")
    rows = _with_registers(rows, nodes)
    hashed = F.xxhash64("node")
    rows = rows.withColumn("side", F.when(F.col("own"), F.col("rest") + F.pmod(hashed, F.col("blocks") - F.col("rest"))).otherwise(
        F.pmod(hashed, F.col("rest"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("rest")).otherwise(F.col("blocks")) - 1)))
    rows = rows.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other"))
    return (rows.select("band", "x", "y", "node", "label", "side", "n", "registers").repartition("band", "x", "y")
            .sortWithinPartitions("band", "x", "y"))


def _compared(batches):
    """For each group with likely pairs: its key, nodes, labels, sides, and the pairs with their equal registers."""
    similar = Similar()
    for (band, x, y), part in _grouped(batches, 3):
        node, label, side, n = (np.array([r[k] for r in part]) for k in range(4))
        registers = np.stack([np.frombuffer(r[4], np.uint8) for r in part])
        first, second, equal = _likely_pairs(n, registers, _facing(side, label), similar, band & (1 << NUMBER) - 1)
        if len(first):
            yield (band, x, y), node, label, side, first, second, equal
    tidy()


def likely_members(nodes: DataFrame, met: DataFrame, labels: DataFrame) -> DataFrame:
    """band, x, y, node, side, other: of each group of open buckets the nodes with a likely partner in another component (other
    is null), and the likeliest pairs (node, other) that make a forest of its components. Sketches meet here, and only here."""
    schema = pa.schema([("band", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("node", pa.int64()), ("side", pa.int32()), ("other", pa.int64())])

    def read(batches):
        for key, node, label, side, first, second, equal in _compared(batches):
            at = np.unique(np.concatenate([first, second]))
            order = np.argsort(-equal, kind="stable")
            ends = np.sort(np.array([(node[i], node[j]) for i, j in _forest(first[order], second[order], label)]), axis=1)
            k, m = len(at), len(ends)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([v] * (k + m), f.type) for v, f in zip(key, schema)], pa.array(np.concatenate([node[at], ends[:, 1]])),
                 pa.array([*side[at].tolist(), *[0] * m], pa.int32()), pa.array([*[None] * k, *ends[:, 0].tolist()], pa.int64())], schema=schema)

    rows = open_blocks(nodes, met, labels, "open")
    return rows.mapInArrow(read, "band long, x int, y int, node long, side int, other long")


def forest_links(docs: DataFrame, nodes: DataFrame, likely: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: verified links of the forests that the likeliest pairs of each group of an open bucket make."""
    pairs = likely.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    return verified(docs, nodes, staged(pairs, "likely-forest"), "forest")


def rest_links(docs: DataFrame, nodes: DataFrame, likely: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: verified links between the components of groups that still hold several; every likely pair between them is decided."""
    group = ["band", "x", "y"]
    told = staged(likely.filter("other IS NULL").drop("other").join(exchanged(labels), "node", "left").select(
        *group, "node", F.coalesce("label", "node").alias("label"), "side"), "rest-members")
    several = told.groupBy(*group).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    likely = told.join(exchanged(several.select(*group)), group)
    likely = staged(likely, "likely-rest")
    wanted = exchanged(likely.select("node").distinct()).join(nodes, "node")
    sets = staged(sets_of(docs, wanted.select("node", "doc_id", "key")), "rest-sets")

    def verify(batches):
        for _, part in _grouped(batches, 3):
            part = list({r[0]: r for r in part}.values())
            node, label, side = (np.array([r[k] for r in part]) for k in range(3))
            sets_ = [np.frombuffer(r[3], np.uint64) for r in part]
            n = np.array([len(s) for s in sets_])
            common = _common(sets_)
            found = LINK[1] * common >= LINK[0] * (n[:, None] + n[None, :] - common)
            links = _forest(*np.nonzero(found & _facing(side, label)), label)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([int(node[i]) for i, _ in links], pa.int64()),
                                                  pa.array([int(node[j]) for _, j in links], pa.int64())], ["a", "b"])
        tidy()

    return (exchanged(likely).join(sets, "node").select("band", "x", "y", "node", "label", "side", "grams").repartition("band", "x", "y")
            .sortWithinPartitions("band", "x", "y").mapInArrow(verify, "a long, b long"))


def _components(links: DataFrame) -> DataFrame:
    """node, label of the linked nodes; a label is a component's least node."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("band")).union(links.select("b", "b"))
    return components(staged(ends.distinct(), "link-ends"), exchanged)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows = staged(sketches(docs), "sketches")
    nodes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count("*").alias("copies"), F.min("registers").alias("registers"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # fixed once written
    met = buckets(nodes)
    links = staged(star_links(docs, nodes, met), "star-links")
    labels = _components(links)
    likely = staged(likely_members(nodes, met, labels), "likely")
    for step in (forest_links, rest_links):
        more = staged(step(docs, nodes, likely, labels), step.__name__)
        if not more.isEmpty():
            links = links.union(more)
            labels = _components(links)

    # Equal sets are one node, so a node of several rows is told of as well as one with links.
    known = nodes.select("node", "key", "doc_id", "copies").join(exchanged(labels), "node", "left").filter("copies > 1 OR label IS NOT NULL")
    known = known.withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    told = _salted(known.select("key", "label", "node"), least, "label", "node").select("key", "component_id", F.lit(True).alias("known"))
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(SALTS)).cast("int").alias("salt")
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), "key", salt).join(exchanged(told), ["key", "salt"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
