"""Shared helpers: folds, bounded label samples, stages, word hashes."""

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.sources.tables import shared_dir

ROW_GROUP = 16 << 20
WORD_CACHE = 50_000  # distinct words a task remembers; then the cache starts anew


def lean_batches(spark) -> None:
    """Texts may be very long, so Arrow batches are kept smaller than Spark's defaults, unless the session says otherwise."""
    for key, usual, own in (("maxRecordsPerBatch", "10000", "500"), ("maxBytesPerBatch", "67108864b", "4194304b")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) == usual:
            spark.conf.set(key, own)


def documents(spark, sf_dir: str, table: str = "documents") -> DataFrame:
    lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 1 modulo 3. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    lean_batches(spark)
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    # Small row groups: a task's writer holds one in memory.
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exchanged(rows: DataFrame) -> DataFrame:
    """Rows that a join is to exchange. Numbers of a staged table take far less room in its files, by whose size Spark would
    otherwise choose to send them to the driver and from there to all executors, than as rows of a hash table, salted ones most."""
    return rows.hint("merge")


def share(key: Column, seed: int) -> Column:
    """A value in [0, 1) that depends on the key only."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict, seed: int = 17,
                    keep: tuple = ("text",)) -> DataFrame:
    """Labelled rows to learn from: never the held-out fold, about ``bounds[value]`` rows for each
    label value at most, chosen by a hash of the id. Repeated labels of an id count once (the
    largest value), null ids and labels not at all. Returns ``_y``, ``_u`` (a uniform share for
    splits) and the ``keep`` columns.

    The chosen ids are bounded by ``bounds`` and so may be broadcast: the documents are not shuffled.
    """
    known = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
             .filter(F.col("_id").isNotNull() & F.col("_y").isin(*bounds) & ~held_out("_id"))
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for value, bound in bounds.items():
        rate = min(1.0, bound / max(1, sizes.get(value, 0)))
        chosen = chosen | ((F.col("_y") == value) & (share(F.col("_id"), seed) < rate))
    picked = known.filter(chosen)
    rows = docs.select(F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in keep])
    joined = rows.join(F.broadcast(picked), "_id")
    return joined.select("_y", share(F.col("_id"), seed + 1).alias("_u"), *[f"_{c}" for c in keep])


FILTER_BITS = 26  # of the filter below: 8 MB, whatever the data


def with_hit(rows: DataFrame, key: str, members: DataFrame, hit: str = "__hit") -> DataFrame:
    """Adds whether the key may be in the one column of ``members``: true for each member, and for few others while
    members are far fewer than the filter's bits. The filter is a table of fixed size (``FILTER_BITS`` bits), so it may
    be broadcast; it only saves shuffling rows that a join would drop, an exact join follows.
    """
    def slots(c):
        return F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))

    chunk, word, bit = (lambda s: F.shiftright(s, 14).cast("int")), (lambda s: F.shiftright(s, 6).bitwiseAND(255).cast("int")), (
        lambda s: s.bitwiseAND(63).cast("int"))
    own = members.select(slots(F.col(members.columns[0])).alias("s"))
    words = own.select(chunk(F.col("s")).alias("__chunk"), word(F.col("s")).alias("w"), bit(F.col("s")).alias("b")).groupBy(
        "__chunk", "w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    table = words.groupBy("__chunk").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("__words"))
    at = rows.withColumn("__slot", slots(F.col(key)))
    at = at.withColumn("__chunk", chunk(F.col("__slot"))).join(F.broadcast(table), "__chunk", "left")
    found = at.withColumn("__own", F.element_at("__words", word(F.col("__slot")))).withColumn("__bit", bit(F.col("__slot")))
    return found.withColumn(hit, F.expr("coalesce(shiftright(__own, __bit) & 1L, 0L) = 1")).select(*rows.columns, hit)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in the one column of ``gone``. Only rows that the filter holds for possible
    members are shuffled for the exact join."""
    checked = with_hit(rows, key, gone)
    some = checked.filter("__hit").drop("__hit")
    name = gone.columns[0]
    rest = some.join(gone.withColumnRenamed(name, "__gone"), F.col(key).eqNullSafe(F.col("__gone")), "left_anti")
    return checked.filter("NOT __hit").drop("__hit").unionByName(rest)


def tidy() -> None:
    """At the end of a task: give what the worker no longer needs back to the system, since workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # other C libraries have no such call
        pass


def with_made(rows: DataFrame, text: str, name: str, kind: str, made) -> DataFrame:
    """The rows with a column ``name`` that ``made`` makes of the texts of an Arrow batch, list to list; ``name`` may be the text
    itself. Batches go in and out as Arrow, so a worker never loads pandas (some 40 MB of it, for as long as it lives)."""
    wide = rows.withColumn(name, F.col(text) if name == text else F.lit(None).cast(kind))
    source, target = wide.columns.index(text), wide.columns.index(name)

    def read(batches):
        for batch in batches:
            field = batch.schema.field(target)
            out = pa.array(made(batch.column(source).to_pylist()), field.type)
            yield batch.set_column(target, field.name, out)
            del batch, out
            tidy()

    return wide.mapInArrow(read, wide.schema)


class WordHash(dict):
    """word -> 64-bit hash, remembered for words seen before."""

    def __missing__(self, word):
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a finalizer of multiply and shift steps)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; a shorter text is one run; no words, none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < size:
        words, size = np.concatenate([words, np.full(size - n, size, np.uint64)]), size
        n = size
    total = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x5851F42D4C957F2D) + words[i:n - size + 1 + i]
    return mix(total)
