"""Exact distinct counts that merge: over days, files or runs, without reading old rows again.

Values get dense numbers once, in a dictionary table. Sets of numbers are bitmaps, and sets merge by OR:

* large domains (identifiers): rows of (bucket, bitmap) with 32,768 numbers each, by ``bitmap_construct_agg``;
* small domains (sensors): 64-bit words, by ``bit_or``, whose buffers are as small as a sum's.

Both aggregate on the map side, and no row is copied for each distinct count.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
RUN_BITS = 48       # numbers of one extension of a dictionary


def numbered(values: DataFrame, run: int = 0) -> DataFrame:
    """``value``, ``number`` of the distinct non-null values of a one-column table. Numbers are dense within each partition of a
    run, which is what keeps bitmaps full; they need no global order. Write the result: numbers are given only once."""
    value = F.col(values.columns[0]).alias("value")
    first = run << RUN_BITS
    return values.select(value).filter(F.col("value").isNotNull()).distinct().withColumn(
        "number", F.monotonically_increasing_id() + F.lit(first))


def unknown(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Values that a dictionary does not hold yet, to be ``numbered`` as its next run and appended to it."""
    value = F.col(values.columns[0]).alias("value")
    return values.select(value).distinct().join(dictionary, "value", "left_anti")


def bitmaps(sets: DataFrame, dictionary: DataFrame, by: list, column: str) -> DataFrame:
    """``by``, bucket, bitmap of the values of ``column`` in each group. ``sets`` should hold each value once a group."""
    known = dictionary.select(F.col("value").alias(column), "number")
    return (
        sets.select(*by, column).join(known, column)
        .groupBy(*by, F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))
    )


def merged(maps: DataFrame, by: list) -> DataFrame:
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def counted(maps: DataFrame, by: list, into: str) -> DataFrame:
    """Distinct values of each group, whatever parts its bitmaps come in."""
    return merged(maps, by).groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias(into))


def small_dictionary(values: DataFrame) -> DataFrame:
    """``value``, ``number`` from 0 without gaps, for a domain of a few thousand values at most (sensors): the one window over all of
    them is over the distinct values only."""
    from pyspark.sql import Window
    value = F.col(values.columns[0]).alias("value")
    known = values.select(value).filter(F.col("value").isNotNull()).distinct()
    return known.withColumn("number", F.row_number().over(Window.orderBy("value")) - 1)


def words_of(size: int) -> int:
    return max(1, -(-size // WORD))


def word_sets(number: Column, words: int, name: str) -> list:
    """One aggregate a word, named ``name``_0, …: the set of the numbers of a group."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(WORD)).cast("int"))
    at = F.floor(number / WORD)
    return [F.coalesce(F.bit_or(F.when(at == k, bit)), F.lit(0).cast("long")).alias(f"{name}_{k}") for k in range(words)]


def word_unions(words: int, name: str) -> list:
    return [F.bit_or(f"{name}_{k}").alias(f"{name}_{k}") for k in range(words)]


def word_count(words: int, name: str) -> Column:
    total = F.bit_count(f"{name}_0")
    for k in range(1, words):
        total = total + F.bit_count(f"{name}_{k}")
    return total.cast("long")
