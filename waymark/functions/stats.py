"""Small statistics built from groupBy and window expressions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(df: DataFrame, count: str, within: list, into: str = "pct") -> DataFrame:
    """Percent of each row's count within its group; ``within=[]`` means the whole table."""
    if within:
        total = F.sum(count).over(Window.partitionBy(*within))
    else:
        total = df.agg(F.sum(count)).scalar()
    return df.withColumn(into, F.col(count) * 100.0 / total)


def top_with_ties(df: DataFrame, by: str, k: int, within: list = ()) -> DataFrame:
    """The k largest values and everything equal to the last of them."""
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    return df.withColumn("_rank", F.rank().over(w.orderBy(F.desc(by)))).filter(
        F.col("_rank") <= k
    ).drop("_rank")


def average_rank(df: DataFrame, value: str, within: list, into: str) -> DataFrame:
    """Rank with ties at their mean, from counts per distinct value."""
    counts = df.groupBy(*within, value).agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(
        Window.partitionBy(*within).orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranks = counts.select(*within, value, (below - (F.col("_n") - 1) / 2.0).alias(into))
    return df.join(ranks, [*within, value])


def exact_quantiles(
    df: DataFrame, group: list, value: str, probs: dict, bucket_width: float
) -> DataFrame:
    """Exact linear-interpolation quantiles of a column with unboundedly many values, and the
    number of rows ``n`` and their ``mean``.

    A histogram of ``bucket_width`` locates the buckets that hold the wanted ranks; only
    rows of those buckets are ranked, each bucket on its own. ``percentile`` would keep
    every distinct value of a group in one task instead.
    """
    # the group is one struct and the bucket never NULL: a join on them infers no extra filter,
    # so histogram and ranking share one shuffle of the counts
    counts = df.filter(F.col(value).isNotNull()).groupBy(
        F.struct(*group).alias("_g"),
        F.coalesce(F.floor(F.col(value) / bucket_width), F.lit(0)).alias("_bucket"),
        F.col(value).alias("_v"),
    ).agg(F.count("*").alias("_n"))
    histogram = counts.groupBy("_g", "_bucket").agg(
        F.sum("_n").alias("_rows"), F.sum(F.col("_v") * F.col("_n")).alias("_sum")
    )
    w = Window.partitionBy("_g")
    upto = w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()
    ])
    # 0-based rank p*(n-1): the two neighbouring rows carry the interpolation weights
    targets = (
        histogram.withColumn("_end", F.sum("_rows").over(upto))
        .withColumn("_total", F.sum("_rows").over(w))
        .withColumn("_mean", F.sum("_sum").over(w) / F.sum("_rows").over(w))
        .withColumn("_q", F.explode(wanted))
        .withColumn("_pos", F.col("_q.p") * (F.col("_total") - 1))
        .withColumn("_r", F.explode(F.array(F.floor("_pos"), F.floor("_pos") + 1)))
        .filter((F.col("_r") >= F.col("_end") - F.col("_rows")) & (F.col("_r") < F.col("_end")))
        .select(
            "_g", "_bucket", F.col("_q.name").alias("_name"), "_r",
            (F.col("_end") - F.col("_rows")).alias("_before"),
            (1 - F.abs(F.col("_pos") - F.col("_r"))).alias("_weight"), "_total", "_mean",
        )
        .filter(F.col("_weight") > 0)
    )
    # the wanted ranks of a bucket (a few per quantile) travel with it as one array
    hit = targets.groupBy("_g", "_bucket").agg(
        F.collect_list(F.struct("_name", "_r", "_weight", "_before", "_total", "_mean")).alias("_t")
    )
    inside = Window.partitionBy("_g", "_bucket").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    picked = (
        counts.join(hit, ["_g", "_bucket"])
        .withColumn("_upto", F.sum("_n").over(inside))
        .withColumn("_t", F.explode("_t"))
        .filter((F.col("_t._r") < F.col("_t._before") + F.col("_upto"))
                & (F.col("_t._r") >= F.col("_t._before") + F.col("_upto") - F.col("_n")))
    )
    return picked.groupBy("_g").agg(
        *[F.sum(F.when(F.col("_t._name") == name, F.col("_v") * F.col("_t._weight"))).alias(name)
          for name in probs],
        F.first("_t._total").alias("n"), F.first("_t._mean").alias("mean"),
    ).select("_g.*", *probs, "n", "mean")


def median_of_few(value) -> Column:
    """The exact median of groups of a few values, as the packets of a second or the seconds of a window: their sorted list costs
    a fraction of the counting map that ``median`` keeps for every group."""
    values = F.sort_array(F.collect_list(value))
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / F.lit(2.0)


def pearson(x: str, y: str) -> Column:
    """Pearson correlation of a group; NaN where a side does not vary (``corr`` divides by zero there under ANSI rules)."""
    x, y = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    shared = F.covar_pop(x, y)
    return F.when(shared.isNotNull(), F.coalesce(F.try_divide(shared, F.stddev_pop(x) * F.stddev_pop(y)), F.lit(float("nan"))))


def euclid(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(x1 - x2, F.lit(2)) + F.pow(y1 - y2, F.lit(2)))
