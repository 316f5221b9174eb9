"""Operator 5, mixing sources to target weights: hierarchical budgets, Spark expressions only.

Documents hang in a tree domain - language - source. The token budget goes down the tree: the children of a node share
its budget by weight, a child that holds less than its share (its tokens times ``EPOCHS``) takes all it can, and what it leaves goes to its
siblings by weight. A node's capacity is that of its children, so a shortage leaves the node only when all siblings
are used up. All amounts are whole tokens; a division's remainder, less than a token for each child, is left over.

A leaf with budget b and t tokens is read b div t times in full, and a prefix of b mod t tokens of the next epoch follows: documents in the
epoch's seeded order, whole, up to the first that does not fit. The order is that of ``BUCKETS`` buckets (hash of seed, id and text),
then of the documents in a bucket, both by a hash of seed and epoch. So one aggregate of (leaf, bucket) sizes
finds the bucket in which the prefix ends, and only that bucket is sorted, however large the leaf.

Defined cases: null language is ``und``, null source ``none``; a null text has no tokens; a null id counts as an empty one, so rows
without ids, or of one id, are told apart by their texts; rows of one id and one text are together in the order, so they are taken or
left together; a leaf without tokens gives nothing; an empty table gives no rows; further columns are kept, but for
columns named as the three that are added, which are replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.textops import staged

SEED = 42
BUDGET = (2, 5)   # of all tokens
EPOCHS = 4
SALTS = 16
DIGITS = 3        # hex digits of a bucket: 4,096 buckets
WEIGHTS = {
    "domain": {"web": 4, "books": 6, "forum": 2, "news": 3},
    "lang": {"en": 5, "de": 3, "fr": 2, "es": 2},
    "source": {"src0": 3},
}  # 1 for all others
WORD = r"[^ \t\n\r]+"
LEVELS = ("__domain", "__lang", "__source")
_WHOLE = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """The documents name no domain: it follows from the source, by the first digit of its md5."""
    digit = F.substring(F.md5(source.cast("binary")), 1, 1)
    return F.when(digit < "5", "web").when(digit < "9", "books").when(digit < "d", "forum").otherwise("news")


def _weight(name: str, value: Column) -> Column:
    out = None
    for key, weight in WEIGHTS[name].items():
        out = (F if out is None else out).when(value == key, weight)
    return (F.lit(1) if out is None else out.otherwise(1)).cast(_WHOLE)


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def placed(docs: DataFrame) -> DataFrame:
    """The rows with their leaf, bucket and tokens."""
    source = F.coalesce("source", F.lit("none"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    return docs.withColumns({
        "__domain": domain_of(source), "__lang": F.coalesce("lang", F.lit("und")), "__source": source,
        "__bucket": F.substring(_hash(F.lit(str(SEED)), key), 1, DIGITS), "__key": key,
        "__tokens": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
    })


def share_out(children: DataFrame, parents: list, name: str) -> DataFrame:
    """``children`` hold ``budget`` of the parent, ``capacity``, ``weight``: adds ``own``, the child's budget.

    By capacity for each unit of weight, the children that take all they hold come first: the k-th does if its
    capacity is at most its share of what the ones before it left.
    """
    order = W.partitionBy(*parents).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast(_WHOLE)
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).cast(_WHOLE)
    step = children.withColumn("_before", before).withColumn("_rest", rest)
    full = (F.col("capacity") * F.col("_rest")).cast(_WHOLE) <= (F.col("weight") * (F.col("budget") - F.col("_before"))).cast(_WHOLE)
    step = step.withColumn("_full", full)
    every = W.partitionBy(*parents)
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(every), F.lit(0)).cast(_WHOLE)
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every).cast(_WHOLE)
    step = step.withColumn("_left", (F.col("budget") - taken).cast(_WHOLE)).withColumn("_open", open_weight)
    return step.withColumn("own", F.when(F.col("_full"), F.col("capacity")).otherwise(
        F.expr("CAST(weight * _left AS decimal(38,0)) div _open")).cast(_WHOLE)).drop(
        "_before", "_rest", "_full", "_left", "_open")


def budgets(sizes: DataFrame, share: tuple = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Leaves with their budget ``own``. ``sizes``: leaf and tokens."""
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("tokens").cast(_WHOLE).alias("tokens"))
    leaves = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast(_WHOLE)).filter("tokens > 0")
    everything = W.partitionBy("__root")
    total = F.sum("tokens").over(everything).cast(_WHOLE) * share[0]
    known, parents = None, ["__root"]
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[:depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").cast(_WHOLE).alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("__root", F.lit(0)).withColumn("weight", _weight(level[2:], F.col(level)))
        if known is None:
            whole = nodes.withColumn("_t", total.cast(_WHOLE)).withColumn("_c", F.sum("capacity").over(everything).cast(_WHOLE))
            below = whole.withColumn("budget", F.least(F.expr(f"CAST(_t div {share[1]} AS decimal(38,0))"), "_c"))
        else:
            below = nodes.join(known, parents)
        known = share_out(below, parents, level).select(*path, F.col("own").alias("budget"))
        parents = path
    return leaves.join(known, list(LEVELS))


def plan(rows: DataFrame) -> DataFrame:
    """One row for each leaf: full epochs, and the bucket and document hash at which the prefix of the next ends."""
    sizes = staged(rows.groupBy(*LEVELS, "__bucket").agg(F.sum("__tokens").alias("tokens")), "sizes")
    leaf = staged(budgets(sizes).select(
        *LEVELS, F.expr("budget div tokens").cast("long").alias("__full"),
        F.expr("budget % tokens").cast("long").alias("__part")), "leaves")
    keyed = sizes.join(leaf, list(LEVELS)).withColumn(
        "__place", _hash(F.lit(str(SEED)), F.col("__full").cast("string"), "__bucket"))
    order = W.partitionBy(*LEVELS).orderBy("__place").rowsBetween(W.unboundedPreceding, 0)
    ends = keyed.withColumn("end", F.sum("tokens").over(order)).filter(F.col("end") > F.col("__part"))
    cut = ends.groupBy(*LEVELS, "__full", "__part").agg(
        F.min(F.struct("__place", "__bucket", (F.col("__part") - F.col("end") + F.col("tokens")).alias("left"))).alias("c"))
    cut = staged(cut.select(*LEVELS, "__full", F.col("c.__place").alias("__cut"), F.col("c.__bucket").alias("__bucket"),
                            F.col("c.left").alias("__left")), "cuts")
    inside = rows.select(*LEVELS, "__bucket", "__key", "__tokens").join(cut, [*LEVELS, "__bucket"])
    inside = inside.withColumn("__hash", _hash(F.lit(str(SEED)), F.col("__full").cast("string"), "__key"))
    inside = inside.groupBy(*LEVELS, "__left", "__hash").agg(F.sum("__tokens").alias("__tokens"))   # rows of one hash together
    running = F.sum("__tokens").over(W.partitionBy(*LEVELS).orderBy("__hash"))
    last = inside.withColumn("sum", running).filter(F.col("sum") <= F.col("__left")).groupBy(*LEVELS).agg(
        F.max("__hash").alias("__last"))
    return staged(cut.drop("__bucket", "__left").join(last, list(LEVELS), "left"), "plan")


def mix(docs: DataFrame) -> DataFrame:
    """The selected rows with all their columns and ``mix_domain``, ``mix_tokens``, ``mix_epochs`` (how often a row is read).

    A leaf may hold a third of all rows, so the join with the plan is salted where Spark does not find the
    plan small enough to broadcast.
    """
    docs = docs.drop("mix_domain", "mix_tokens", "mix_epochs")
    rows = placed(docs)
    salted = staged(plan(rows).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "salted")
    # Any row may go to any salt, since every salt holds the whole plan.
    spread = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = spread.join(salted, [*LEVELS, "__salt"])
    place = _hash(F.lit(str(SEED)), F.col("__full").cast("string"), "__bucket")
    own = _hash(F.lit(str(SEED)), F.col("__full").cast("string"), "__key")
    more = (place < F.col("__cut")) | ((place == F.col("__cut")) & F.coalesce(own <= F.col("__last"), F.lit(False)))
    times = F.col("__full") + F.when(more, 1).otherwise(0)
    return joined.withColumn("mix_epochs", times).filter("mix_epochs > 0").select(
        *docs.columns, F.col("__domain").alias("mix_domain"), F.col("__tokens").alias("mix_tokens"), "mix_epochs")
