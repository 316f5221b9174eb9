"""Operator 13, Merkle dataset manifest: a hash tree over all rows, built and proved by a butterfly exchange.

Each row is a leaf, the hash of its fields. The leaves of a group (a language), in order of their key, are hashed up run by run
of ``fanout`` nodes to the group's subroot, and the subroots, in order of their group, to the root. A row's ``path`` holds for
each level the digests left and right of its own, so a holder of one row and its path can fold them to the root.

1. Rows are hashed where they are read; from there on only digests move. They are sorted over the whole table and
   written, and their places follow from the counts of the partitions, so no group is numbered in one task.
2. Aligned segments of fanout ^ height (at most ``SEGMENT``) leaves are the exchange's partitions: each hashes its own subtree.
3. Butterfly: in round r the ``fanout`` segments whose numbers agree but for digit r swap their subtree roots, and
   every one of them hashes the parent itself. After the last round each segment has the subroot and all upper siblings: no
   pass leads down again. Segment numbers are filled up to a power of the fanout; a filled number holds no root until
   a round gives it one, so that each exchange is among ``fanout`` partners and ragged trees need no other rule.
4. Subroots are the leaves of the top tree, built by steps 1 to 3 as well, so there may be as many groups as rows.
5. Each segment hashes its subtree again beside its upper path and hands out the paths of its rows.

Digests move as hex text of 64 characters. A segment holds at most ``SEGMENT`` rows in memory, an exchange ``fanout`` rows.

Defined cases: null fields count as ``-``; a null key comes first, rows of one key are ordered by leaf; repeated rows are
leaves of their own with the same leaf and their own paths; rows of a null group are a group, the first one; an empty
table gives no rows and has no root; a lone leaf is its subroot, a lone subroot the root; empty and long texts need no rule;
further columns are ignored unless named in ``carry``, whatever their names.
"""

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.textops import staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = 4096
ROUNDS_A_PLAN = 4   # rounds of the exchange between two written tables
PATH = "array<struct<left:string,right:string>>"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The hash of a row: each field as its byte count, a colon and its value, or ``-`` for null."""
    def one(c):
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(one, fields)).cast("binary"), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All digests of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def placed(nodes: DataFrame, order: list, size: int) -> DataFrame:
    """``nodes`` (grp, leaf and others) with seg, segs and at: the segment of a node within its group, how many the
    group has, and a number that ascends with the order within a segment. Written."""
    nodes = staged(nodes.withColumn("at", F.monotonically_increasing_id()), "nodes")
    key = ["grp", *[F.asc_nulls_first(c) for c in order], "at"]
    rows = nodes.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id())
    rows = staged(rows, "sorted").withColumn("part", F.shiftright("at", 33))
    # One row for each group and partition that holds some of it; a group's rows here are as many as its partitions.
    counts = rows.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("grp").alias("_g"), F.col("part").alias("_p"), "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.ceil(F.sum("n").over(whole) / size).alias("segs"))
    found = rows.join(counts, (F.col("grp") == F.col("_g")) & (F.col("part") == F.col("_p")))
    seg = F.floor((F.col("at") - F.col("first") + F.col("before")) / size)
    return staged(found.withColumn("seg", seg).drop("_g", "_p", "part", "first", "before"), "placed")


def _levels(leaves: list, fanout: int, height) -> list:
    """The nodes of each level above a segment's leaves, ``height`` levels or, if None, up to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        last = levels[-1]
        levels.append([digest_of("".join(last[i:i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def _segments(batches):
    """(grp, seg, rows) of each segment of a partition sorted by both."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    for (grp, seg), part in groupby(rows, lambda row: row[:2]):
        yield grp, seg, list(part)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def subtrees(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """grp, seg, segs, node: the root of each segment."""
    schema = pa.schema([("grp", pa.string()), ("seg", pa.int64()), ("segs", pa.int64()), ("node", pa.string())])

    def read(batches):
        for grp, seg, part in _segments(batches):
            segs = part[0][2]
            top = _levels([row[3] for row in part], fanout, height if segs > 1 else None)[-1]
            yield _batch([(grp, seg, segs, top[0])], schema)

    return (nodes.select("grp", "seg", "segs", "leaf", "at").repartition("grp", "seg").sortWithinPartitions("grp", "seg", "at")
            .drop("at").mapInArrow(read, "grp string, seg long, segs long, node string"))


def rounds_of(segs: int, fanout: int) -> int:
    rounds, width = 0, 1
    while width < segs:
        rounds, width = rounds + 1, width * fanout
    return rounds


def exchange(state: DataFrame, stride: int, fanout: int) -> DataFrame:
    """One round: partners swap their nodes, and each hashes the parent and notes its siblings."""
    digit = F.floor(F.col("seg") / stride) % fanout
    goes_on = F.col("segs") > stride
    base = F.when(goes_on, F.col("seg") - digit * stride).otherwise(F.col("seg"))
    member = F.struct(F.when(goes_on, digit).otherwise(F.lit(0)).cast("int").alias("digit"), "seg", "node", "path")
    met = state.groupBy("grp", base.alias("base"), "segs").agg(F.sort_array(F.collect_list(member)).alias("m"))
    met = met.select("grp", "segs", "m", F.transform("m", lambda x: F.coalesce(x["node"], F.lit(""))).alias("nodes"))
    whole = F.array_join("nodes", "")
    parent = F.when(~goes_on, F.col("nodes")[0]).when(whole != "", F.sha2(whole.cast("binary"), 256))
    met = met.select("grp", "segs", "nodes", parent.alias("parent"), F.explode("m").alias("x"))
    side = F.struct(F.array_join(F.slice("nodes", F.lit(1), F.col("x.digit")), "").alias("left"),
                    F.array_join(F.slice("nodes", F.col("x.digit") + 2, F.lit(fanout)), "").alias("right"))
    return met.select("grp", F.col("x.seg").alias("seg"), "segs", F.col("parent").alias("node"),
                      F.when(goes_on, F.concat("x.path", F.array(side))).otherwise(F.col("x.path")).alias("path"))


def butterfly(segments: DataFrame, fanout: int) -> DataFrame:
    """grp, seg, node, path: the subroot of the group and the siblings above the segment's own root."""
    segments = segments.withColumn("path", F.expr(f"cast(array() as {PATH})"))
    alone = segments.filter("segs = 1").select("grp", "seg", "node", "path")
    state = segments.filter("segs > 1")
    most = state.agg(F.max("segs")).first()[0] or 1
    rounds = rounds_of(most, fanout)
    # Numbers beyond the last segment, up to a power of the fanout, take part without a root of their own.
    width = F.lit(fanout ** rounds)
    for r in range(rounds - 1, 0, -1):
        width = F.when(F.col("segs") <= fanout ** r, F.lit(fanout ** r)).otherwise(width)
    filled = (state.filter(F.col("seg") == F.col("segs") - 1).filter(width > F.col("segs")).select(
        "grp", F.explode(F.sequence(F.col("segs"), width - 1)).alias("seg"), "segs", F.lit(None).cast("string").alias("node"), "path"))
    state = state.unionByName(filled)
    for r in range(rounds):
        state = exchange(state, fanout ** r, fanout)
        if r % ROUNDS_A_PLAN == ROUNDS_A_PLAN - 1:
            state = staged(state, f"round-{r}")
    return alone.unionByName(state.filter("seg < segs").select("grp", "seg", "node", "path"))


def _handed_out(nodes: DataFrame, upper: DataFrame, fanout: int, height: int, names: list) -> DataFrame:
    """The named columns of the nodes with root and path: the segment's subtree, then ``upper`` (grp, seg, above, root)."""
    keep = F.struct(*names)
    kind = nodes.select(keep.alias("own")).schema["own"].dataType
    ddl = f"own {kind.simpleString()}, root string, path {PATH}"

    def read(batches):
        for _, _, part in _segments(batches):
            (_, _, segs, _, _, above, root), rows = part[0], part[1:]
            segs = rows[0][2]
            levels = _levels([row[3] for row in rows], fanout, height if segs > 1 else None)[:-1]
            for a in range(0, len(rows), 512):
                own, paths = [row[4] for row in rows[a:a + 512]], []
                for i in range(a, min(a + 512, len(rows))):
                    path = []
                    for level in levels:
                        first = i - i % fanout
                        path.append({"left": "".join(level[first:i]), "right": "".join(level[i + 1:first + fanout])})
                        i //= fanout
                    paths.append(path + above)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, types[0]), pa.array([root] * len(own), pa.string()), pa.array(paths, types[1])],
                    ["own", "root", "path"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(f"own {kind.simpleString()}, path {PATH}")]
    nothing = F.expr(f"cast(null as {kind.simpleString()})")
    head = upper.select("grp", "seg", F.lit(None).cast("long").alias("segs"), F.lit(None).cast("string").alias("leaf"),
                        nothing.alias("own"), "above", "root", F.lit(-1).cast("long").alias("at"))
    own = nodes.select("grp", "seg", "segs", "leaf", keep.alias("own"), F.lit(None).cast(PATH).alias("above"),
                       F.lit(None).cast("string").alias("root"), "at")
    return (own.unionByName(head).repartition("grp", "seg").sortWithinPartitions("grp", "seg", "at").drop("at")
            .mapInArrow(read, ddl).select("own.*", "root", "path"))


def height_of(fanout: int, segment: int = SEGMENT) -> int:
    height = 1
    while fanout ** (height + 1) <= segment:
        height += 1
    return height


def manifest(docs: DataFrame, fields=FIELDS, key: str = "doc_id", group: str = "lang", fanout: int = 2, carry: dict = None,
             segment: int = SEGMENT) -> DataFrame:
    """key, leaf, subroot, root, path for each row, and the columns of ``carry`` (name -> Column over ``docs``)."""
    carry = carry or {}
    height = height_of(fanout, segment)
    size = fanout ** height
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp")  # null first, then by bytes
    nodes = docs.select(grp, F.col(key).alias(key), leaf(*map(F.col, fields)).alias("leaf"), *[c.alias(n) for n, c in carry.items()])
    nodes = placed(nodes, [key, "leaf"], size)
    upper = staged(butterfly(staged(subtrees(nodes, fanout, height), "subtrees"), fanout), "upper")

    groups = upper.filter("seg = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("node").alias("leaf"))
    groups = placed(groups, ["name"], size)
    top = butterfly(staged(subtrees(groups, fanout, height), "top-subtrees"), fanout)
    top = _handed_out(groups, top.select("grp", "seg", F.col("path").alias("above"), F.col("node").alias("root")),
                      fanout, height, ["name", "leaf"])
    top = staged(top.withColumnRenamed("leaf", "subroot").withColumnRenamed("path", "rest"), "top")

    upper = upper.join(top, F.col("grp") == F.col("name"))
    above = upper.select("grp", "seg", F.concat("path", "rest").alias("above"), "root")
    nodes = nodes.join(top.select("name", "subroot"), F.col("grp") == F.col("name"))
    return _handed_out(nodes, above, fanout, height, [key, "leaf", "subroot", *carry])


def tampered(docs: DataFrame) -> Column:
    """The leaf after the contract's tampering, null where a row is left alone: 1 more in n_chars where 7 divides the
    crc32 of the decimal id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    return F.when(hit, leaf(*changed))


def digest(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    found = manifest(docs, carry={"altered": tampered(docs)}, segment=segment)
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
                         folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
