"""Operator 11, conversation structure repair: run-length dynamic programming over min-plus transitions.

A row is a symbol: its role initial (``s``, ``u``, ``a``, other) with its fault (must go, truncated, none). Repair edits the
rows so that the role initials read ``(s?(ua)+)?``; the edits and their costs:

    Keep 0 | Rerole to user or assistant 2 | Delete 3 | Insert an empty user or assistant turn 2

Blank and duplicate rows must be deleted; a truncated row that stays costs 1 more. ``audit`` holds the initials of the
cheapest edits in order, the ASCII-least of equally cheap ones.

Equal consecutive symbols are one run. What a run of n rows does to the four states of the pattern is the n-th min-plus power of
its symbol's transition matrix, put together from cached binary powers. A run is unrolled by halves: the costs behind the first
half are a power times the costs behind the run, so memory is logarithmic in the run, and equal halves with equal costs ahead are
looked up. Transitions are associative, so a long conversation is cut into chunks of at most ``CHUNK`` rows that different
tasks work on:

1. ``ordered``: rows sorted over the whole table by (conversation, turn, role, digest of the text) and written; the
   place of a row numbers chunks. A conversation with a third of all rows lies in as many partitions as its rows need.
2. ``symbols``: faults; the first place of each repeated (role, text) is aggregated and joined back with salts.
3. ``matrices``: a matrix for each chunk. ``targets``: the cheapest cost behind each chunk, in a stream over chunks.
4. ``options``: for each chunk and each state it may begin in, the end state and the edits.
5. ``repaired``: one stream over chunk options and rows in order gives the result of each conversation. A digest over a
   whole conversation cannot be split, so this last stream reads a conversation in one task, row by row, holding its audit.

Defined cases: null ids, roles and texts read as one space where they are text; rows of a null id are one
conversation; null turns come first; rows of an equal turn are ordered by role, then md5 of the text; repeated rows are
duplicates; an empty table gives no rows; a conversation that loses all rows gives zeros and an empty audit; further columns are
ignored, whatever their names.
"""

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.textops import staged

CHUNK_BITS = 10
CHUNK = 1 << CHUNK_BITS
SALTS = 16
CACHE = 20_000          # unrolled halves a task remembers
FAR = 1 << 40           # no way

START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
ACCEPTED = (0, FAR, FAR, 0)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NEXT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
TURN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U, AFTER_U: AFTER_A}  # the one user or assistant turn that fits
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}


# Rows -----------------------------------------------------------------------------------------------------------------

def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` modulo 20 names."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"),
                      _text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("again")).drop("again")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) sorted over the whole table and written, with ``digest`` and ``at``, the place
    in that order. The row number splits a group of equal rows over partitions as well."""
    rows = rows.select("conv_id", "turn", "role", "text", F.md5("text").alias("digest"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "damaged")
    key = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest", "row")]
    sorted_rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    return staged(sorted_rows.drop("row").withColumn("at", F.monotonically_increasing_id()), "ordered")


def symbols(rows: DataFrame) -> DataFrame:
    """at, conv_id, turn, chunk, initial and fault (``b``lank, ``d``uplicate, ``t``runcated or empty) of ordered rows."""
    known = rows.select(
        "conv_id", "turn", "role", "digest", "at", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))
    repeated = (known.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n"))
                .filter("n > 1"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    repeated = repeated.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first", salts)
    known = known.withColumn("salt", (F.col("at") % SALTS).cast("int"))
    same = (F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
            & (known["salt"] == repeated["salt"]))
    fault = (F.when(F.col("blank"), "b").when(F.col("at") > F.col("first"), "d").when(F.col("truncated"), "t").otherwise(""))
    return staged(known.join(repeated, same, "left").select(
        "at", "conv_id", "turn", F.shiftright("at", CHUNK_BITS).alias("chunk"), "initial", fault.alias("fault")), "symbols")


# The program ----------------------------------------------------------------------------------------------------------

def symbol(initial: str, fault: str) -> tuple:
    """(initial that may be kept, surcharge of a row that stays); initial None: the row must be deleted."""
    if fault in ("b", "d"):
        return None, 0
    return initial if initial in NEXT else "", TRUNCATED if fault == "t" else 0


def _row_edits(sym: tuple, state: int) -> list:
    """(initial, cost, next state) of the edits that use up a row."""
    initial, extra = sym
    out = [("D", DELETE, state)]
    if initial is not None:
        if state in NEXT.get(initial, ()):
            out.append(("K", extra, NEXT[initial][state]))
        out.append(("R", REROLE + extra, TURN[state]))
    return out


def times(a: tuple, b: tuple) -> tuple:
    """Min-plus product of matrices."""
    return tuple(tuple(min(min(row[k] + b[k][j] for k in STATES), FAR) for j in STATES) for row in a)


def apply(m: tuple, costs: tuple) -> tuple:
    """Costs ahead of a matrix, given the costs behind it."""
    return tuple(min(min(row[k] + costs[k] for k in STATES), FAR) for row in m)


def _closed(costs) -> tuple:
    """Costs with insertions in front."""
    costs = list(costs)
    for _ in STATES:
        for s in STATES:
            costs[s] = min(costs[s], INSERT + costs[TURN[s]])
    return tuple(costs)


ENDED = _closed(ACCEPTED)   # costs after the last row
IDENTITY = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)


class Powers:
    """Cached binary powers of each symbol's transition, and unrolled halves."""

    def __init__(self):
        self.levels, self.unrolled = {}, {}

    def single(self, sym: tuple) -> tuple:
        columns = []
        for j in STATES:
            end = tuple(0 if k == j else FAR for k in STATES)
            columns.append(_closed(min([c + end[to] for _, c, to in _row_edits(sym, s)]) for s in STATES))
        return tuple(tuple(min(columns[j][i], FAR) for j in STATES) for i in STATES)

    def power(self, sym: tuple, k: int) -> tuple:
        """The transition over 2^k rows of the symbol."""
        levels = self.levels.setdefault(sym, [])
        while len(levels) <= k:
            levels.append(times(levels[-1], levels[-1]) if levels else self.single(sym))
        return levels[k]

    def run(self, sym: tuple, n: int) -> tuple:
        out = None
        for k in range(n.bit_length() - 1, -1, -1):
            if n >> k & 1:
                out = self.power(sym, k) if out is None else times(out, self.power(sym, k))
        return out

    def unroll(self, sym: tuple, k: int, state: int, costs: tuple) -> tuple:
        """(edits, end state) of the cheapest way through 2^k rows from ``state``, ``costs`` behind them."""
        low = min(costs)
        costs = tuple(min(c - low, FAR) for c in costs)
        key = sym, k, state, costs
        if key not in self.unrolled:
            if k == 0:
                found = self._one(sym, state, costs)
            else:
                first, middle = self.unroll(sym, k - 1, state, apply(self.power(sym, k - 1), costs))
                second, end = self.unroll(sym, k - 1, middle, costs)
                found = first + second, end
            if len(self.unrolled) >= CACHE:
                self.unrolled.clear()
            self.unrolled[key] = found
        return self.unrolled[key]

    def _one(self, sym: tuple, state: int, costs: tuple) -> tuple:
        ahead = _closed(min(c + costs[to] for _, c, to in _row_edits(sym, s)) for s in STATES)
        edits = ""
        while True:
            ways = [(e, to) for e, c, to in _row_edits(sym, state) if c + costs[to] == ahead[state]]
            if INSERT + ahead[TURN[state]] == ahead[state]:
                ways.append(("I", TURN[state]))
            edit, state = min(ways)
            edits += edit
            if edit != "I":
                return edits, state


def runs_of(syms) -> list:
    return [(sym, sum(1 for _ in same)) for sym, same in groupby(syms)]


def matrix(runs: list, powers: Powers) -> tuple:
    out = IDENTITY
    for sym, n in runs:
        m = powers.run(sym, n)
        out = m if out is IDENTITY else times(out, m)
    return out


def unrolled(runs: list, costs: tuple, states, powers: Powers) -> dict:
    """state -> (end state, edits) through the runs, with ``costs`` behind them."""
    pieces = [(sym, k) for sym, n in runs for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    behind = []
    for sym, k in reversed(pieces):
        behind.append(costs)
        costs = apply(powers.power(sym, k), costs)
    found = {}
    for begin in states:
        if costs[begin] >= FAR:
            continue
        state, edits = begin, []
        for (sym, k), ahead in zip(pieces, reversed(behind)):
            part, state = powers.unroll(sym, k, state, ahead)
            edits.append(part)
        found[begin] = state, "".join(edits)
    return found


def last_inserts(state: int) -> str:
    """Insertions after the last row."""
    edits = ""
    while ACCEPTED[state]:
        edits, state = edits + "I", TURN[state]
    return edits


# Streams --------------------------------------------------------------------------------------------------------------

def _grouped(batches, keys: int):
    """(key, rows) of consecutive rows that agree in their first ``keys`` columns, over all batches of a partition."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    return groupby(rows, lambda row: row[:keys])


def _in_batches(rows, schema: pa.Schema, size: int = 1000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _conv(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _schema(kind: str, rest: str) -> tuple:
    """DDL and Arrow schema of a table that begins with the conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    ddl = f"conv_id {kind}, {rest}"
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def matrices(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, cost: the 16 entries of the chunk's matrix, by rows."""
    ddl, schema = _schema(_conv(rows), "chunk long, cost array<long>")

    def read(batches):
        powers = Powers()

        def found():
            for (chunk, conv), part in _grouped(batches, 2):
                m = matrix(runs_of(symbol(i, f) for _, _, i, f in part), powers)
                yield conv, chunk, [c for row in m for c in row]

        yield from _in_batches(found(), schema)

    return (rows.select("chunk", "conv_id", "initial", "fault", "at").repartition("chunk")
            .sortWithinPartitions("chunk", F.asc_nulls_first("conv_id"), "at").drop("at").mapInArrow(read, ddl))


def targets(found: DataFrame) -> DataFrame:
    """conv_id, chunk, behind: the four costs after each chunk; a stream over the chunks of a conversation from its end."""
    ddl, schema = _schema(_conv(found), "chunk long, behind array<long>")

    def read(batches):
        def walked():
            for _, part in _grouped(batches, 1):
                costs = ENDED
                for conv, chunk, m in part:
                    yield conv, chunk, list(costs)
                    costs = apply(tuple(tuple(m[4 * i:4 * i + 4]) for i in STATES), costs)

        yield from _in_batches(walked(), schema)

    return (found.select("conv_id", "chunk", "cost").repartition("conv_id")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("chunk")).mapInArrow(read, ddl))


OPTION = ("chunk long, ways array<struct<begin:int,end:int,edits:string>>, cost array<long>, n_rows long, blank long, "
          "duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long")


def options(rows: DataFrame, behind: DataFrame) -> DataFrame:
    """For each chunk of a conversation the edits from each state it may begin in, and its counts."""
    ddl, schema = _schema(_conv(rows), OPTION)

    def read(batches):
        powers = Powers()

        def found():
            for (chunk, conv), part in _grouped(batches, 2):
                part = list(part)                       # the target, then at most CHUNK rows
                costs, part = tuple(part[0][2]), part[1:]
                runs = runs_of(symbol(r[4], r[5]) for r in part)
                ahead = apply(matrix(runs, powers), costs)
                ways = unrolled(runs, costs, STATES, powers)
                faults, initials = [r[5] for r in part], [r[4] for r in part]
                turns = [r[3] for r in part if r[3] is not None]
                legal = sum(a + b in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                yield (conv, chunk, [{"begin": s, "end": e, "edits": w} for s, (e, w) in ways.items()], list(ahead), len(part),
                       faults.count("b"), faults.count("d"), faults.count("t"), len(part) - 1 - legal, initials[0], initials[-1],
                       len(set(turns)), min(turns, default=None), max(turns, default=None))

        yield from _in_batches(found(), schema, 200)

    own = rows.select("chunk", "conv_id", F.lit(None).cast("array<long>").alias("behind"), "turn", "initial", "fault", "at")
    aim = behind.select("chunk", "conv_id", "behind", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("initial"),
                        F.lit(None).cast("string").alias("fault"), F.lit(-1).cast("long").alias("at"))
    return (own.unionByName(aim).repartition("chunk")
            .sortWithinPartitions("chunk", F.asc_nulls_first("conv_id"), "at").drop("at").mapInArrow(read, ddl))


RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
EMPTY = hashlib.sha256(b"").hexdigest()


class Repaired:
    """A conversation on its way through the last stream."""

    def __init__(self, keep: bool):
        self.state, self.audit, self.chunk, self.cost = START, [], None, None
        self.counts, self.turns, self.low, self.high, self.last, self.top = [0] * 4, 0, None, None, None, None
        self.digest, self.lines, self.emitted = hashlib.sha256(), [] if keep else None, 0

    def enter(self, option: dict):
        if self.cost is None:
            self.cost = option["cost"][START]
        way = next(w for w in option["ways"] if w["begin"] == self.state)
        self.edits, self.place, self.walk, self.state = way["edits"], 0, self.state, way["end"]
        self.audit.append(self.edits)
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[k] += option[name]
        if self.last is not None:
            self.counts[3] += self.last + option["first"] not in ("su", "ua", "au")
        self.last = option["last"]
        if option["low"] is not None:
            # Rows come by turn, so only the turn at the border can stand in both chunks.
            self.turns += option["turns"] - (option["low"] == self.high)
            self.low = option["low"] if self.low is None else self.low
            self.high = option["high"]

    def write(self, role: str, text: str):
        line = f"{role}:{text}"
        self.digest.update(("\n" if self.emitted else "").encode() + line.encode("utf-8", "surrogatepass"))
        self.emitted += 1
        if self.lines is not None:
            self.lines.append((role, text))

    def inserts(self, edits: str):
        for _ in edits:
            self.walk = TURN[self.walk]
            self.write(ROLE[self.walk], "")

    def row(self, role: str, text: str):
        place = self.place
        while self.edits[place] == "I":
            place += 1
        self.inserts(self.edits[self.place:place])
        edit, self.place = self.edits[place], place + 1
        if edit == "K":
            self.walk = NEXT[role[:1]][self.walk]
            self.write(role, text)
        elif edit == "R":
            self.walk = TURN[self.walk]
            self.write(ROLE[self.walk], text)

    def end(self) -> tuple:
        more = last_inserts(self.state)
        self.inserts(more)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts, self.cost, "".join(self.audit) + more, self.digest.hexdigest())


def repaired(rows: DataFrame, chosen: DataFrame, turns: bool = False) -> DataFrame:
    """One row for each conversation that has rows; with ``turns`` also the repaired turns."""
    more = ", turns array<struct<role:string,text:string>>" if turns else ""
    ddl, schema = _schema(_conv(rows), RESULT + more)
    names = [f.split()[0].strip() for f in ("chunk", "ways", "cost", "blank", "duplicate", "truncated", "illegal", "first", "last",
                                            "turns", "low", "high")]

    def read(batches):
        def found():
            for (conv,), part in _grouped(batches, 1):
                c = Repaired(turns)
                for _, option, role, text in part:
                    if option is not None:
                        c.enter(option)
                    else:
                        c.row(role, text)
                out = (conv, *c.end())
                yield (*out, [{"role": r, "text": t} for r, t in c.lines]) if turns else out

        yield from _in_batches(found(), schema, 200)

    option = chosen.select("conv_id", F.struct(*names).alias("option"), F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("string").alias("text"), "chunk", F.lit(-1).cast("long").alias("at"))
    own = rows.select("conv_id", F.lit(None).cast(option.schema["option"].dataType).alias("option"), "role", "text",
                      F.shiftright("at", CHUNK_BITS).alias("chunk"), "at")
    return (option.unionByName(own).repartition("conv_id")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), "chunk", "at").drop("chunk", "at").mapInArrow(read, ddl))


def repair(rows: DataFrame, turns: bool = False) -> DataFrame:
    """The result of each conversation of the rows as given (conv_id, turn, role, text; none of role and text null)."""
    whole = ordered(rows)
    known = symbols(whole)
    chosen = staged(options(known, targets(matrices(known))), "options")
    return repaired(whole, chosen, turns)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The contract's digest: every conversation of the table, repaired after its damage."""
    found = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("_c")).distinct()
    joined = every.join(found, F.col("_c").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("_c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
