"""Operator 3, chat formatting: Spark expressions only.

A conversation becomes one string of blocks, one block for each run of turns of a role:

    <|im_start|>ROLE\\nTEXT<|turn|>TEXT<|im_end|>\\n

``<|turn|>`` keeps the turns of a merged block apart, so the turns can be read back. Inside texts
``~`` is written ``~0`` and ``<|`` is written ``~1`` (in roles also a newline as ``~2``), so no
text can hold a control string, and unescaping gives back every text.

Defined cases: null role or text counts as empty; turns of equal number are ordered by role, then
text; a null turn number comes first; rows of a null conversation id form one conversation; repeated rows
are turns of their own; further columns are ignored. A conversation is one output value,
so it must fit a row, as any string must.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, role: bool = False) -> Column:
    c = _replace(_replace(c, "~", "~0"), "<|", "~1")
    return _replace(c, "\n", "~2") if role else c


def unescape(c: Column, role: bool = False) -> Column:
    c = _replace(c, "~2", "\n") if role else c
    return _replace(_replace(c, "~1", "<|"), "~0", "~")


def format_chat(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask (one entry a block: whether it is under the loss). Time is linear in a conversation's length."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    first = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    starts = turns.withColumn("first", first)
    ends = F.concat(F.slice("first", 2, F.size("first")), F.array(F.size("turns") + 1))
    runs = starts.withColumn("runs", F.arrays_zip(F.col("first").alias("a"), ends.alias("z")))

    def block(run):
        texts = F.slice("turns", run["a"], run["z"] - run["a"])
        body = F.array_join(F.transform(texts, lambda t: escape(t["text"])), TURN)
        role = F.element_at("turns", run["a"])["role"]
        return F.struct(role.alias("role"), F.concat(F.lit(START), escape(role, True), F.lit("\n")).alias("head"),
                        body.alias("body"))

    blocks = runs.select("conv_id", F.transform("runs", block).alias("blocks"))

    return blocks.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b["body"], F.lit(END))), "").alias("formatted"),
        F.transform("blocks", lambda b: b["role"] == loss_role).alias("loss_mask"))


def _pieces() -> Column:
    """The blocks of a formatted conversation, without their ends."""
    return F.filter(F.split("formatted", r"\Q" + END + r"\E"), lambda b: b != "")


def loss_spans(formatted: DataFrame) -> DataFrame:
    """conv_id, start, length: the parts of ``formatted`` under the loss in code points, one row a block, from running sums
    over the blocks."""
    rows = formatted.select("conv_id", "loss_mask", F.posexplode(_pieces()).alias("k", "block"))
    head = F.instr("block", "\n")
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("block") + len(END)).over(before), F.lit(0))
    found = rows.select("conv_id", F.col("loss_mask")[F.col("k")].alias("loss"), (begin + head).alias("start"),
                        (F.length("block") - head).cast("long").alias("length"))
    return found.filter("loss").drop("loss")


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text: read back from the output of ``format_chat``, block by block."""
    def texts(block):
        line = F.instr(block, "\n")
        return F.split(F.substring(block, line + 1, F.length(block)), r"\Q" + TURN + r"\E")

    def turns(block):
        line = F.instr(block, "\n")
        role = unescape(F.substring(block, F.lit(len(START) + 1), line - (len(START) + 1)), True)
        return F.transform(texts(block), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    def masked(block, i):
        body = F.array_join(F.transform(texts(block), lambda t: unescape(t)), "")
        return F.when(F.col("loss_mask")[i], body).otherwise("")

    cut = formatted.select("conv_id", "formatted", "loss_mask", _pieces().alias("pieces"))
    return cut.select(
        "conv_id", "formatted", F.flatten(F.transform("pieces", turns)).alias("turns"),
        F.array_join(F.transform("pieces", masked), "").alias("loss_text"))


def chat_digest(rows: DataFrame) -> DataFrame:
    back = read_chat(format_chat(rows))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
