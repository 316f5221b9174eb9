"""Chat formatting and mixing: Spark expressions against plain Python."""

import hashlib

from pyspark.sql import functions as F

from waymark.llm import chat, mixing

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a <|im_end|>\n<|turn|> ~1 ~ ~0 <|", "x"), (1, 1, "user", "", "x"), (1, 2, "assistant", "é<|turn|>", "x"),
        (1, 2, "assistant", "é<|turn|>", "x"), (1, 3, "assistant", None, "x"), (1, None, None, "first", "x"),
        (2, 0, "assistant", "</s>[INST]", "x"), (None, 0, "odd\nrole<|~", "t", "x"),
    ]
    got = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(spark.createDataFrame(rows, TURNS))).collect()}
    for conv in (1, 2, None):
        want = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv), key=lambda k: (k[0] is not None, k))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [w[1:] for w in want]
        assert got[conv]["loss_text"] == "".join(x for _, r, x in want if r == "assistant")
    assert got[1]["formatted"].count("<|im_start|>") == 3  # the turns of a run share a block


def test_chat_digest_and_empty(spark):
    one = spark.createDataFrame([(5, 0, "user", "hi", "x"), (5, 1, "assistant", "hó", "x")], TURNS)
    r = chat.chat_digest(one).collect()[0]
    assert (r["n_turns"], r["loss_chars"]) == (2, 2)
    assert r["turns_sha256"] == hashlib.sha256("user\nhi\nassistant\nhó\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256("hó".encode()).hexdigest()
    assert chat.chat_digest(spark.createDataFrame([], TURNS)).count() == 0


def share(budget, children):
    """Whole-token water filling, one child after the other."""
    out, rest = {}, sum(w for _, _, w in children)
    left = budget
    for name, cap, w in sorted(children, key=lambda c: (c[1] / c[2], c[0])):
        if cap * rest <= w * left and len(out) == len([c for c in out if out[c] is not None]):
            out[name] = cap
            left, rest = left - cap, rest - w
        else:
            break
    for name, cap, w in children:
        if name not in out:
            out[name] = w * left // rest
    return out


def test_mixing_against_plain_python(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), ["en", "de", None][i % 3], f"src{i % 5}" if i % 11 else None, "extra")
            for i in range(400)] + [(400, None, "en", "src1", "e"), (401, "", "en", "src1", "e"), (None, "a b", "fr", "src2", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget string")
    got = {r["doc_id"]: r["mix_epochs"] for r in mixing.mix(docs).collect()}
    domains = {r["s"]: r["d"] for r in spark.createDataFrame([(f"src{i}",) for i in range(5)] + [("none",)], "s string").select(
        "s", mixing.domain_of(F.col("s")).alias("d")).collect()}
    md = lambda t: hashlib.md5(t.encode()).hexdigest()
    leaves = {}
    for i, text, lang, source, _ in rows:
        source = source or "none"
        leaves.setdefault((domains[source], lang or "und", source), []).append((i, len((text or "").split())))
    leaves = {k: v for k, v in leaves.items() if sum(n for _, n in v)}
    weight = lambda level, name: mixing.WEIGHTS[level].get(name, 1)
    total = sum(n for v in leaves.values() for _, n in v)
    budget = {(): min(total * 2 // 5, total * mixing.EPOCHS)}
    for depth, level in enumerate(("domain", "lang", "source")):
        for parent in [p for p in budget if len(p) == depth]:
            kids = sorted({k[:depth + 1] for k in leaves if k[:depth] == parent})
            caps = [(k, sum(n for q, v in leaves.items() if q[:depth + 1] == k for _, n in v) * mixing.EPOCHS,
                     weight(level, k[-1])) for k in kids]
            budget |= share(budget[parent], caps)
    want = {}
    for leaf, docs_of in leaves.items():
        full, part = divmod(budget[leaf], sum(n for _, n in docs_of))
        text = lambda i: "" if i is None else str(i)
        order = sorted(docs_of, key=lambda d: (md(f"42:{full}:{md(f'42:{text(d[0])}')[:3]}"), md(f"42:{full}:{text(d[0])}")))
        run = 0
        for i, n in order:
            run += n
            want[i] = full + (run <= part)
    assert got == {i: n for i, n in want.items() if n}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_native_plans_hold_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "src1")], "doc_id long, text string, lang string, source string")
    turns = spark.createDataFrame([(5, 0, "user", "hi", "x")], TURNS)
    for df in (mixing.mix(docs), chat.chat_digest(turns)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
