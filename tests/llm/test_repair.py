"""Conversation repair against all edit strings, in chunks of any size, and against SQL."""

import hashlib
import itertools
import random
import zlib

import pytest

import check
from waymark.llm import repair

INITIALS = ("s", "u", "a", "")
SYMBOLS = [(None, 0)] + [(i, t) for i in INITIALS for t in (0, 1)]


def cost_of(edits: str, syms: list):
    """Cost of an edit string, None where it does not fit the rows or the pattern."""
    at, out, cost = 0, "", 0
    for e in edits:
        after = "a" if out.endswith("u") else "u"
        if e == "I":
            out, cost = out + after, cost + 2
            continue
        if at == len(syms):
            return None
        initial, extra = syms[at]
        at += 1
        if e == "D":
            cost += 3
        elif initial is None:
            return None
        elif e == "R":
            out, cost = out + after, cost + 2 + extra
        elif initial == "s" and out == "" or initial == after:
            out, cost = out + initial, cost + extra
        else:
            return None
    body = out[1:] if out.startswith("s") else out
    fits = at == len(syms) and body == "ua" * (len(body) // 2) and (body or not out)
    return cost if fits else None


def brute(syms: list):
    found = []
    for inserts in range(len(syms) + 2):
        for edits in itertools.product("DIKR", repeat=len(syms) + inserts):
            if edits.count("I") == inserts:
                cost = cost_of(edits, syms)
                if cost is not None:
                    found.append((cost, "".join(edits)))
    return min(found)


def program(syms: list, chunk: int, powers):
    """The steps of the operator without Spark: matrices, targets, edits."""
    chunks = [repair.runs_of(syms[i:i + chunk]) for i in range(0, len(syms), chunk)]
    costs, behind = repair.ENDED, []
    for runs in reversed(chunks):
        behind.append(costs)
        costs = repair.apply(repair.matrix(runs, powers), costs)
    state, edits = repair.START, ""
    for runs, ahead in zip(chunks, reversed(behind)):
        state, part = repair.unrolled(runs, ahead, [state], powers)[state]
        edits += part
    return costs[repair.START], edits + repair.last_inserts(state)


def test_program_against_all_edit_strings():
    rng, powers = random.Random(5), repair.Powers()
    for n in range(1, 5):
        for _ in range(12):
            syms = [rng.choice(SYMBOLS) for _ in range(n)]
            if rng.random() < 0.5:
                syms = sorted(syms, key=str)
            for chunk in (1, 2, 3, 10):
                assert program(syms, chunk, powers) == brute(syms), syms


def test_long_runs_need_few_products_and_split_anywhere():
    powers, user = repair.Powers(), ("u", 0)
    syms = [("s", 0)] + [user] * 5000 + [("a", 1)] * 3000
    whole = program(syms, 10 ** 6, powers)
    assert whole == program(syms, 1024, powers) == program(syms, 37, repair.Powers())
    assert cost_of(whole[1], syms) == whole[0]
    assert len(powers.levels[user]) == 13 and len(powers.unrolled) < 500


def reference(rows):
    """The contract by plain Python: {conversation: result}."""
    kept = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        here = kept.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        here += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, here in kept.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, syms, counts = set(), [], dict.fromkeys("bdt", 0)
        for _, role, text in here:
            body = text.strip(" \t\n\v\f\r")
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            syms.append(repair.symbol(role[:1], fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(here, here[1:]))
        turns = [t for t, _, _ in here if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = brute(syms) if len(syms) < 5 else program(syms, 10 ** 6, repair.Powers())
        lines, at = [], 0
        for e in audit:
            fits = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
            if e == "I":
                lines.append((fits, ""))
                continue
            if e != "D":
                lines.append((here[at][1] if e == "K" else fits, here[at][2]))
            at += 1
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest)
    return out


def conversations():
    rng = random.Random(11)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Hi.", "no end", "Why?", " ", "", None, "«ü»!"]
    rows = []
    for conv in [None, *range(40)]:
        rows += [(conv, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {k}.")
                 for k in range(rng.randint(1, 7))]
    rows += [(77, t, "user" if t % 3 else "assistant", f"Row {t % 50}{'.' if t % 7 else ''}") for t in range(300)]
    rows += [(78, None, "user", "Same.")] * 120                                # one turn, one text
    rows += [(conv, 0, "user", "Alone.") for conv in range(100, 140)]          # some lose their only row
    return rows + rows[:30]


@pytest.mark.parametrize("bits", [2, 10])
def test_conversations_against_plain_python(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rows = [(*r, "x", 1) for r in conversations()]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, kind string, at int").repartition(5)
    got = repair.repair_damaged(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r)[1:] for r in got.collect()}
    expected = reference([r[:4] for r in rows])
    assert any(v[-2:] == ("", repair.EMPTY) and v[5] == 0 for v in got.values())
    assert got == expected


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "assistant", "Yes."), (1, 1, "user", "And?"), (2, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.audit, [tuple(t) for t in r.turns]) for r in repair.repair(df, turns=True).collect()}
    # Deleting the first turn and answering the second costs 5, both insertions 4.
    assert got == {1: ("IKKI", [("user", ""), ("assistant", "Yes."), ("user", "And?"), ("assistant", "")]), 2: ("D", [])}
    assert repair.repair_damaged(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    text, _, ok = check.compare(spark, check.database(sf), sf, "op11_structure_repair")
    assert ok, text
