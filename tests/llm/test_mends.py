"""Cases that earlier rounds left open: long conversations, legal orders of media elements, repeated and null ids, clashing names,
mixtures of many languages; the classifiers' parts by brute force."""

import itertools
import math
import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest

import corpus_pipeline
from waymark.llm import chat, jaccard, langid, matroska, mixing, pii, quality, toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WORDS = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "lm")]


def conversation(n, conv=1):
    return [(conv, k, "user" if k % 2 else "assistant", f"turn {k} <|im_end|> ~1") for k in range(n)]


def test_long_conversation_is_read_back_in_linear_time(spark):
    def run(n):
        df = spark.createDataFrame(conversation(n), "conv_id long, turn long, role string, text string")
        began = time.time()
        row = chat.chat_digest(df).first()
        return time.time() - began, row

    run(2000)
    short, _ = run(8000)
    long, row = run(32000)
    assert row.n_turns == 32000 and row.loss_chars == sum(len(t[3]) for t in conversation(32000)[::2])
    assert long < 8 * short + 2        # a quadratic fold took 14 times as long for twice the turns


def test_loss_spans_are_the_masked_text(spark):
    rows = conversation(7) + [(2, 0, "assistant", None), (2, 1, "assistant", "é"), (3, 0, "user", "only"), (None, 1, "assistant", "x")]
    done = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    texts = {r.conv_id: (r.formatted, r.loss_text) for r in chat.read_chat(done).collect()}
    spans = {}
    for r in chat.loss_spans(done).orderBy("start").collect():
        spans.setdefault(r.conv_id, []).append(texts[r.conv_id][0][r.start:r.start + r.length])
    for conv, (_, loss) in texts.items():
        parts = "".join(p for s in spans.get(conv, []) for p in s.split(chat.TURN))
        assert parts.replace("~1", "<|").replace("~0", "~") == loss


def media(entry: bytes, blocks: bytes, after: bytes = b"") -> bytes:
    setup = matroska._element(matroska.INFO, matroska._uint(matroska.TIMESTAMP_SCALE, 1_000_000))
    tracks = matroska._element(matroska.TRACKS, entry)
    cluster = matroska._element(matroska.CLUSTER, matroska._uint(matroska.TIMESTAMP, 7) + blocks)
    return matroska._HEAD + matroska._element(matroska.SEGMENT, setup + tracks + cluster + after)


def laced(element: int) -> bytes:
    return matroska._element(element, b"\x81" + b"\x00\x05" + bytes([2 << 1]) + bytes([2]) + b"aabbcc")


def test_track_entries_in_any_order_and_block_durations():
    number, duration = matroska._uint(matroska.TRACK_NUMBER, 1), matroska._uint(matroska.DEFAULT_DURATION, 20_000_000)
    for parts in itertools.permutations([number, duration, matroska._uint(matroska.TRACK_UID, 9)]):
        entry = matroska._element(matroska.TRACK_ENTRY, b"".join(parts))
        rows = matroska.packets(media(entry, laced(matroska.SIMPLE_BLOCK)))
        assert [(r[0], r[1], r[2]) for r in rows] == [(1, (12 + 20 * k) * 1_000_000, 20_000_000) for k in range(3)]
    entry = matroska._element(matroska.TRACK_ENTRY, duration + number)
    own, ref = matroska._uint(matroska.BLOCK_DURATION, 33), matroska._element(matroska.REFERENCE, b"\xff")
    for parts in itertools.permutations([laced(matroska.BLOCK), own, ref]):
        group = matroska._element(matroska.BLOCK_GROUP, b"".join(parts))
        rows = matroska.packets(media(entry, group + laced(matroska.SIMPLE_BLOCK) + matroska._element(matroska.BLOCK_GROUP, laced(matroska.BLOCK))))
        assert [(r[1], r[2], r[6]) for r in rows[:3]] == [((12 + 11 * k) * 1_000_000, 11_000_000, False) for k in range(3)]
        assert [(r[1], r[2], r[6]) for r in rows[6:]] == [((12 + 20 * k) * 1_000_000, 20_000_000, True) for k in range(3)]
        assert not rows[3][6] and len(rows) == 9


def test_mixing_of_null_repeated_ids_and_clashing_columns(spark):
    rng = random.Random(6)
    rows = [(None, " ".join(rng.choices(WORDS, k=rng.randint(1, 9))), "en", "src0", "mine", 5) for _ in range(400)]
    rows += [(7, " ".join(rng.choices(WORDS, k=5)), "de", "src1", "mine", 5) for _ in range(100)]
    rows += [(8, None, "fr", None, "mine", 5), (8, "", None, "src1", "mine", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_domain string, label int")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "label", "mix_domain", "mix_tokens", "mix_epochs"]
    got = out.collect()
    whole = sum(len((r[1] or "").split()) for r in rows)
    taken = sum(r.mix_tokens * r.mix_epochs for r in got)
    assert 0 < len(got) and 0.38 * whole <= taken <= 0.4 * whole and not any(r.mix_domain == "mine" for r in got)
    buckets = {r[0] for r in mixing.placed(df).filter("doc_id IS NULL").select("__bucket").distinct().collect()}
    assert len(buckets) > 300          # rows without ids are spread by their texts
    assert mixing.mix(df.limit(0)).count() == 0


def test_near_copies_with_clashing_names(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choices(WORDS, k=60)) for _ in range(3)]
    rows = [(1, base[0], "a", "k", 1), (1, base[0] + " end", "b", "k", 2), (1, base[1], "c", "k", 3), (None, base[2], "d", "k", 4),
            (None, base[2], "e", "k", 5), (2, base[1] + " end", "f", "k", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _key string, own int")
    got = jaccard.without_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r.text.split()[0], r.doc_id) for r in got.collect()) == sorted((b.split()[0], i) for b, i in zip(base, (1, 1, None)))


def test_stages_on_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    rng = random.Random(9)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(rng.choices(WORDS, k=20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(k, " ".join(rng.choices(WORDS, k=30)) + (". " if k % 2 else " ##"), "en", "s") for k in range(300)]
    rows += [(None, None, None, None), (None, "", None, None), (5, rows[5][1], "en", "s"), (None, rows[6][1], "en", None)]
    rows += [(400, " ".join(rng.choices(WORDS, k=60_000)), "de", "s")]
    df = spark.createDataFrame([(*r, 0 if r[1] is None else len(r[1]), 0.5) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert out.columns[:6] == df.columns, name
        kept = out.collect()
        assert 0 < len(kept) <= len(rows) and {r.doc_id for r in kept} <= {r[0] for r in rows}, name


# The classifiers' parts ------------------------------------------------------------------------------------------------

def model_of(n_langs, seed=3):
    rng = np.random.default_rng(seed)
    likely = rng.gamma(0.3, size=(1 << langid.BITS, n_langs))
    return {"names": [f"l{k}" for k in range(n_langs)], "likely": (likely / likely.sum(0)).astype(np.float32)}


def test_mixture_and_its_set_by_brute_force():
    rng, model = random.Random(1), model_of(5)
    letters = "abcdefghijklmnop"
    texts = ["".join(rng.choices(letters, k=rng.randint(4, 200))) for _ in range(40)]
    got = langid.proportions(texts, model)
    for text, own in zip(texts, got):
        c = langid.ngrams(text)
        at = np.flatnonzero(c)
        p, c = model["likely"][at].astype(float), c[at].astype(float)

        def em(shares):
            for _ in range(langid.STEPS):
                joint = p * shares
                shares = (joint * (c / joint.sum(1))[:, None]).sum(0) / c.sum()
            return shares, (c * np.log((p * shares).sum(1))).sum()

        whole, _ = em(np.full(5, 0.2))
        order, best = np.argsort(-whole, kind="stable"), None
        for k in range(1, 6):
            shares, fit = em(np.where(np.isin(np.arange(5), order[:k]), 1 / k, 0.0))
            value = fit - langid.PENALTY * (k - 1) * 0.5 * math.log(c.sum() + 1)
            if best is not None and value <= best[0]:
                break
            best = value, shares
        assert np.allclose(own, best[1], atol=2e-3)


def test_texts_of_five_languages_keep_all_of_them():
    model, rng = model_of(6, seed=8), np.random.default_rng(4)
    counts = np.zeros(1 << langid.BITS, np.int64)
    for lang in (0, 1, 2, 4, 5):
        counts += rng.multinomial(4000, model["likely"][:, lang].astype(float) / model["likely"][:, lang].astype(float).sum())
    before, langid.ngrams = langid.ngrams, lambda text: counts
    try:
        own = langid.proportions(["any"], model)[0]
    finally:
        langid.ngrams = before
    assert (own > 0).tolist() == [True, True, True, False, True, True] and np.allclose(own[own > 0], 0.2, atol=0.03)


def test_isotonic_and_ridge_by_brute_force():
    rng = np.random.default_rng(2)
    score, y = rng.normal(size=60), (rng.random(60) < 0.5).astype(float)
    x, v = quality.isotonic(score, y)
    fitted = np.interp(np.sort(score), x, v)
    assert (np.diff(fitted) >= -1e-12).all()
    ordered = y[np.argsort(score, kind="stable")]
    for i in range(60):                # the max-min formula of isotonic regression
        best = max(min(ordered[a:b + 1].mean() for b in range(i, 60)) for a in range(i + 1))
        assert abs(fitted[i] - best) < 1e-9


@pytest.mark.parametrize("parts", [1, 7])
def test_normal_equations_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(5)
    rows = [([float(v) for v in rng.normal(size=quality.STATS)], int(rng.random() < 0.5)) for _ in range(200)]
    df = spark.createDataFrame(rows, "_x array<double>, _y int").repartition(parts)
    got = quality._partials(df, lambda x, y: np.concatenate([x.sum(0), x.T @ y]), 2 * quality.STATS)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert np.allclose(got, np.concatenate([x.sum(0), x.T @ y]))


def test_convolution_and_pooling_by_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS[:30], k=n)) for n in (1, 2, 5, 40)]
    slots = toxicity.Slots()
    ids, first, table = toxicity._tokens(texts, slots)
    model = toxicity._learn([(*toxicity._tokens([t], slots)[::2], k % 2) for k, t in enumerate(texts)])
    _, pooled, _ = toxicity._pooled(ids, first, table, model)
    for text, got in zip(texts, pooled):
        words = [model["embed"][slots[w]].sum(0) for w in text.lower().split()]
        zero, at = np.zeros(toxicity.WIDTH, np.float32), 0
        for w, kernel in zip(toxicity.WIDTHS, model["kernels"]):
            best = np.full(toxicity.FILTERS, -np.inf)
            for i in range(len(words) + 1):
                own = [words[i + j] if i + j < len(words) else zero for j in range(w)]
                best = np.maximum(best, sum(x @ kernel[j] for j, x in enumerate(own)))
            assert np.allclose(got[at:at + toxicity.FILTERS], best, atol=1e-4)
            at += toxicity.FILTERS
    alone = [toxicity._pooled(*toxicity._tokens([t], slots), model)[1][0] for t in texts]
    assert np.allclose(pooled, alone, atol=1e-5)        # whatever stands beside a text


def test_gradient_learns_a_pair_of_words():
    """Neither word tells the label, only both in a row do: what a filter of width two sees."""
    rng, slots, rows = random.Random(5), toxicity.Slots(), []
    for k in range(400):
        words = rng.choices(WORDS[:20], k=12)
        at = rng.randrange(10)
        words[at:at + 2] = ["vile", "thing"] if k % 2 else rng.choice([["vile", "kan"], ["kan", "thing"]])
        rows.append((*toxicity._tokens([" ".join(words)], slots)[::2], k % 2))
    model = toxicity._learn(rows[:300])
    right = 0
    for ids, table, label in rows[300:]:
        _, pooled, _ = toxicity._pooled(ids, np.array([0]), table, model)
        right += (toxicity._logits(pooled, model)[0] > 0) == bool(label)
    assert right >= 95


def test_workers_of_the_pipeline_do_without_pandas():
    """A worker loads the modules of what it runs; pandas among them would stay in its memory for good."""
    names = "corpus_pipeline, waymark.llm.decontaminate, waymark.llm.jaccard, waymark.llm.mixing, waymark.llm.pii, waymark.llm.quality"
    code = f"import {names}, sys; print('pandas' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.stdout.split()[-1:] == ["False"], done.stderr


def test_texts_of_a_batch_are_decoded_in_parts(monkeypatch):
    """The spans are the same however many tokens are decoded together, and no more than a part and a sequence are."""
    words = [f"word{chr(97 + i % 26)}" for i in range(200)]
    model = pii.train(pii.written_table([words], times=4))
    texts = [t for t, _ in pii.written_table([words], times=3, seed=5)]
    whole, sizes, gather = pii.field_spans(texts, model), [], pii._gather
    longest = max(len(s) for t in texts for s in pii.sequences(t))
    monkeypatch.setattr(pii, "_gather", lambda seqs, v: sizes.append(sum(map(len, seqs))) or gather(seqs, v))
    monkeypatch.setattr(pii, "AT_ONCE", 50, raising=False)
    assert pii.field_spans(texts, model) == whole and any(whole)
    assert len(sizes) > 1 and max(sizes) < 50 + longest
