"""Operator 1, toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first 3, 4, 5 and 6 letters (so unseen
forms of a stem are near seen ones). Filters of ``WIDTHS`` words slide over the whole text; the maximum of each filter over all
positions feeds a logistic layer. Trained by mini-batch Adagrad on a bounded sample of labelled rows
(``BOUNDS``), never from the held-out fold.

Thresholds are calibrated by language: the language of a text is guessed from its own words (a hashed
unigram model learned from the same sample; the ``lang`` of a row is never an input of its score), and
each language's scores are shifted so that its best threshold becomes ``THRESHOLD``.

Defined cases: null and empty texts have no word and get the score of no filter firing; rows are scored one by one, so
repeats and ties need no rule; without labels of both values the score is constant; a null
language counts as its own; further columns are ignored.
"""

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.textops import WordHash, held_out, labelled_sample

BOUNDS = {0: 6000, 1: 4000}
BITS, WIDTH, WIDTHS, FILTERS = 16, 12, (1, 2, 3), 8
STEMS = (3, 4, 5, 6)
EPOCHS, BATCH, RATE = 4, 64, 0.08
CALIBRATION = 0.2
THRESHOLD = 0.7
LEAST = 15          # labelled rows of either value for a threshold of a language's own
_EDGE = ".,;:!?()[]{}\"'*#%&$"
_SPAN = max(WIDTHS) - 1


class Slots(WordHash):
    """word -> row numbers of its parts in the embedding table; row 0 is the empty word."""

    def __missing__(self, word):
        core = word.strip(_EDGE)
        parts = [core, *[f"{n}:{core[:n]}" for n in STEMS if len(core) > n]]
        slots = [1 + xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) % ((1 << BITS) - 1)
                 for p in parts] if core else []
        if len(self) > 200_000:
            self.clear()
        value = self[word] = (slots + [0] * 5)[:5]
        return value


def _tokens(texts, slots: Slots):
    """Words of all texts as numbers of distinct words, with ``_SPAN`` empty words after each text:
    (numbers, first position of each text, slots of the distinct words)."""
    number, table, ids, first = {"": 0}, [[0] * 5], [], []
    at = 0
    for text in texts:
        words = (text or "").lower().split()
        for w in set(words):
            if w not in number:
                number[w] = len(table)
                table.append(slots[w])
        first.append(at)
        part = np.zeros(len(words) + _SPAN + 1, np.int32)
        part[:len(words)] = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        ids.append(part)
        at += len(part)
    return np.concatenate(ids), np.array(first), np.array(table, np.int64)


def _pooled(ids, first, table, model):
    """Maximum of each filter over each text, and where it stands (for training)."""
    words = model["embed"][table].sum(1)
    outs, wheres = [], []
    # The last positions of a text are left out: their windows would reach into the next text.
    bounds = np.empty(2 * len(first), np.int64)
    bounds[::2], bounds[1::2] = first, np.append(first[1:], len(ids)) - _SPAN
    for w, kernel in zip(WIDTHS, model["kernels"]):
        # A filter's share of each distinct word is computed once; positions add up shares.
        total = (words @ kernel[0])[ids]
        for j in range(1, w):
            total[:-j] += (words @ kernel[j])[ids[j:]]
        outs.append(np.maximum.reduceat(total, bounds, axis=0)[::2])
        wheres.append(total)
    return words, np.hstack(outs), wheres


def _logits(pooled, model):
    return np.maximum(pooled + model["bias"], 0) @ model["out"] + model["shift"]


def _learn(rows: list, seed: int = 3) -> dict:
    """``rows``: (ids, slots of the distinct words, label) of single texts."""
    rng = np.random.default_rng(seed)
    size = FILTERS * len(WIDTHS)
    model = {"embed": rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32),
             "kernels": [rng.normal(0, 0.3, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS],
             "bias": np.zeros(size, np.float32), "out": rng.normal(0, 0.3, size).astype(np.float32), "shift": np.float32(0)}
    model["embed"][0] = 0
    grown = {k: np.full_like(model[k], 1e-3) for k in ("embed", "bias", "out")}
    grown_k = [np.full_like(k, 1e-3) for k in model["kernels"]]
    labels = np.array([r[2] for r in rows], np.float32)
    weigh = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(rows)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            part = order[a:a + BATCH]
            offsets = np.cumsum([0, *[len(rows[i][1]) for i in part]])
            ids = np.concatenate([rows[i][0] + o for i, o in zip(part, offsets)])
            first = np.cumsum([0, *[len(rows[i][0]) for i in part]])
            table = np.concatenate([rows[i][1] for i in part])
            words, pooled, totals = _pooled(ids, first[:-1], table, model)
            active = pooled + model["bias"] > 0
            p = 1 / (1 + np.exp(-np.clip(_logits(pooled, model), -30, 30)))
            g = ((p - labels[part]) * weigh[part] / len(part)).astype(np.float32)
            hidden = np.maximum(pooled + model["bias"], 0)
            g_out, g_pool = hidden.T @ g, np.where(active, g[:, None] * model["out"], 0).astype(np.float32)
            g_words = np.zeros_like(words)
            for k, (w, kernel, total) in enumerate(zip(WIDTHS, model["kernels"], totals)):
                gk = np.zeros_like(kernel)
                gp = g_pool[:, k * FILTERS:(k + 1) * FILTERS]
                top = np.stack([total[x:y - _SPAN].argmax(0) + x for x, y in zip(first[:-1], first[1:])])
                for j in range(w):
                    at = ids[np.minimum(top + j, len(ids) - 1)]
                    gk[j] = np.einsum("tfd,tf->df", words[at], gp)
                    np.add.at(g_words, at.ravel(), (gp[:, :, None] * kernel[j].T[None]).reshape(-1, WIDTH))
                grown_k[k] += gk ** 2
                kernel -= RATE * gk / np.sqrt(grown_k[k])
            touched = np.flatnonzero(np.abs(g_words).sum(1))
            slots = table[touched]
            g_embed = np.zeros_like(model["embed"])
            for c in range(slots.shape[1]):
                np.add.at(g_embed, slots[:, c], g_words[touched])
            rows_hit = np.setdiff1d(slots, [0])
            grown["embed"][rows_hit] += g_embed[rows_hit] ** 2
            model["embed"][rows_hit] -= RATE * g_embed[rows_hit] / np.sqrt(grown["embed"][rows_hit])
            for name, step in (("bias", g_pool.sum(0)), ("out", g_out)):
                grown[name] += step ** 2
                model[name] -= RATE * step / np.sqrt(grown[name])
            model["shift"] -= np.float32(RATE * g.sum())
    return model


def _languages(rows: list, langs: list) -> tuple:
    """Names and hashed word log-likelihoods of the languages in the sample."""
    names = sorted(set(langs))
    counts = np.full((1 << 12, len(names)), 0.5)
    for (ids, table, _), lang in zip(rows, langs):
        np.add.at(counts[:, names.index(lang)], table[ids, 0] & 4095, 1)
    counts[0] = 1
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def _guess(ids, first, table, model):
    likely = model["words"][table[:, 0] & 4095]
    likely[table[:, 0] == 0] = 0
    return np.add.reduceat(likely[ids], first, axis=0).argmax(1)


def _best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap above which the F1 value is best."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def train(docs: DataFrame, labels: DataFrame, bounds: dict = None) -> dict:
    """Learn from about ``bounds`` whole texts. Their rows reach the driver one partition at a time, as word numbers."""
    sample = labelled_sample(docs, labels, "toxic", bounds or BOUNDS, keep=("text", "lang"))
    slots, rows, langs, later = Slots(), [], [], []
    for r in sample.orderBy(F.xxhash64("_text", "_u")).toLocalIterator():
        ids, _, table = _tokens([r["_text"]], slots)
        rows.append((ids, table, r["_y"]))
        langs.append(r["_lang"] or "")
        later.append(r["_u"] < CALIBRATION)
    values = {r[2] for r in rows}
    if len(values) < 2:
        return {"constant": float(values.pop()) if values else 0.0}
    later = np.array(later)
    model = _learn([r for r, l in zip(rows, later) if not l])
    model["names"], model["words"] = _languages(rows, langs)
    model["cuts"] = np.zeros(len(model["names"]))
    held = [r for r, l in zip(rows, later) if l]
    if not 0 < sum(r[2] for r in held) < len(held):
        return model
    z, guess = [], []
    for ids, table, _ in held:
        z.append(_logits(_pooled(ids, np.array([0]), table, model)[1], model)[0])
        guess.append(_guess(ids, np.array([0]), table, model)[0])
    z, guess, y = np.array(z), np.array(guess), np.array([r[2] for r in held])
    model["cuts"][:] = _best_threshold(z, y)
    for k in range(len(model["names"])):
        own = guess == k
        if min(y[own].sum(), (1 - y[own]).sum()) >= LEAST:
            model["cuts"][k] = _best_threshold(z[own], y[own])
    return model


def predict(texts: list, model: dict) -> np.ndarray:
    if "constant" in model or not texts:
        return np.full(len(texts), model.get("constant", 0.0))
    slots, out = model.setdefault("slots", Slots()), []
    for a in range(0, len(texts), 128):
        ids, first, table = _tokens(texts[a:a + 128], slots)
        z = _logits(_pooled(ids, first, table, model)[1], model)
        z = z - model["cuts"][_guess(ids, first, table, model)] + math.log(THRESHOLD / (1 - THRESHOLD))
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.round(np.concatenate(out), 9)


def scored(docs: DataFrame, model: dict, name: str = "score", text: str = "text") -> DataFrame:
    """The same rows with a score column."""
    return docs.withColumn(name, F.pandas_udf(lambda c: pd.Series(predict(c.tolist(), model)), "double")(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
