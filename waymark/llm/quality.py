"""Operator 6, quality classifier: random Fourier features and ridge regression.

Document statistics (lengths, characters, repeats, lines) are standardised; ``FEATURES`` random cosines of them
approximate a Gaussian kernel; each of ``PARTS`` partitions sums its share of the normal equations, and the sums give the ridge
weights. Isotonic regression on a split of the learning rows turns ridge scores into probabilities; a
small part of the uncalibrated score is kept, so that ties of the steps stay ordered.

Learns from a bounded sample of labelled rows (``BOUNDS``); never from the held-out fold.

Defined cases: null and empty texts have statistics of zero and get a score as any text; rows are scored one by one, so
repeats and ties need no rule; without labels of both values every score is 0.5 or the only
label's value; further columns are kept by ``scored`` and not read.
"""

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.textops import held_out, labelled_sample, staged, with_made

BOUNDS = {0: 12_000, 1: 18_000}  # labelled rows to learn from, at most about so many
FEATURES = 256
PARTS = 16
RIDGE = 1e-2
CALIBRATION = 0.25               # share of the learning rows kept for calibration
THRESHOLD = 0.5
STATS = 24

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = np.frombuffer(b"#$%&*+=<>^~\\|_{}[]@/", np.uint8)


def statistics(text: str) -> list:
    """The ``STATS`` statistics of a whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return [0.0] * STATS
    counts = np.bincount(raw, minlength=256).astype(float)
    n, words = float(len(raw)), text.split()
    m, lines = max(1, len(words)), text.split("\n")
    share = counts[counts > 0] / n
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum()
    distinct = Counter(words)
    same = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    ends = sum(not w[-1].isalnum() for w in words)
    filled = [x for x in lines if x.strip()] or [""]
    return [
        math.log1p(n), math.log1p(m), math.log1p(len(lines)), min(n / m, 40.0),
        len(distinct) / m, math.log1p(m) * len(distinct) / m, pairs / max(1, m - 1), same / m,
        max(distinct.values(), default=0) / m, len(set(filled)) / len(filled), math.log1p(n / len(filled)),
        -float((share * np.log2(share)).sum()), counts[_UPPER].sum() / (letters + 1), letters / n,
        counts[_DIGIT].sum() / n, counts[33] / n * 10, counts[63] / n * 10, (counts[46] + counts[44]) / n * 5,
        counts[_MARKS].sum() / n * 5, counts[124] / n * 5, counts[32] / n, counts[128:].sum() / n,
        ends / m, sum(w[0].isupper() for w in words) / m,
    ]


def _matrix(column) -> np.ndarray:
    return np.array([statistics(t) for t in column], float).reshape(-1, STATS)


def with_statistics(rows: DataFrame, text: str = "_text", name: str = "_x") -> DataFrame:
    return with_made(rows, text, name, "array<double>", lambda texts: [statistics(t) for t in texts])


def _partials(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum over the partitions of ``part(x, y)``, a vector of ``size``: one row from each of ``PARTS`` partitions."""
    def sums(batches):
        total = np.zeros(size)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, STATS)
            total += part(x, batch.column(1).to_numpy().astype(float))
        yield pa.RecordBatch.from_pydict({"s": [total.tolist()]}, pa.schema([("s", pa.list_(pa.float64()))]))

    found = rows.repartition(PARTS).select("_x", "_y").mapInArrow(sums, "s array<double>").collect()
    return np.sum([r["s"] for r in found] or [np.zeros(size)], axis=0)


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    """Constant, standardised statistics and random cosines."""
    z = np.clip((x - model["mean"]) / model["spread"], -6, 6)
    return np.hstack([np.ones((len(z), 1)), z, math.sqrt(2 / FEATURES) * np.cos(z @ model["angles"] + model["phases"])])


def isotonic(score: np.ndarray, y: np.ndarray):
    """Pool adjacent violators: knots of the nondecreasing step function nearest to ``y``."""
    order = np.argsort(score, kind="stable")
    blocks = []
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, n1, _, high = blocks.pop()
            v0, n0, low, _ = blocks.pop()
            blocks.append([(v0 * n0 + v1 * n1) / (n0 + n1), n0 + n1, low, high])
    knots = [(s, b[0]) for b in blocks for s in sorted({b[2], b[3]})]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bounds: dict = None, seed: int = 5) -> dict:
    rows = staged(with_statistics(labelled_sample(docs, labels, label, bounds or BOUNDS)).drop("_text"), "statistics")
    sums = _partials(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x ** 2).sum(0)]), 2 + 2 * STATS)
    n = sums[0]
    if not n or not 0 < sums[1] < n:
        return {"constant": 0.5 if not n else sums[1] / n}
    mean = sums[2:2 + STATS] / n
    spread = np.sqrt(np.maximum(sums[2 + STATS:] / n - mean ** 2, 1e-8))
    rng = np.random.default_rng(seed)
    model = {"mean": mean, "spread": spread, "angles": rng.normal(0, 1 / math.sqrt(STATS), (STATS, FEATURES)),
             "phases": rng.uniform(0, 2 * math.pi, FEATURES)}
    wide = 1 + STATS + FEATURES

    def equations(x, y):
        z = fourier(x, model)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    fit, rest = rows.filter(F.col("_u") >= CALIBRATION), rows.filter(F.col("_u") < CALIBRATION)
    sums = _partials(fit, equations, wide * wide + wide)
    gram, right = sums[:wide * wide].reshape(wide, wide), sums[wide * wide:]
    model["weights"] = np.linalg.solve(gram + RIDGE * n / 100 * np.eye(wide), right)
    held = rest.select("_x", "_y").toPandas()  # a bounded sample, as the learning rows are
    if len(held):
        raw = fourier(np.array(held["_x"].tolist(), float).reshape(-1, STATS), model) @ model["weights"]
        model["knots"] = isotonic(raw, held["_y"].to_numpy(float))
    return model


def predict(column, model: dict) -> np.ndarray:
    x = _matrix(column)
    if "constant" in model:
        return np.full(len(x), float(model["constant"]))
    raw = fourier(x, model) @ model["weights"]
    plain = 1 / (1 + np.exp(-4 * (raw - 0.5)))
    steps = np.interp(raw, *model["knots"]) if "knots" in model else plain
    return np.round(0.98 * steps + 0.02 * plain, 9)


def scored(docs: DataFrame, model: dict, name: str = "score", text: str = "text") -> DataFrame:
    """The same rows with a score column."""
    return with_made(docs, text, name, "double", lambda texts: predict(texts, model))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
