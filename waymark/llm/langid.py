"""Operator 2, language identification by multilingual mixtures.

A document's character n-grams are drawn from a mixture of languages. Expectation-maximisation estimates the
shares of the languages; the set of languages grows along the most probable ones, up to all learned languages, for as long as
the likelihood less a penalty for each language grows. ``lang_pred`` is the language with the largest share in it.

N-gram frequencies are learned from a bounded sample of rows with a language (``BOUND`` a language),
never from the held-out fold, and summed in Spark.

Defined cases: texts that are null or hold no letter are ``und`` with score 0; equal shares go to
the first name; a document is worked on alone, so repeated rows need no rule; with nothing learned all is ``und``;
null languages are not learned from; further columns are ignored.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.textops import held_out, share

BOUND = 3000     # rows of a language to learn from, at most about so many
ORDER = 3        # letters in an n-gram
BITS = 13
STEPS = 10       # of expectation-maximisation
PENALTY = 4.0    # for each further language, times half the logarithm of the number of n-grams
SMOOTH = 0.3

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
SCHEMA = "doc_id long, lang_pred string, score double, langs string"


def ngrams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the lower-cased words, one space between them."""
    plain = " " + _OTHER.sub(" ", text.lower()) + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(max(0, len(codes) - ORDER + 1), np.uint32)
    for i in range(ORDER):
        total = total * np.uint32(0x9E3779B1) + codes[i:len(codes) - ORDER + 1 + i]
    total = (total ^ total >> np.uint32(15)) * np.uint32(0x85EBCA6B)
    return np.bincount(total >> np.uint32(32 - BITS), minlength=1 << BITS)


def train(docs: DataFrame, bound: int = BOUND) -> dict:
    rows = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rates = rows.groupBy(F.col("lang").alias("_lang")).agg((F.lit(float(bound)) / F.count("*")).alias("rate"))
    chosen = rows.join(rates, F.col("lang") == F.col("_lang")).filter(share(F.col("doc_id"), 23) < F.col("rate"))

    def counts(batches):
        total = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = ngrams(text)
                total[lang] = total[lang] + found if lang in total else found
        for lang, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))],
                ["lang", "gram", "n"])

    found = chosen.select("text", "lang").mapInArrow(counts, "lang string, gram int, n long")
    table = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # languages x 2**BITS rows at most
    names = sorted(set(table["lang"]))
    likely = np.full((1 << BITS, len(names)), SMOOTH)
    if len(table):
        likely[table["gram"], table["lang"].map(names.index)] += table["n"]
    return {"names": names, "likely": (likely / likely.sum(0)).astype(np.float32)} if names else {"names": []}


def _mixture(p, c, first, rows, shares):
    """Expectation-maximisation for all documents of a batch; returns shares and log-likelihoods."""
    size = np.add.reduceat(c, first)[:, None]
    for _ in range(STEPS):
        joint = p * shares[rows]
        joint *= (c / np.maximum(joint.sum(1), 1e-30))[:, None]
        shares = np.add.reduceat(joint, first, axis=0) / size
    seen = np.log(np.maximum((p * shares[rows]).sum(1), 1e-30))
    return shares, np.add.reduceat(c * seen, first), size[:, 0]


def proportions(texts: list, model: dict) -> np.ndarray:
    """Shares of the languages of each text, zero outside the selected set. Texts must hold a letter."""
    found = [ngrams(t) for t in texts]
    grams = [np.flatnonzero(f) for f in found]
    first = np.cumsum([0, *map(len, grams)])[:-1]
    rows = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    c = np.concatenate([f[g] for f, g in zip(found, grams)]).astype(np.float32)
    p = model["likely"][np.concatenate(grams)]
    n_langs = len(model["names"])
    whole, whole_fit, size = _mixture(p, c, first, rows, np.full((len(texts), n_langs), 1 / n_langs, np.float32))
    order = np.argsort(-whole, axis=1, kind="stable")
    best, chosen, going = np.full(len(texts), -np.inf), np.zeros_like(whole), np.arange(len(texts))
    for k in range(1, n_langs + 1):
        if k < n_langs:
            within = np.zeros((len(going), n_langs), np.float32)
            np.put_along_axis(within, order[going, :k], 1 / k, axis=1)
            mine = np.isin(rows, going) if len(going) < len(texts) else slice(None)
            lengths = np.diff(np.append(first, len(rows)))[going]
            starts = np.cumsum(np.append(0, lengths[:-1]))
            shares, fit, _ = _mixture(p[mine], c[mine], starts, np.repeat(np.arange(len(going)), lengths), within)
        else:
            shares, fit = whole[going], whole_fit[going]
        value = fit - PENALTY * (k - 1) * 0.5 * np.log(size[going] + 1)
        better = value > best[going]
        best[going[better]], chosen[going[better]] = value[better], shares[better]
        going = going[better]   # the others' likelihood fell: their sets are found
        if not len(going):
            break
    return chosen


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (its share), langs (the selected languages with their shares)."""
    names = model["names"]

    def found(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, score, langs = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
            known = [i for i, t in enumerate(texts) if names and t and _LETTER.search(t)]
            for a in range(0, len(known), 128):
                part = known[a:a + 128]
                for i, own in zip(part, proportions([texts[i] for i in part], model)):
                    k = int(own.argmax())
                    pred[i], score[i] = names[k], round(min(1.0, float(own[k])), 6)
                    langs[i] = ",".join(f"{names[j]}:{own[j]:.4f}" for j in np.argsort(-own, kind="stable") if own[j] > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred), pa.array(score, pa.float64()), pa.array(langs)],
                ["doc_id", "lang_pred", "score", "langs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, SCHEMA)


def classify(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs")
