"""Operator 9, personal data: base patterns, and a linear-chain conditional random field that adds spans.

The field finds what the patterns cannot see: addresses written out (``name at host dot org``), octets set apart, IPv6, cards in
groups with odd separators, phone numbers without ``+``, and secrets (keys, tokens, passwords), its own fifth kind. It labels tokens
(runs of non-space characters) with BIO states from the shapes of a token and its neighbours. Its sequences are the
neighbourhoods of tokens that hold a digit, ``@`` or ``+`` or spell such a sign out: these tokens with ``CONTEXT`` tokens on either
side, joined where they meet. All other tokens are outside by definition of the model, so texts without them are settled by one
search. Weights come from a small labelled table by gradient ascent on the conditional likelihood (forward-backward); decoding is
Viterbi over numpy batches of sequences. Spans of the field that touch a base span give way to it.

The labelled table may be given. The default one (``labelled_table``) is made by rule: ``FORMS`` writes personal data in each form,
``PLAIN`` numbers that are none, into words of the documents, from a sample of ``SAMPLE`` texts, the least by a hash of the text, so
neither null nor repeated ids change its size. ``measure`` gives precision and recall on a table that was not learned from.

Defined cases: null and empty texts have no spans; spans of one start are ordered by kind; a text is worked on
alone, so repeats and ties need no rule; with nothing to learn from, the field adds nothing;
further columns are kept by ``mask`` and ignored by ``find``.
"""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.textops import tidy, with_made

KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "secret")
COUNTS = tuple(f"n_{k}" for k in KINDS)
SAMPLE = 300       # texts that lend their words to the labelled table
PIECE = 24         # words of each
TIMES = 36         # examples of each form in the labelled table
CONTEXT = 3        # tokens on either side of a token that may be personal
KNOWN = 20_000     # tokens a worker remembers
AT_ONCE = 4_096    # tokens decoded together, at least one sequence
EPOCHS, RATE, L2 = 40, 0.5, 1e-4
STATES = ("O", *(f"{p}-{k}" for k in NAMES for p in "BI"))
N = len(STATES)

# The base patterns of the contract.
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

_HINT = re.compile(r"[0-9@+]|[(\[{](?:at|AT)[)\]}]|\b(?:dot|DOT)\b")
_TOKEN = re.compile(r"\S+")

_EDGE = ".,;:!?()[]{}<>\"'|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list:
    """(start, kind number, end) of the base matches, leftmost and non-overlapping within a kind."""
    found = []
    if not text or not _HINT.search(text):
        return found
    # An email match holds one '@' after its longest name, so the '@'s are the places to look.
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_NAME:
            start -= 1
        host = EMAIL_HOST.match(text, at) if start < at else None
        if host:
            found.append((start, 0, host.end()))
            free = host.end()
        at = text.find("@", max(at + 1, free))
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                  if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found)


def shape(token: str) -> tuple:
    """Shape features: long shape, runs, length, characters, case, changes between letters and digits, check digits and spelt
    signs of the token without edge punctuation."""
    core = token.strip(_EDGE) or token
    kinds = "".join("9" if c in "0123456789" else "x" if c.isalpha() else c for c in core[:48])
    runs = re.sub(r"(.)\1+", r"\1", kinds)
    digits = sum(c in "0123456789" for c in core)
    letters = [c for c in core if c.isalpha()]
    turns = sum(a + b in ("9x", "x9") for a, b in zip(runs, runs[1:]))
    number = re.sub(r"[^0-9]", "", core)
    checks = (luhn(number) if 12 <= len(number) <= 19 and not letters else None,
              all(map(_small, core.split("."))) if IP.fullmatch(core) else None)
    case = f"{any(c.isupper() for c in letters)}{any(c.islower() for c in letters)}"
    word = core.lower() if core.lower() in ("at", "dot") else None
    longest = max((len(p) for p in re.split(r"[^0-9A-Za-z]", core)), default=0)
    hexed = longest > 3 and all(c in "0123456789abcdefABCDEF" for c in core.split("=")[-1])
    return (f"s={kinds[:24]}", f"r={runs[:16]}", f"d={min(digits, 20)}", f"n={min(len(core), 40) // 2}", f"t={min(turns, 6)}{case}",
            f"a={'@' in core}{'.' in core}{core[:1] == '+'}{'-' in core}{'=' in core}{core.count(':') > 1}{'_' in core}{'/' in core}",
            f"l={min(longest, 40) // 4}{digits > 0}{bool(letters)}{case}", f"h={hexed}{longest // 8}{turns > 1}{'=' in core}",
            f"p={token[:1] in '([{'}{token[-1:] if token[-1:] in _EDGE else ''}", f"v={checks}", f"w={word}")


def sequences(text: str) -> list:
    """Token lists [(start, end, token)] around the tokens that may be personal."""
    if not text or not _HINT.search(text):
        return []
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    out, last = [], -1
    for i, (_, _, token) in enumerate(tokens):
        if _HINT.search(token):     # as in the whole text: no hint spans two tokens
            a, z = max(0, i - CONTEXT), min(len(tokens), i + CONTEXT + 1)
            if a <= last:
                out[-1] += tokens[last:z]
            else:
                out.append(tokens[a:z])
            last = z
    return out


class Vocabulary(dict):
    """token -> ids of its known shape features; the features grow only while learning."""

    def __init__(self, features=None):
        super().__init__()
        self.features, self.grows = features if features is not None else {}, features is None

    def __missing__(self, token):
        names = shape(token)
        if self.grows:
            ids = [self.features.setdefault(n, len(self.features)) for n in names]
        else:
            ids = [self.features[n] for n in names if n in self.features]
        if len(self) >= KNOWN:
            self.clear()
        self[token] = ids
        return ids


def _gather(seqs: list, vocabulary: Vocabulary):
    """Rows of (position, slot, feature): slot 0 is the token, 1 the one before, 2 the one after."""
    rows, cols, at = [], [], 0
    for seq in seqs:
        ids = [vocabulary[t] for _, _, t in seq]
        for i in range(len(seq)):
            for slot, j in ((0, i), (1, i - 1), (2, i + 1)):
                if 0 <= j < len(ids):
                    rows += [at + i] * len(ids[j])
                    cols += [3 * f + slot for f in ids[j]]
        at += len(seq)
    return np.array(rows, np.int64), np.array(cols, np.int64), at


def _emissions(rows, cols, total, weights):
    scores = np.zeros((total, N))
    for k in range(N):
        scores[:, k] = np.bincount(rows, weights[cols, k], total)
    return scores


def _batches(lengths: np.ndarray):
    """Sequences of like length together: (members, first positions, length of the longest)."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(lengths, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 512)):
        if len(part):
            yield part, first[part], int(lengths[part].max())


def _padded(scores, first, lengths, longest):
    at = first[:, None] + np.minimum(np.arange(longest)[None, :], lengths[:, None] - 1)
    return scores[at], np.arange(longest)[None, :] < lengths[:, None]


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def viterbi(scores, lengths, trans) -> np.ndarray:
    """The best state of each position."""
    states = np.zeros(len(scores), np.int64)
    for part, first, longest in _batches(lengths):
        e, live = _padded(scores, first, lengths[part], longest)
        value, back = e[:, 0] + trans[N], np.zeros((len(part), longest, N), np.int64)
        for t in range(1, longest):
            step = value[:, :, None] + trans[None, :N]
            back[:, t] = step.argmax(1)
            value = np.where(live[:, t, None], step.max(1) + e[:, t], value)
        state = value.argmax(1)
        for t in range(longest - 1, -1, -1):
            on = live[:, t]
            states[first[on] + t] = state[on]
            state = np.where(on, back[np.arange(len(part)), t, state], state)
    return states


def _expectations(scores, lengths, trans):
    """State marginals and expected transitions (row N: the first state)."""
    marginal, moves = np.zeros_like(scores), np.zeros_like(trans)
    for part, first, longest in _batches(lengths):
        e, live = _padded(scores, first, lengths[part], longest)
        size = len(part)
        alpha, beta = np.zeros((size, longest, N)), np.zeros((size, longest, N))
        alpha[:, 0] = e[:, 0] + trans[N]
        for t in range(1, longest):
            new = _logsum(alpha[:, t - 1, :, None] + trans[None, :N], 1) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
        whole = _logsum(alpha[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            new = _logsum(trans[None, :N] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], new, 0)
        p = np.exp(alpha + beta - whole[:, None, None])
        for t in range(longest):
            marginal[first[live[:, t]] + t] = p[live[:, t], t]
            if t:
                pair = np.exp(alpha[:, t - 1, :, None] + trans[None, :N]
                              + (e[:, t] + beta[:, t])[:, None, :] - whole[:, None, None])
                moves[:N] += pair[live[:, t]].sum(0)
        moves[N] += p[:, 0].sum(0)
    return marginal, moves


def labels_of(seq: list, spans: list) -> list:
    """BIO states of a sequence's tokens, given (start, kind number, end) spans."""
    out = []
    for start, end, _ in seq:
        hit = next((s for s in spans if s[0] < end and s[2] > start), None)
        out.append(0 if hit is None else 1 + 2 * hit[1] + (hit[0] < start))
    return out


def train(table: list) -> dict:
    """``table``: (text, [(start, kind number, end)]) rows. Returns the model, or None without a sequence."""
    seqs, gold = [], []
    for text, spans in table:
        for seq in sequences(text):
            seqs.append(seq)
            gold += labels_of(seq, spans)
    if not seqs or not any(gold):
        return None
    vocabulary = Vocabulary()
    rows, cols, total = _gather(seqs, vocabulary)
    lengths, gold = np.array([len(s) for s in seqs]), np.array(gold)
    weights, trans = np.zeros((3 * len(vocabulary.features), N)), np.zeros((N + 1, N))
    want = np.zeros((total, N))
    want[np.arange(total), gold] = 1
    seen = np.zeros_like(trans)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inner = np.ones(total, bool)
    inner[begins] = False
    np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    np.add.at(seen, (N, gold[begins]), 1)
    grown_w, grown_t = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(EPOCHS):
        marginal, moves = _expectations(_emissions(rows, cols, total, weights), lengths, trans)
        rest = want - marginal
        step = np.stack([np.bincount(cols, rest[rows, k], len(weights)) for k in range(N)], 1) - L2 * total * weights
        move = seen - moves - L2 * total * trans
        grown_w += step ** 2
        grown_t += move ** 2
        weights += RATE * step / np.sqrt(grown_w)
        trans += RATE * move / np.sqrt(grown_t)
    return {"features": vocabulary.features, "weights": weights, "trans": trans}


def _digits(rng, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng) -> str:
    """A card number with a right check digit."""
    body = rng.choice("3456") + _digits(rng, rng.choice([14, 14, 14, 13, 15]) )
    return next(body + d for d in "0123456789" if luhn(body + d))


def _no_card(rng) -> str:
    """As long as a card number, with a wrong check digit."""
    body = _digits(rng, rng.randint(12, 18))
    return next(body + d for d in "5061728394" if not luhn(body + d))


def _grouped_card(rng, separator: str, number: str = None) -> str:
    number = number or _card(rng)
    return separator.join(number[i:i + 4] for i in range(0, len(number), 4))


def _name(rng, words) -> str:
    return "".join(c for c in rng.choice(words).lower() if c.isalnum()) or "mail"


def _letters(rng, n: int, alphabet: str) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX = "0123456789abcdef"
_ENDS = ("org", "com", "net", "de", "fr", "example", "io")
_KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth", "key")


def _octets(rng, separator: str) -> str:
    return separator.join(str(rng.randrange(256)) for _ in range(4))


def _six(rng) -> str:
    parts = [format(rng.randrange(1 << 16), "x") for _ in range(rng.randint(5, 8))]
    if len(parts) < 8:
        parts[rng.randrange(1, len(parts) - 1)] = ""
    return ":".join(parts)


# Forms of personal data that the base patterns do not see, and some that they do: kind and how one is written.
FORMS = (
    ("email", lambda r, w: f"{_name(r, w)} at {_name(r, w)} dot {r.choice(_ENDS)}"),
    ("email", lambda r, w: f"{_name(r, w)} (at) {_name(r, w)} (dot) {r.choice(_ENDS)}"),
    ("email", lambda r, w: f"{_name(r, w)}.{_name(r, w)} [at] {_name(r, w)} [dot] {r.choice(_ENDS)}"),
    ("email", lambda r, w: f"{_name(r, w)}{r.randrange(99)} @ {_name(r, w)}.{r.choice(_ENDS)}"),
    ("email", lambda r, w: f"{_name(r, w)}.{r.randrange(99)}@{_name(r, w)}{r.randrange(9)}.{_name(r, w)}.{r.choice(_ENDS)}"),
    ("ip", lambda r, w: _six(r)),
    ("ip", lambda r, w: _octets(r, " . ")),
    ("ip", lambda r, w: _octets(r, "[.]")),
    ("ip", lambda r, w: _octets(r, ".")),
    ("card", lambda r, w: _grouped_card(r, ".")),
    ("card", lambda r, w: _grouped_card(r, "/")),
    ("card", lambda r, w: _grouped_card(r, "_")),
    ("card", lambda r, w: _grouped_card(r, "  ")),
    ("card", lambda r, w: _card(r)),
    ("phone", lambda r, w: f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}"),
    ("phone", lambda r, w: f"0{_digits(r, 2)}-{_digits(r, 4)}-{_digits(r, 4)}"),
    ("phone", lambda r, w: f"{r.randint(2, 9)}{_digits(r, 2)}.{_digits(r, 3)}.{_digits(r, 4)}"),
    ("phone", lambda r, w: f"00{r.randint(30, 49)} {_digits(r, 2)} {_digits(r, 7)}"),
    ("phone", lambda r, w: f"+{r.randint(1, 49)} ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}"),
    ("secret", lambda r, w: "AKIA" + _letters(r, 16, _UPPER)),
    ("secret", lambda r, w: f"{r.choice(_KEYS)}={_letters(r, r.randint(12, 40), _HEX)}"),
    ("secret", lambda r, w: f"{r.choice(_KEYS)}={_letters(r, r.randint(10, 30), _MIXED)}"),
    ("secret", lambda r, w: r.choice(("ghp_", "xoxb-", "sk_live_", "AIza")) + _letters(r, r.randint(24, 36), _MIXED)),
    ("secret", lambda r, w: _letters(r, r.choice([32, 40, 64]), _HEX)),
)

# Numbers and words that are no personal data.
PLAIN = (
    lambda r: str(r.randint(1000, 2100)), lambda r: str(r.randrange(100)), lambda r: f"{r.randrange(20)}.{r.randrange(10)}",
    lambda r: f"{r.randrange(5)}.{r.randrange(20)}.{r.randrange(30)}", lambda r: f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(9)}",
    lambda r: f"{r.randrange(24)}:{r.randrange(60):02d}", lambda r: f"20{r.randrange(30):02d}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
    lambda r: f"{r.randint(1, 28)}/{r.randint(1, 12)}/19{r.randrange(100):02d}", lambda r: f"{r.randrange(1000)},{r.randrange(1000):03d}",
    lambda r: f"{r.randrange(100)}%", lambda r: f"${r.randrange(1000)}.{r.randrange(100):02d}", lambda r: f"{r.randrange(99)}-{r.randrange(99)}",
    lambda r: f"x{r.randrange(100)}", lambda r: f"B{r.randrange(20)}", lambda r: f"{r.randrange(100)}km", lambda r: f"#{r.randrange(10000)}",
    lambda r: _digits(r, r.randint(5, 8)), lambda r: f"({r.randrange(30)})", lambda r: f"No. {r.randrange(100)}", lambda r: f"at {r.randrange(13)} o'clock",
    lambda r: f"Version {r.randrange(9)}.0.", lambda r: f"{r.randrange(10)} + {r.randrange(10)} = {r.randrange(20)}", lambda r: "the dot above",
    lambda r: _no_card(r), lambda r: _no_card(r), lambda r: _grouped_card(r, r.choice("./_- "), _no_card(r)),
    lambda r: f"at and {r.randrange(20)}", lambda r: f"{r.randrange(20)} at an", lambda r: "a dot", lambda r: f"{r.randrange(50)} . {r.randrange(50)}",
    lambda r: f"{r.randrange(300, 999)}.{r.randrange(999)}.{r.randrange(999)}.{r.randrange(999)}", lambda r: "@home", lambda r: f"[{r.randrange(99)}]", lambda r: f"{r.randrange(9)}th", lambda r: f"{r.randrange(99)}x{r.randrange(99)}",
)


def written_table(pieces: list, times: int = TIMES, seed: int = 23) -> list:
    """(text, [(start, kind number, end)]): each form ``times`` times, and as many plain numbers, among words of the pieces."""
    words = [w for p in pieces for w in p if not _HINT.search(w)]
    if not words:
        return []
    rng, table = random.Random(seed), []
    for form in (*FORMS, *((None, p) for p in PLAIN)):
        for _ in range(times):
            begin = rng.randrange(len(words))
            around = words[begin:begin + 2 * CONTEXT + 2]
            cut = rng.randrange(len(around) + 1)
            left, right = " ".join(around[:cut]), " ".join(around[cut:])
            body = form[1](rng) if form[0] is None else form[1](rng, words)
            quote = rng.choice(["", "", "", '"', "'", ","]) if form[0] else ""
            text = f"{left} {quote if quote != ',' else ''}" if left else quote if quote != "," else ""
            start = len(text)
            text += body + quote + (f" {right}" if right else "")
            inner = body.strip(_EDGE)
            start += body.index(inner)
            table.append((text, [(start, NAMES.index(form[0]), start + len(inner))] if form[0] else []))
    return table


def pieces(docs: DataFrame, bound: int = SAMPLE) -> list:
    """Words of at most ``bound`` different texts, those of the least hash: one pass, ``bound`` pieces from a partition at most."""
    def least(batches):
        held = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key not in held and (len(held) < bound or key < top):
                    words = text.as_py()[:4096].split()
                    at = key % max(1, len(words) - PIECE)
                    held[key] = words[at:at + PIECE]
                    if len(held) > bound:
                        del held[max(held)]
                    top = max(held)
        rows = sorted(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.list_(pa.string()))],
                                         ["key", "words"])
        tidy()

    texts = docs.select(F.xxhash64("text").alias("key"), F.col("text")).filter("text IS NOT NULL AND text <> ''")
    found = texts.mapInArrow(least, "key long, words array<string>").dropDuplicates(["key"]).orderBy("key").limit(bound)
    return [r["words"] for r in found.collect()]


def labelled_table(docs: DataFrame, bound: int = SAMPLE) -> list:
    """The default labelled table, made by rule with words of the documents."""
    return written_table(pieces(docs, bound))


def measure(model, table: list) -> dict:
    """kind -> (precision, recall) of the field alone on a labelled table, spans exact."""
    found = field_spans([t for t, _ in table], model)
    out = {}
    for k, name in enumerate(NAMES):
        told = {(i, *s) for i, spans in enumerate(found) for s in spans if s[1] == k}
        true = {(i, *s) for i, (_, spans) in enumerate(table) for s in spans if s[1] == k}
        right = len(told & true)
        out[name] = right / len(told) if told else 1.0, right / len(true) if true else 1.0
    return out


def field_spans(texts, model) -> list:
    """Spans of the field for each text, edge punctuation left out."""
    out = [[] for _ in texts]
    if model is None:
        return out
    seqs = [(i, seq) for i, text in enumerate(texts) for seq in sequences(text)]
    if not seqs:
        return out
    vocabulary = model.setdefault("cache", Vocabulary(model["features"]))
    for part in _parts(seqs):
        rows, cols, total = _gather([s for _, s in part], vocabulary)
        lengths = np.array([len(s) for _, s in part])
        _told(part, viterbi(_emissions(rows, cols, total, model["weights"]), lengths, model["trans"]), out)
    return out


def _parts(seqs: list):
    """The (text, sequence) pairs in runs of ``AT_ONCE`` tokens: what decoding holds does not grow with a batch."""
    part, size = [], 0
    for pair in seqs:
        part.append(pair)
        size += len(pair[1])
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _told(seqs: list, states, out: list) -> None:
    """Adds the spans that the states of the sequences say to those of their texts."""
    at = 0
    for i, seq in seqs:
        open_kind = None
        for (start, end, token), state in zip(seq, states[at:at + len(seq)].tolist()):
            kind = (state - 1) // 2 if state else None
            core = token.strip(_EDGE)
            if kind is None:
                open_kind = None
                continue
            if not core:
                continue                # a sign between the parts of a span, or nothing
            start += token.index(core)
            end = start + len(core)
            if open_kind == kind and state == 2 + 2 * kind:
                out[i][-1] = (out[i][-1][0], kind, end)
            else:
                out[i].append((start, kind, end))
            open_kind = kind
        at += len(seq)


def _spans(texts, model):
    """(base, all) spans of each text."""
    for text, added in zip(texts, field_spans(texts, model)):
        base = base_spans(text)
        extra = [s for s in added if not any(s[0] < b[2] and s[2] > b[0] for b in base)]
        yield base, sorted(base + extra)


def _written(spans) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{z}" for a, k, z in spans)


def find(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of base spans, digest of the base spans, all spans and their number."""
    kinds = [(n, pa.int64()) for n in COUNTS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())]

    def spans(batches):
        for batch in batches:
            columns = [[] for _ in kinds]
            for base, whole in _spans([t or "" for t in batch.column(1).to_pylist()], model):
                counts = list(map([s[1] for s in base].count, range(len(KINDS))))
                for column, value in zip(columns, (*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(whole), len(whole))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, (_, k) in zip(columns, kinds)]],
                                             [batch.schema.names[0], *[n for n, _ in kinds]])
            tidy()

    rows = docs.select(F.col(key), F.col(text))
    schema = T.StructType([rows.schema[0], *[T.StructField(n, T.StringType() if k == pa.string() else T.LongType()) for n, k in kinds]])
    return rows.mapInArrow(spans, schema)


def masked(text: str, spans) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{NAMES[kind].upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the text."""
    def replaced(texts):
        known = [t or "" for t in texts]
        return [None if t is None else masked(t, whole) for t, (_, whole) in zip(texts, _spans(known, model))]

    return with_made(docs, text, text, "string", replaced)
