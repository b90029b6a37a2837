"""Document quality from lines: a conditional random field over the lines of a text.

Each line has features of its own (length, kinds of characters, repetition) and those of its
neighbours, in bins so that weights need not be monotone. Forward-backward marginals say how
likely a line is good; their mean, weighted by the lines' lengths, scores the document, and one
fitted logistic map turns it into a probability of label 1.

Features of all lines of a batch come from array operations over its bytes. The model is fitted
on a bounded sample of labelled documents (``max_docs``, chosen by a hash of doc_id); scoring is
one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.arrow import arrow_map, as_bytes
from casemill.llm.crf import LinearChainCRF

#: Labelled documents that are used for fitting, at most.
MAX_DOCS = 4000
#: Bytes of their texts, at most: documents are taken in the order of their hashes while they fit.
MAX_BYTES = 64 << 20
#: Bytes of text whose lines are worked on at a time.
BLOCK_BYTES = 2_000_000

_CLASS = np.zeros(256, np.uint16)
_LETTER, _UPPER, _DIGIT, _SYMBOL, _PUNCT, _SPACE, _WIDE, _BAR, _SHOUT = (1 << k for k in range(9))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        _LETTER * (_b < 128 and _c.isalpha()) | _UPPER * (65 <= _b <= 90) | _DIGIT * (48 <= _b <= 57) | _SYMBOL * (_c in "#*$%&<>{}[]^~@\\=_")
        | _PUNCT * (_c in ".,;:?'\"()-") | _SPACE * (_b in (32, 9, 10, 11, 12, 13)) | _WIDE * (_b >= 192) | _BAR * (_c == "|") | _SHOUT * (_c == "!")
    )

#: Upper edges of the bins of each measure; a measure of n edges has n + 1 bins.
EDGES = {
    "bytes": [1, 8, 20, 40, 80, 160, 320, 640, 1280],
    "words": [1, 3, 6, 12, 25, 50, 100, 200],
    "word_bytes": [2, 3, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 10],
    "upper": [0.005, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6],
    "digit": [0.001, 0.01, 0.03, 0.1, 0.3],
    "symbol": [0.001, 0.01, 0.03, 0.06, 0.12, 0.25],
    "punct": [0.005, 0.015, 0.03, 0.05, 0.08, 0.15],
    "wide": [0.001, 0.02, 0.05, 0.1, 0.2],
    "bar": [0.001, 0.02, 0.05, 0.1],
    "shout": [0.001, 0.02, 0.1],
    "same_words": [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7],
    "same_grams": [0.001, 0.05, 0.15, 0.3, 0.5, 0.8],
    "again": [0.5],
    "doc_words": [5, 20, 50, 100, 300, 1000],
    "doc_same_grams": [0.001, 0.05, 0.15, 0.3, 0.5, 0.8],
}
_OWN = sum(len(e) + 1 for e in EDGES.values())
_NEAR = [k for k in EDGES if not k.startswith("doc_")]
#: All features: the bins of a line, those of either neighbour, and that there is no such neighbour.
N_FEATURES = _OWN + 2 * (1 + sum(len(EDGES[k]) + 1 for k in _NEAR))


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Active features of all lines, lines of each text, and the lines' weights (bytes).

    A text without a byte has no line; an empty line is one, with weight 0.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not texts:
        return np.zeros((0, len(EDGES) + 2 * len(_NEAR)), np.int16), sizes, np.zeros(0)
    body = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(body, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.r_[0, ends[:-1] + 1]
    doc_end = np.cumsum(sizes + 1) - 1
    doc = np.searchsorted(doc_end, ends)  # of each line
    full = sizes[doc] > 0
    kind = _CLASS[raw]
    n = {}
    for name, bit in (("letter", _LETTER), ("upper", _UPPER), ("digit", _DIGIT), ("symbol", _SYMBOL), ("punct", _PUNCT), ("space", _SPACE), ("wide", _WIDE), ("bar", _BAR), ("shout", _SHOUT)):
        sums = np.r_[0, np.cumsum((kind & bit) != 0, dtype=np.int32)]
        n[name] = (sums[ends] - sums[starts]).astype(float)
    size = (ends - starts).astype(float)
    # words: hashes by a polynomial over their bytes, then repetition inside each text
    solid = (kind & _SPACE) == 0
    edge = np.diff(solid.astype(np.int8), prepend=0)
    w_start, w_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w_line = np.searchsorted(ends, w_start)
    words = np.bincount(w_line, minlength=len(ends)).astype(float)
    same_w, same_g = np.zeros(len(ends)), np.zeros(len(ends))
    w_doc = doc[w_line]
    if len(w_start):
        place = np.arange(len(raw), dtype=np.int64)
        place -= np.repeat(np.r_[0, w_start], np.diff(np.r_[0, w_start, len(raw)]))
        mixed = (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(place, 255)]
        mixed[~solid] = 0
        h = np.add.reduceat(mixed, w_start)
        h ^= w_doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        same_w = np.bincount(w_line, _repeats(h), len(ends))
        if len(h) > 2:
            g = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xBF58476D1CE4E5B9)
            one = w_doc[:-2] == w_doc[2:]
            twice = np.zeros(len(h))
            twice[:-2][one] = _repeats(g[one])
            same_g = np.bincount(w_line, twice, len(ends))
    # lines that the text has had before
    line_hash = np.zeros(len(ends), np.uint64)
    if len(w_start):
        order = np.arange(len(h), dtype=np.uint64) - np.repeat(np.searchsorted(w_line, np.arange(len(ends))), words.astype(np.int64)).astype(np.uint64)
        lined = h * (order * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        sums = np.r_[np.uint64(0), np.cumsum(lined)]
        first = np.searchsorted(w_line, np.arange(len(ends)))
        line_hash = sums[first + words.astype(np.int64)] - sums[first]
    again = np.where(words > 0, _repeats(line_hash ^ doc.astype(np.uint64) << np.uint64(40)), 0)
    doc_words = np.bincount(doc, words, len(texts))
    doc_grams = np.bincount(doc, same_g, len(texts)) / np.maximum(doc_words, 1)
    per, each = np.maximum(size, 1), np.maximum(words, 1)
    measured = {
        "bytes": size, "words": words, "word_bytes": (size - n["space"]) / each, "upper": n["upper"] / per, "digit": n["digit"] / per,
        "symbol": n["symbol"] / per, "punct": n["punct"] / per, "wide": n["wide"] / per, "bar": n["bar"] / per, "shout": n["shout"] / per,
        "same_words": same_w / each, "same_grams": same_g / each, "again": again, "doc_words": doc_words[doc], "doc_same_grams": doc_grams[doc],
    }
    keep = np.flatnonzero(full)
    doc, size = doc[keep], size[keep]
    x = np.zeros((len(keep), len(EDGES) + 2 * len(_NEAR)), np.int16)
    rows, at, own = np.arange(len(keep)), 0, {}
    for k, (name, edges) in enumerate(EDGES.items()):
        own[name] = np.searchsorted(edges, measured[name][keep], "right").astype(np.int16)
        x[:, k] = at + own[name]
        at += len(edges) + 1
    same = doc[1:] == doc[:-1]
    for side, shift in enumerate((-1, 1)):  # the line before, the line after
        has = np.r_[np.zeros(min(1, len(keep)), bool), same] if shift < 0 else np.r_[same, np.zeros(min(1, len(keep)), bool)]
        there, first = rows[has], len(EDGES) + side * len(_NEAR)
        x[~has, first : first + len(_NEAR)] = at
        at += 1
        for k, name in enumerate(_NEAR):
            x[there, first + k] = at + own[name][there + shift]
            at += len(EDGES[name]) + 1
    return x, np.bincount(doc, minlength=len(texts)), size


_POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))


def _repeats(keys: np.ndarray) -> np.ndarray:
    """1 for each key that has come before, else 0."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys))
    if len(keys):
        out[order[1:][keys[order][1:] == keys[order][:-1]]] = 1
    return out


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts of ``BLOCK_BYTES`` at most together, or one longer text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


class QualityModel:
    """A field over lines, and a logistic map from a document's mean to a probability."""

    def __init__(self, field: LinearChainCRF, slope: float, middle: float, empty: float) -> None:
        self.field, self.slope, self.middle, self.empty = field, slope, middle, empty

    def means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean log odds of good lines, and which texts have any line."""
        x, lengths, weight = lines_of(texts)
        p = np.clip(self.field.marginals(x, lengths)[:, 1], 1e-6, 1 - 1e-6)
        doc = np.repeat(np.arange(len(texts)), lengths)
        weight = weight + 1e-3
        sums = np.bincount(doc, weight * p, len(texts)) / np.maximum(np.bincount(doc, weight, len(texts)), 1e-9)
        return sums, lengths > 0

    def score(self, texts: list[bytes]) -> np.ndarray:
        good, some = self.means(texts)
        odds = np.log(np.clip(good, 1e-6, 1 - 1e-6) / np.clip(1 - good, 1e-6, 1))
        return np.where(some, 1 / (1 + np.exp(-(self.slope * odds + self.middle))), self.empty)


def fit(texts: list[bytes], labels: list[int]) -> QualityModel | None:
    """A model of documents labelled 0 or 1; every line of a document has its label. None without rows."""
    if not texts:
        return None
    y = np.array(labels, np.int64)
    x, lengths = (np.concatenate(p) for p in zip(*(lines_of(own)[:2] for own in _blocks(texts)), strict=True))
    # documents weigh alike, however many lines they have
    field = LinearChainCRF.fit(x, np.repeat(y, lengths), lengths, N_FEATURES, weight=1 / np.maximum(lengths, 1) ** 0.5, penalty=1.0)
    share = float(y.mean())
    model = QualityModel(field, 1.0, 0.0, min(share, 0.49))
    good, some = (np.concatenate(p) for p in zip(*(model.means(own) for own in _blocks(texts)), strict=True))
    if some.any() and 0 < share < 1:
        odds = np.log(np.clip(good, 1e-6, 1 - 1e-6) / np.clip(1 - good, 1e-6, 1))[some]
        model.slope, model.middle = _logistic(odds, y[some])
    return model


def _logistic(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * odds).sum() + 0.01 * (a - 1), (p - y).sum()])
        h = np.array([[(w * odds * odds).sum() + 0.01, (w * odds).sum()], [(w * odds).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> QualityModel | None:
    """A model of at most ``max_docs`` labelled documents that are not held out, whole texts of ``max_bytes`` together.

    Rows without a doc_id or with a label other than 0 and 1 are left out; a doc_id counts once.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    turn = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = marks.filter(~held_out(F.col("doc_id"))).orderBy(turn, "doc_id").limit(max_docs)
    rows = docs.select(F.col("doc_id"), as_bytes().alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(turn, "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # max_docs rows at most
    pdf = rows.withColumn("so_far", so_far).filter(F.col("so_far") <= max_bytes).select("doc_id", "text", "quality").toPandas().sort_values("doc_id")
    return fit([bytes(t) for t in pdf["text"]], pdf["quality"].tolist())


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    ``score`` is the probability that the label is 1, from the text alone. Null and empty texts
    get the model's score for texts without lines; without a model every score is 0.5. A null
    doc_id is not held out. Repeated rows keep their rows, other columns do not matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(ids: list, texts: list) -> Iterator[tuple]:
        model = sent.value
        scores = (s for own in _blocks(texts) for s in ([0.5] * len(own) if model is None else model.score(own).tolist()))
        yield from zip(ids, scores, strict=True)

    rows = arrow_map(docs.select(F.col("doc_id").cast("long"), as_bytes()), kernel, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
