"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the n-grams of a text's characters (code points, lower-cased; white space of ASCII counts as spaces), hashed to a
fixed table.  A feature's value is its count divided by the text's n-grams, times its inverse document frequency.  Training
is follow-the-regularised-leader with elastic-net penalties; a temperature from a fold of its own calibrates the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import held_out, sample
from .ship import remote
from .text import CHUNK

_HERE = "strandspark.llm.language"
BITS, ORDERS, SCALE = 16, (1, 2, 3), 20.0
UNKNOWN = "und"
#: Code points below this are lower-cased where that is one code point; all cased scripts lie there.
_CASED = 0x1F000
_LOWER = np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(_CASED)], dtype=np.uint32)
_LOWER[[9, 10, 11, 12, 13]] = 32
_ALPHA = np.array([chr(i).isalpha() for i in range(_CASED)])
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of texts that stand one after another in UTF-8 bytes, their offsets, and which are letters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    cased = points < _CASED
    letters = np.where(cased, _ALPHA[np.where(cased, points, 0)], False)
    if not cased.all():
        letters[~cased] = [chr(p).isalpha() for p in points[~cased].tolist()]
    return np.where(cased, _LOWER[np.where(cased, points, 0)], points), before[offsets], letters


def features(points: np.ndarray, order: int) -> np.ndarray:
    """Table places of the n-grams that begin at each code point (fewer at the end)."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    with np.errstate(over="ignore"):
        h = points[:n].copy()
        for k in range(1, order):
            h = h * np.uint32(0x01000193) ^ (points[k : k + n] * np.uint32(0x9E3779B1))
        return ((h + np.uint32(order)) * _MULTIPLY[order - 1]) >> np.uint32(32 - BITS)


def _counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    points, _, _ = code_points(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return np.unique(np.concatenate([features(points, k) for k in ORDERS]), return_counts=True) if len(points) else (np.empty(0, np.uint32), np.empty(0))


def train(texts: list[bytes], y: np.ndarray, classes: int, alpha=0.5, beta=1.0, l1=2e-3, l2=1e-3, epochs=4) -> tuple[np.ndarray, np.ndarray]:
    """(weights times idf, by table place and class; intercepts)."""
    rows = [_counts(t) for t in texts]
    df = np.zeros(1 << BITS)
    for place, _ in rows:
        df[place] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)
    solve = lambda z, n, l1: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            place, count = rows[i]
            if not len(place):
                continue
            x = (count * (SCALE / count.sum()) * idf[place])[:, None]
            w, wb = solve(z[place], n[place], l1), solve(zb, nb, 0.0)
            s = (x * w).sum(0) + wb
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x * p
            z[place] += g - (np.sqrt(n[place] + g * g) - np.sqrt(n[place])) / alpha * w
            n[place] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * wb
            nb += p * p
    return (solve(z, n, l1) * idf[:, None] * SCALE).astype(np.float32), solve(zb, nb, 0.0)


def _logits(points: np.ndarray, offsets: np.ndarray, weights: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Of texts that stand one after another in ``points``; n-grams across a border of two texts don't count."""
    lengths = np.diff(offsets)
    total = np.zeros((len(lengths), weights.shape[1]))
    grams = np.zeros(len(lengths))
    for k in ORDERS:
        place = features(points, k)
        owner_ends = np.maximum(offsets[1:] - k + 1, offsets[:-1])
        use = lengths >= k
        grams += np.where(use, lengths - k + 1, 0)
        if not use.any():
            continue
        edges = np.column_stack([offsets[:-1][use], owner_ends[use]]).ravel()
        for c in range(weights.shape[1]):
            values = np.append(weights[:, c][place], np.float32(0)).astype(np.float64)
            total[use, c] += np.add.reduceat(values, np.minimum(edges, len(values) - 1))[::2]
    return total / np.maximum(grams, 1)[:, None] + intercept


def fit(docs: DataFrame, per_class: int = 800) -> dict:
    """A model from the text and non-null lang of rows that :func:`held_out` leaves, by a bounded sample (see ``labels.sample``)."""
    texts, y, fold, counts = sample(docs, docs, "lang", per_class)
    names = sorted(counts)
    if not names:
        return {"names": [UNKNOWN], "weights": np.zeros((1 << BITS, 1), np.float32), "intercept": np.zeros(1), "temperature": 1.0}
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.array([names.index(v) for v in y])
    fold = np.array(fold)
    own = np.flatnonzero(fold != 4) if (fold != 4).any() else np.arange(len(raw))
    weights, intercept = train([raw[i] for i in own], at[own], len(names))
    rest = [i for i in np.flatnonzero(fold == 4) if raw[i]]
    temperature = 1.0
    if rest:
        s = np.vstack([_logits(*code_points(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]))[:2], weights, intercept) for i in rest])
        grid = np.geomspace(0.05, 20, 61)
        loss = [(np.log(np.exp((s - s.max(1, keepdims=True)) / t).sum(1)) - (s[np.arange(len(s)), at[rest]] - s.max(1)) / t).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return {"names": names, "weights": weights, "intercept": intercept, "temperature": temperature}


def _predict(batches, model: dict):
    names, weights = np.array(model["names"], dtype=object), np.asfortranarray(model["weights"])
    for batch in batches:
        column = batch.column(1).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
        best, score = np.empty(len(column), dtype=object), np.empty(len(column))
        row = 0
        while row < len(column):
            end = min(len(column), max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1))
            part, own, letter = code_points(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
            s = _logits(part, own, weights, model["intercept"]) / model["temperature"]
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best[row:end], score[row:end] = names[p.argmax(1)], p.max(1)
            letters = np.concatenate([[0], np.cumsum(letter)])
            none = row + np.flatnonzero(letters[own[1:]] == letters[own[:-1]])
            best[none], score[none] = UNKNOWN, 1.0
            row = end
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) for each row, whatever its id: repeated rows are predicted each.

    ``und`` with score 1 where the text is null, empty or has no letter.  Whole texts count, of any length; ties go to the
    language whose name is first.  Other columns are not looked at.  An empty table gives none.
    """
    return docs.select("doc_id", "text").mapInArrow(remote(f"{_HERE}:_predict", model=model), "doc_id long, lang_pred string, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; see :func:`fit` and :func:`predict` for nulls, empty and repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
