"""Bounded samples of labelled texts, and small models that are fitted to them on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a training sample: rows of each class (about), bytes of their whole texts (then fewer rows are taken), and bytes of
#: a text that is taken at all.  Scoring has no such bounds.
PER_CLASS, CLASS_BYTES, LONGEST = 2000, 8 << 20, 1 << 20
_FINE = 1 << 24


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by 5: labels of these rows are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> tuple[list[str], list, list[int], dict]:
    """Whole texts, labels, fold numbers (1 to 4) and class counts of about ``per_class`` labelled rows of each class.

    ``labels`` has (doc_id, label), or is ``docs`` itself; null labels and held-out rows are left out, and ids with several
    different labels in a table of their own.  The rows are those with the smallest hash of the id, the same on every run; a class's rows end, in the order of that hash, where their texts have
    ``CLASS_BYTES``, and texts beyond ``LONGEST`` aren't taken.  Only ids below a bound on the hash meet the texts.  Equal
    rows count once, and at most 3 * per_class * classes rows (those with the smallest hashes of id and text) come to the
    driver, however often an id repeats.  More than 1000 classes are refused.
    """
    own = labels is docs  # labels that are a column of the documents need no join
    text = F.coalesce("text", F.lit("")).alias("_text")
    known = labels.select("doc_id", F.col(label).alias("_label"), *([text] if own else [])).filter(F.col("_label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    if not own:
        known = known.groupBy("doc_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).filter("_label = _other").drop("_other")
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).orderBy("_label").limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError("more than 1000 classes")
    if not counts:
        return [], [], [], {}
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_FINE))
    most = 3 * per_class * len(counts)

    def below(ends: dict) -> Column:
        end = F.lit(0)
        for value, e in sorted(ends.items()):
            end = F.when(F.col("_label") == F.lit(value), F.lit(e)).otherwise(end)
        return place < end

    ends = {value: int(min(_FINE, 1.2 * per_class / n * _FINE)) for value, n in counts.items()}
    if own:
        texts = known.filter(below(ends))
    else:
        texts = docs.select("doc_id", text).join(F.broadcast(known.filter(below(ends)).orderBy(place, "doc_id").limit(most)), "doc_id")
    order = [place.alias("_place"), F.xxhash64("_text").alias("_hash")]
    fit = texts.filter(F.octet_length("_text") <= LONGEST)
    sizes = fit.select("doc_id", "_label", *order, F.octet_length("_text").alias("_size")).distinct().orderBy("_place", "doc_id", "_hash", "_label").limit(most).toPandas()
    for value, of in sizes.groupby("_label"):
        over = of["_place"][of["_size"].cumsum() > CLASS_BYTES]
        ends[value] = min([ends[value], *over.head(1).tolist()])
    last = int(sizes["_place"].max()) if len(sizes) == most else _FINE
    rows = fit.filter(below(ends) & (place <= last)).select("doc_id", "_label", "_text", *order).dropDuplicates(["doc_id", "_label", "_hash"])
    rows = rows.orderBy("_place", "doc_id", "_hash", "_label").limit(most).withColumn("_fold", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("_text", "ascending"), ("_label", "ascending")])
    return rows["_text"].to_pylist(), rows["_label"].to_pylist(), rows["_fold"].to_pylist(), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Coefficients (the last is the intercept) of a weighted logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = weight / max(weight.sum(), 1e-9)
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9
    loss = lambda b: (weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ b))).sum() + 0.5 * (penalty * b * b).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        gradient = x.T @ (weight * (p - y)) + penalty * b
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step, t, now = np.linalg.solve(hessian, gradient), 1.0, loss(b)
        while t > 1e-4 and loss(b - t * step) > now:
            t /= 2
        b = b - t * step
        if np.abs(t * step).max() < 1e-7:
            break
    return b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def class_weights(y: list, counts: dict) -> np.ndarray:
    """Weights that give each class its share of all labelled rows again."""
    y = np.array(y)
    return np.array([counts[v] / max(1, (y == v).sum()) for v in y.tolist()])
