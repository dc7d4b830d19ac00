"""Compression classifier: zstandard dictionaries of good and bad text, and the difference of the compressed sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import PER_CLASS, class_weights, held_out, logistic, sample, sigmoid
from .ship import map_whole_rows, remote

_HERE = "strandspark.llm.quality"
#: Bytes compressed at once (the dictionary must still matter at a part's end), bytes of a dictionary, level.
PART, DICTIONARY, LEVEL = 1024, 32768, 3
#: The score from which a text is good.
THRESHOLD = 0.3


def _parts(text: bytes) -> list[bytes]:
    return [text[i : i + PART] for i in range(0, len(text), PART)]


class Compressor:
    """Normalised difference of a text's size under the bad and the good dictionary, over the whole text."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.both = [self._with(good), self._with(bad)]

    @staticmethod
    def _with(raw: bytes):
        dictionary = zstandard.ZstdCompressionDict(raw)
        dictionary.precompute_compress(LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def __call__(self, text: bytes) -> float:
        good, bad = self.both
        difference = 0
        for part in _parts(text):
            difference += len(bad(part)) - len(good(part))
        return difference / max(len(text), 1)


def _train(texts: list[bytes]) -> bytes:
    parts = [p for t in texts for p in _parts(t) if len(p) >= 16]
    total = sum(map(len, parts))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, total // 8)), parts).as_bytes()
    except zstandard.ZstdError:  # too few samples: their end serves as a raw dictionary
        return b"".join(parts)[-DICTIONARY:] or b"\0" * 8


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """Dictionaries from three quarters of a bounded sample, and a logistic calibration on the fourth.

    Labels are those of rows that :func:`held_out` leaves; 1 is good.  Without both classes every score is the share of
    good labels (0.5 without labels).
    """
    texts, y, fold, counts = sample(docs, labels, label, per_class)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n = sum(counts.values())
    base = counts.get(1, 0) / n if n else 0.5
    own = {v: [t for t, k, f in zip(raw, y, fold, strict=True) if k == v and f != 4] for v in (0, 1)}
    rest = [i for i, f in enumerate(fold) if f == 4 and y[i] in (0, 1)]
    if not own[0] or not own[1] or len({y[i] for i in rest}) < 2:
        return {"good": b"\0" * 8, "bad": b"\0" * 8, "slope": 0.0, "intercept": float(np.log((base + 1e-6) / (1 - base + 1e-6)))}
    good, bad = _train(own[1]), _train(own[0])
    measure = Compressor(good, bad)
    x = np.array([[100 * measure(raw[i])] for i in rest])
    found = [y[i] for i in rest]
    slope, intercept = logistic(x, np.array(found), class_weights(found, counts), ridge=1e-5)
    return {"good": good, "bad": bad, "slope": float(slope), "intercept": float(intercept)}


def _scores(batches, model: dict):
    measure = Compressor(model["good"], model["bad"])
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        x = np.array([100 * measure(t or b"") for t in texts])
        score = sigmoid(model["slope"] * x + model["intercept"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for each row, repeated ones each: the probability of label 1.

    Null and empty texts get the score of no difference.  Texts of any length are compressed whole; ids may be null; other
    columns are not looked at.  An empty table gives none.
    """
    return docs.select("doc_id", "text").mapInArrow(remote(f"{_HERE}:_scores", model=model), "doc_id long, score double")


def _keeps(batches, model: dict, threshold: float, text_at: int):
    measure = Compressor(model["good"], model["bad"])
    for batch in batches:
        texts = batch.column(text_at).cast(pa.large_binary()).to_pylist()
        x = np.array([100 * measure(t or b"") for t in texts])
        yield batch.filter(pa.array(sigmoid(model["slope"] * x + model["intercept"]) >= threshold))


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns, of any names; nulls and repeats as for :func:`score`."""
    return map_whole_rows(docs, remote(f"{_HERE}:_keeps", model=model, threshold=threshold, text_at=docs.columns.index("text")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; see :func:`fit` and :func:`score` for nulls, empty and repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
