"""Quality rules: robust multivariate outliers by minimum covariance determinant, for each language and source.

Each document gives counts of its words, symbols, repeated lines and repeated word windows.  Documents that pass fixed
base rules give a vector of transformed counts.  Within a language and source, the mean and covariance of the three
quarters of vectors whose covariance has the smallest determinant are looked for by concentration steps from four starts
(median and MAD, all rows, hyperbolic-tangent correlations, spatial signs), over all rows, as distributed sums: two steps
from each, then on from the two of smallest determinant until it falls no further, of which the smaller one is taken.  A
document is rejected if its squared Mahalanobis distance is beyond a high chi-square quantile.

A group without any symbol or repeated line is a point in those dimensions, so FLOORS' squares are added to the variances of
the estimate that distances are measured by (a text is then never an outlier by less than about four floors in a dimension);
determinants are compared with them too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ship import remote, stash
from .text import chunks, grams, mix

_HERE = "strandspark.llm.rules"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Dimensions, their least standard deviations (so that a group without any symbol or repeated line isn't a point), share of
#: rows in the core, tail beyond which a document goes, rows of a group for an estimate of its own.
FLOORS, CORE, TAIL, LEAST_ROWS = (0.05, 0.1, 0.1, 0.1, 0.3), 0.75, 1e-3, 50
#: Starts, concentration steps from each of them, steps from the best ones at most, estimates that are broadcast at most.
STARTS, FIRST_STEPS, MOST_STEPS, BROADCAST_ROWS = 4, 2, 20, 20_000
SIZE = len(FLOORS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = b" \t\n\x0b\x0c\r"


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, out = set(), 0
    for line in lines:
        if line in seen:
            out += bool(line.strip(_BLANK))
        else:
            seen.add(line)
    return out


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _count(batches, text_at: int):
    for batch in batches:
        n = batch.num_rows
        out = np.zeros((5, n), np.int64)
        for a, b, w in chunks(batch.column(text_at)):
            points = (w.data & 0xC0) != 0x80
            space = np.isin(w.data, np.frombuffer(_BLANK, np.uint8))
            out[0, a:b] = np.diff(w.first)
            out[1, a:b] = _per_text(points & ~space, w.offsets)
            out[2, a:b] = _per_text(_SYMBOL[w.data], w.offsets)
            out[3, a:b] = [_dup_lines(w.text(i)) for i in range(b - a)]
            g = grams(w.hash, 3)
            if len(g):
                owner = np.repeat(np.arange(b - a), np.diff(w.first))
                start = np.flatnonzero(owner[: len(g)] == owner[2:])
                with np.errstate(over="ignore"):
                    key = mix(g[start] + owner[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                by = np.argsort(key, kind="stable")
                equal = key[by][1:] == key[by][:-1]
                twice = np.zeros(len(key), bool)
                twice[by[1:][equal]] = twice[by[:-1][equal]] = True
                covered = np.zeros(len(w.hash), bool)
                for k in range(3):
                    covered[start[twice] + k] = True
                out[4, a:b] = _per_text(covered, w.first)
        columns = [c for i, c in enumerate(batch.columns) if i != text_at] + [pa.array(x) for x in out]
        names = [c for i, c in enumerate(batch.schema.names) if i != text_at] + list(COUNTS)
        yield pa.RecordBatch.from_arrays(columns, names=names)


def count(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS for each row; null texts have none of anything."""
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(remote(f"{_HERE}:_count", text_at=3), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi_square(p: float, k: int) -> float:
    """The p quantile of chi-square with k degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(k / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") * 10 / words),
        F.sqrt(F.col("n_repeat_words") / words),
        F.log1p(F.col("n_words")),
    ]


def _distance() -> Column:
    d = [F.col("x")[i] - F.col("mean")[i] for i in range(SIZE)]
    out = F.lit(0.0)
    for i in range(SIZE):
        for j in range(i, SIZE):
            out = out + d[i] * d[j] * F.col("precision")[i * SIZE + j] * (1 if i == j else 2)
    return out


_ESTIMATE = "grp string, start int, rows long, mean array<double>, precision array<double>, det double"
_TRIANGLE = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]


def _square(values) -> np.ndarray:
    full = np.zeros((SIZE, SIZE))
    full[np.triu_indices(SIZE)] = values
    return full + np.triu(full, 1).T


def _estimates(rows: list[tuple]) -> pa.RecordBatch:
    """(grp, start, rows, mean, covariance) -> _ESTIMATE; the floors' variances are added, so the covariance can be inverted."""
    columns: list[list] = [[] for _ in range(6)]
    for grp, start, n, mean, cov in rows:
        cov = (cov + cov.T) / 2 + np.diag(np.square(FLOORS))
        for column, value in zip(columns, (grp, start, n, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])), strict=True):
            column.append(value)
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _ESTIMATE.split(", ")])


def _moments(n: int, total, squares) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array(total) / n
    return mean, _square(np.array(squares) / n) - np.outer(mean, mean)


def _starts(batches):
    """A group's median m, MAD-based spread d and sums -> one estimate for each start."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            n, m, d = r["rows"], np.array(r["m"]), np.maximum(np.array(r["d"]), np.array(FLOORS))
            out.append((r["grp"], 0, n, m, np.diag(np.square(d))))
            out.append((r["grp"], 1, n, *_moments(n, r["total"], r["squares"])))
            for start, sums in ((2, r["tanh"]), (3, r["signs"])):
                c = _square(np.array(sums) / n)
                scale = np.sqrt(np.maximum(np.diag(c), 1e-12))
                out.append((r["grp"], start, n, m, c / np.outer(scale, scale) * np.outer(d, d)))
        yield _estimates(out)


def _cores(batches):
    """Sums of a core -> the core's mean and covariance, made consistent with a normal distribution's."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            mean, cov = _moments(r["n"], r["s"], r["c"])
            out.append((r["grp"], r["start"], r["rows"], mean, cov / consistency()))
        yield _estimates(out)


def consistency() -> float:
    """Factor by which the core's covariance falls short of a normal distribution's."""
    return _gamma_p(SIZE / 2 + 1, chi_square(CORE, SIZE) / 2) / CORE


def _beside(vectors: DataFrame, few: DataFrame, n: int) -> DataFrame:
    """Vectors with their group's rows of ``few``: a broadcast of at most BROADCAST_ROWS rows, else a join by group."""
    return vectors.join(F.broadcast(few) if n <= BROADCAST_ROWS else few, "grp")


def _medians(vectors: DataFrame, column) -> Column:
    return F.array(*[F.percentile_approx(column(i), 0.5, 1000) for i in range(SIZE)])


def _step(vectors: DataFrame, now: DataFrame, n: int) -> DataFrame:
    """The estimates of the cores that the estimates ``now`` give: one concentration step of each group and start."""
    far = _beside(vectors, now.select("grp", "start", "mean", "precision"), n).withColumn("d", _distance()).select("grp", "start", "x", "d")
    edge = far.groupBy("grp", "start").agg(F.percentile_approx("d", CORE, 1000).alias("edge"))
    limits = now.join(edge, ["grp", "start"]).select("grp", "start", "rows", "mean", "precision", "edge")
    core = _beside(vectors, limits, n).filter(_distance() <= F.col("edge"))
    sums = core.groupBy("grp", "start").agg(F.max("rows").alias("rows"), F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(SIZE)]).alias("s"), F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in _TRIANGLE]).alias("c"))
    return stash(sums.mapInArrow(remote(f"{_HERE}:_cores"), _ESTIMATE))


def _best(now: DataFrame, most: int) -> DataFrame:
    """The starts with the smallest determinants of each group; ties go to the smaller number."""
    return now.withColumn("place", F.row_number().over(W.partitionBy("grp").orderBy("det", "start"))).filter(F.col("place") <= most).drop("place")


def estimate(vectors: DataFrame) -> DataFrame:
    """_ESTIMATE of each group of a table (grp, x): that of the smallest determinant found.

    A step never raises a core's determinant but for the rounding of the core's size and quantile, so the better estimate of
    a group and start is kept, and steps end where none falls by more than 1e-6 of itself.
    """
    sizes = stash(vectors.groupBy("grp").agg(F.count("*").alias("rows"), _medians(vectors, lambda i: F.col("x")[i]).alias("m")))
    n = STARTS * sizes.count()
    spread = _beside(vectors, sizes, n).groupBy("grp").agg(_medians(vectors, lambda i: F.abs(F.col("x")[i] - F.col("m")[i])).alias("mad"))
    known = stash(sizes.join(spread, "grp").select("grp", "rows", "m", F.transform("mad", lambda v: v * 1.4826).alias("d")))
    z = F.array(*[(F.col("x")[i] - F.col("m")[i]) / F.greatest(F.col("d")[i], F.lit(FLOORS[i])) for i in range(SIZE)])
    rows = _beside(vectors, known, n).withColumn("z", z).withColumn("t", F.transform("z", F.tanh)).withColumn("r", F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v))
    products = lambda c, by=F.lit(1.0): F.array(*[F.sum(F.col(c)[i] * F.col(c)[j] / by) for i, j in _TRIANGLE])
    sums = rows.groupBy("grp").agg(F.array(*[F.sum(F.col("x")[i]) for i in range(SIZE)]).alias("total"), products("x").alias("squares"), products("t").alias("tanh"), products("z", F.greatest("r", F.lit(1e-12))).alias("signs"))
    now = stash(known.join(sums, "grp").mapInArrow(remote(f"{_HERE}:_starts"), _ESTIMATE))
    for _ in range(FIRST_STEPS):
        now = _step(vectors, now, n)
    best = stash(_best(now, 2))
    for _ in range(MOST_STEPS):
        after = _step(vectors, best, n)
        both = best.withColumn("new", F.lit(0)).unionByName(after.withColumn("new", F.lit(1)))
        pick = W.partitionBy("grp", "start").orderBy("det", "new")
        change = F.max("det").over(W.partitionBy("grp", "start")) - F.col("det")
        picked = stash(both.withColumn("change", change).withColumn("place", F.row_number().over(pick)).filter("place = 1").withColumn("fell", (F.col("new") == 1) & (F.col("change") > 1e-6)).drop("place", "change", "new"))
        best = picked.drop("fell")
        if not picked.filter("fell").limit(1).count():
            break
    return stash(_best(best, 1))


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, distance and kept for each row.

    base_failed: fewer than 50 words, or more than half of them in repeated windows.  ``distance`` is the squared
    Mahalanobis distance from the group's robust mean; null only for failed rows.  Sources with fewer than ``LEAST_ROWS``
    rows of a language are judged together; where those are fewer too, by all of the language, then by all rows.  A null
    language or source is one of its own.  Null and empty texts fail the base rules.  Repeated rows and ids, and null ids, are
    judged row by row; equal vectors get equal verdicts.  Texts of any length are counted whole; an empty table gives none;
    other columns are not looked at.
    """
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    counted = stash(count(docs).withColumn("base_failed", failed).withColumn("x", F.array(*_vector())).withColumn("_id", F.monotonically_increasing_id()))
    lang = F.concat(F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")), F.lit("\n"))
    own = F.concat(lang, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    passed = counted.filter("not base_failed").select("_id", "x", own.alias("own"), lang.alias("wide"))
    of = W.partitionBy("wide")
    sizes = passed.groupBy("own", "wide").agg(F.count("*").alias("rows")).withColumn("small", F.sum(F.when(F.col("rows") < LEAST_ROWS, F.col("rows"))).over(of)).withColumn("whole", F.sum("rows").over(of))
    level = F.when(F.col("rows") >= LEAST_ROWS, F.col("own")).when(F.col("small") >= LEAST_ROWS, F.col("wide")).when(F.col("whole") >= LEAST_ROWS, F.concat(F.lit("w"), "wide")).otherwise(F.lit("a"))
    levels = stash(sizes.select("own", "wide", level.alias("grp")))
    vectors = stash(passed.join(F.broadcast(levels.select("own", "grp")) if levels.count() <= BROADCAST_ROWS else levels.select("own", "grp"), "own").select("_id", "wide", "grp", "x"))
    wholes = levels.filter(F.col("grp") == F.concat(F.lit("w"), "wide")).select("wide", "grp").distinct()
    parts = vectors.filter((F.col("grp") != "a") & ~F.col("grp").startswith("w")).select("grp", "x")
    if wholes.limit(1).count():
        parts = parts.unionByName(vectors.drop("grp").join(wholes, "wide").select("grp", "x"))
    if levels.filter("grp = 'a'").limit(1).count():
        parts = parts.unionByName(vectors.select(F.lit("a").alias("grp"), "x"))
    known = estimate(parts)
    far = _beside(vectors, known.select("grp", "mean", "precision"), known.count()).select("_id", _distance().alias("distance"))
    limit = chi_square(1 - tail, SIZE)
    return counted.join(far, "_id", "left").withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= limit)).drop("_id", "x")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; see :func:`judge` for nulls, empty and repeated rows."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *COUNTS, "base_failed", "distance", "kept")
