"""Time-varying curriculum over sources, in DataFrame expressions only.

Every source has a weight schedule over training time [0, 1].  Its integral, scaled to the source's token target, is the
source's cumulative demand.  Documents of a source stand in a fixed pseudo-random order (MD5 of ``doc_id``), and the pass
over a document that begins at cumulative token u of the source is trained at the time where the demand reaches u.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ship import stash
from .text import WORD

#: Piecewise linear weight schedules, one for each source in turn: fades out, stays level, comes in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
NAMES = ("size", "source_size", "target", "taken", "position", "passes")


def _inverse(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the normalised integral of the schedule reaches u (0 to 1)."""
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False)]
    total, before, out = sum(areas), 0.0, None
    for k, (((t0, a), (t1, b)), area) in enumerate(zip(zip(knots, knots[1:], strict=False), areas, strict=False)):
        rest, slope = u * total - before, (b - a) / (t1 - t0)
        at = F.lit(t0) + (rest / a if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + rest * 2 * slope, F.lit(0.0))) - a) / slope)
        out = F.when(u * total <= before + area, at) if out is None else (out.when(u * total <= before + area, at) if k < len(areas) - 1 else out.otherwise(at))
        before += area
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, share: float, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size) with one row per source -> also place, target.

    Water filling: sources reach their caps in the order of cap / weight, and the level is what the others share.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    fill = W.orderBy("_ratio", "place")
    one = W.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(one) * F.lit(share))
        .withColumn("_full", F.sum("_cap").over(fill.rowsBetween(W.unboundedPreceding, 0)) - F.col("_cap"))
        .withColumn("_rest", F.sum("_w").over(fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_rest"))
        .withColumn("_level", F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .select("source", "source_size", "place", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double"))).alias("target"))
    )


def mix(docs: DataFrame, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), most: int = 2, digits: int | None = None, schedules=SCHEDULES, size: Column | None = None) -> DataFrame:
    """One row per document: its columns, and size, source_size, target, taken, position, passes.

    ``share`` of all words is dealt to the sources by ``weights`` (repeated along the sources by code point, null last); no
    source gets more than ``most`` times its size, the excess goes to the others.  A source's words are taken in whole
    passes over its documents; the last pass ends at the target, inside a document if need be, so that the source's taken
    words equal its rounded target.  ``passes`` holds (pass, position, words) for each pass that takes words;
    ``position`` is the first one's time, null if the document isn't taken.  Computed columns replace input columns of the
    same name; others may have any name.  Null or empty texts have size 0 and are not taken; a null source is a source; null
    and repeated ids are documents of their own.  Ties in the order go to the smaller size, and rows that tie there too are
    interchangeable.  An empty table gives none.  ``size`` is the number of words where that is known already.

    Order within a source comes from sums over 16^``digits`` key ranges (by default as many as leave about 100,000 documents
    to a range, 4,096 to a million), so a source of any size is spread over tasks.
    """
    if size is None:
        size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    if digits is None:
        digits = min(5, max(3, math.ceil(math.log(max(docs.count(), 1) / 100_000, 16))))
    names = [c for c in docs.columns if c not in NAMES]
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = docs.select(F.struct(*map(_quoted, names)).alias("row"), "doc_id", "source", size.cast("long").alias("size"), key.alias("key")).withColumn("range", F.substring("key", 1, digits))
    ranges = own.groupBy("source", "range").agg(F.sum("size").alias("words"))
    goal = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), share, weights, most)
    ahead = ranges.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("range")) - F.col("words"))
    ahead = ahead.alias("a").join(goal.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source"))).select(F.col("a.source").alias("of"), F.col("range").alias("in_range"), "before", "source_size", "place", "target")
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = own.withColumn("inside", F.sum("size").over(within) - F.col("size")).join(ahead, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in_range")))
    goal_words = F.round("target").cast("long")
    passes = []
    for p in range(most):
        start = F.col("before") + F.col("inside") + F.col("source_size") * p
        u = start / F.greatest(F.col("target"), F.lit(1.0))
        at = F.when(F.col("place") % len(schedules) == 0, _inverse(u, schedules[0]))
        for k in range(1, len(schedules)):
            at = at.when(F.col("place") % len(schedules) == k, _inverse(u, schedules[k]))
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal_words - start)).cast("long")
        passes.append(F.struct(F.lit(p).alias("pass"), at.alias("position"), words.alias("words")))
    return (
        placed.withColumn("passes", F.filter(F.array(*passes), lambda x: x["words"] > 0))
        .withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda s, x: s + x["words"]))
        .withColumn("position", F.try_element_at("passes", F.lit(1))["position"])
        .select("row.*", *NAMES)
    )


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each pass over a document, range-sorted by training position (doc_id and pass break ties).

    ``pass``, ``position`` and ``words`` of the pass replace columns of these names.
    """
    names = [c for c in mixed.columns if c not in ("passes", "pass", "position", "words")]
    each = mixed.select(F.struct(*map(_quoted, names)).alias("row"), F.explode("passes").alias("at")).select("row.*", "at.pass", "at.position", "at.words")
    by = ("position", "doc_id", "pass")
    return (each.repartitionByRange(partitions, *by) if partitions else each.repartitionByRange(*by)).sortWithinPartitions(*by)


def in_order(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by their first position; those that aren't taken spread by doc_id."""
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op5(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents; see :func:`mix` for nulls, empty and repeated rows.  Texts are counted once and left behind."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    docs = stash(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", size.alias("words")))
    return in_order(mix(docs, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position")))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + place % 3] AS w, 2 * source_size AS cap FROM s),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, cap / w) AS level FROM f WHERE level <= cap / w),
t AS (SELECT f.source, f.source_size, f.place, least(CAST(cap AS DOUBLE), coalesce(l.level * f.w, CAST(cap AS DOUBLE))) AS target FROM f LEFT JOIN l ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, size, source_size, target, place, n.n AS n, start + n.n * source_size AS start,
             greatest(0, least(size, CAST(round(target) AS BIGINT) - (start + n.n * source_size))) AS words,
             (start + n.n * source_size) / greatest(target, 1.0) AS u FROM p, (VALUES (0), (1)) n(n)),
q AS (SELECT *, CASE place % 3 WHEN 0 THEN 1.5 - sqrt(greatest(2.25 - 2 * u, 0)) WHEN 1 THEN u
                ELSE CASE WHEN u <= 0.375 THEN sqrt(greatest(0.25 + 2 * u, 0)) - 0.5 ELSE 0.5 + sqrt(greatest(1.0 + 2 * (u - 0.375), 0)) - 1.0 END END AS x FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(words) AS BIGINT) AS taken,
       round(min(CASE WHEN words > 0 THEN least(greatest(x, 0.0), 1.0) END), 6) AS position
FROM q GROUP BY doc_id, size, source_size, target
"""
