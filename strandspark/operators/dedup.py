"""Duplicate marking: pairs by both ends' 5' places, fragments by one, the best score stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from .view import toggle_pairs

UNKNOWN = "Unknown Library"


def with_library(reads: DataFrame, groups: DataFrame) -> DataFrame:
    return reads.join(groups, "rg", "left").withColumn("library", F.coalesce("library", F.lit(UNKNOWN)))


def ends(reads: DataFrame, order: Sequence[str], score: str) -> DataFrame:
    """Eligible ends: mapped, placed, primary; with 5' place, strand and whether the mate is mapped too."""
    use = ~C.has("unmapped") & (F.col("ref_id") != -1) & ~C.has("secondary")
    return reads.filter(use).select(*order, "library", "rg", "idx", F.col(score).alias("_score"), C.five_prime().alias("coord"), C.has("reverse").alias("rev"), (C.has("paired") & ~C.has("mate_unmapped")).alias("paired"))


def fragment_duplicates(e: DataFrame) -> DataFrame:
    """idx of duplicate fragments: unpaired ends beside a paired one, or all but the best of unpaired ones."""
    key = ["library", "ref_id", "coord", "rev"]
    g = W.partitionBy(*key)
    rank = F.row_number().over(g.orderBy(F.col("paired"), F.desc("_score"), "idx"))
    return e.withColumn("any", F.max("paired").over(g)).withColumn("rank", rank).filter(~F.col("paired") & (F.col("any") | (F.col("rank") > 1))).select("idx")


def pair_duplicates(e: DataFrame) -> DataFrame:
    """idx of both ends of all pairs but the best of each key (library, both places, orientation)."""
    t = toggle_pairs(e.filter("paired"), ["rg", "name"], ["idx"])
    place = F.struct("ref_id", "coord", "rev", "idx", "_score")
    pairs = t.groupBy("rg", "name", "pair", "library").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).filter("n = 2")
    w = W.partitionBy("library", "a.ref_id", "a.coord", "a.rev", "b.ref_id", "b.coord", "b.rev").orderBy(F.desc(F.col("a._score") + F.col("b._score")), F.least("a.idx", "b.idx"), F.greatest("a.idx", "b.idx"))
    return pairs.withColumn("rank", F.row_number().over(w)).filter("rank > 1").select(F.explode(F.array("a.idx", "b.idx")).alias("idx"))


def duplicates(e: DataFrame) -> DataFrame:
    """idx of all duplicates, fragments and pairs, in one pass over the ends: three sorts by key, and no scan twice.

    Reads without a mate at hand are pairs of their own, so they are spread and never duplicates as pairs.
    """
    g = W.partitionBy("library", "ref_id", "coord", "rev")
    fragment = ~F.col("paired") & (F.max("paired").over(g) | (F.row_number().over(g.orderBy("paired", F.desc("_score"), "idx")) > 1))
    place = F.struct("ref_id", "coord", "rev", "idx", "_score")
    own = e.withColumn("fragment", fragment).withColumn("place", place)
    by_name = W.partitionBy("rg", "name", "paired").orderBy("idx")
    mate = F.when(~F.col("paired"), None).when(F.row_number().over(by_name) % 2 == 1, F.lead("place").over(by_name)).otherwise(F.lag("place").over(by_name))
    both = own.withColumn("mate", mate).select("idx", "library", "fragment", "place", "mate", F.least("place", F.coalesce("mate", "place")).alias("a"), F.greatest("place", F.coalesce("mate", "place")).alias("b"))
    alone = F.when(F.col("mate").isNull(), F.col("idx"))
    key = W.partitionBy("library", "a.ref_id", "a.coord", "a.rev", "b.ref_id", "b.coord", "b.rev", alone).orderBy(F.desc(F.col("a._score") + F.col("b._score")), F.least("a.idx", "b.idx"), F.greatest("a.idx", "b.idx"))
    return both.withColumn("rank", F.dense_rank().over(key)).filter("fragment or rank > 1").select("idx")


def mark_duplicates(reads: DataFrame, groups: DataFrame, score: str = "score", order: Sequence[str] = ("ref_id", "name", "flag"), remove: bool = False) -> DataFrame:
    """Sets the duplicate flag of primary reads anew (others keep theirs), or removes what it would mark.

    ``idx`` is the reads' unique place in the input.  The marks meet the reads in one join on it.
    """
    e = ends(with_library(reads, groups), order, score)
    dup = duplicates(e).withColumn("_dup", F.lit(True))
    if remove:
        return reads.join(dup, "idx", "left_anti").withColumn("flag", F.when(C.has("secondary"), F.col("flag")).otherwise(C.set_flag("duplicate", False)))
    marked = reads.join(dup, "idx", "left")
    new = C.set_flag("duplicate", F.coalesce(F.col("_dup"), F.lit(False)))
    return marked.withColumn("flag", F.when(C.has("secondary"), F.col("flag")).otherwise(new)).drop("_dup")
