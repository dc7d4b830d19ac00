"""Counts, statistics, coverage, comparison and index metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from . import ranges


def flag_counters() -> dict[str, Column]:
    p, mapped, mate = C.has("paired"), ~C.has("unmapped"), ~C.has("mate_unmapped")
    return {
        "total": F.lit(True), "duplicates": C.has("duplicate"), "failed_qc": C.has("failed_qc"), "mapped": mapped, "reverse_strand": C.has("reverse"), "forward_strand": ~C.has("reverse"),
        "paired": p, "first_mate": p & C.has("first"), "second_mate": p & C.has("second"), "both_mapped": p & mapped & mate, "singletons": p & mapped & ~mate, "proper_pairs": p & C.has("proper_pair"),
    }


def flagstat(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return reads.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in flag_counters().items()])


def percentages(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    share = lambda n, d: F.when(F.col(d) != 0, F.round(F.col(n) * 100 / F.col(d), 4)).alias(f"{n}_pct")
    return counts.select(*by, *[share(n, "total") for n in ("mapped", "forward_strand", "reverse_strand", "failed_qc", "duplicates", "paired")], *[share(n, "paired") for n in ("proper_pairs", "both_mapped", "first_mate", "second_mate", "singletons")])


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy("read_len").agg(F.count("*").alias("reads"))


def insert_sizes(reads: DataFrame) -> DataFrame:
    use = C.has("paired") & C.has("first") & (F.col("insert_size") != 0)
    return reads.filter(use).agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs("insert_size")), 4).alias("mean"), F.median(F.abs("insert_size")).alias("median"))


def out_of_order(reads: DataFrame, order: Sequence[str], block: Column, stretch: Column) -> DataFrame:
    """For each block of the input order, placed reads that stand before a read they should follow.

    ``stretch`` doesn't fall along the order: reads are compared within a stretch, and the stretches by their ends.
    """
    placed = reads.filter((F.col("ref_id") != -1) & (F.col("pos") != -1)).select(block.alias("block"), stretch.alias("stretch"), "ref_id", "pos", *[c for c in order if c not in ("ref_id", "pos")])
    falls = lambda before, after: F.coalesce(before > after, F.lit(False))
    place = F.struct("ref_id", "pos")
    w = W.partitionBy("block", "stretch").orderBy(*order)
    inside = placed.select("block", "stretch", place.alias("at"), F.struct(*order).alias("key"), falls(F.lag(place).over(w), place).alias("bad"))
    parts = inside.groupBy("block", "stretch").agg(F.count_if("bad").alias("bad"), F.min_by("at", "key").alias("first"), F.max_by("at", "key").alias("last"))
    joint = falls(F.lag("last").over(W.partitionBy("block").orderBy("stretch")), F.col("first")).cast("long")
    return parts.select("block", (F.col("bad") + joint).alias("bad")).groupBy("block").agg(F.sum("bad").alias("breaks"), (F.sum("bad") == 0).alias("is_sorted"))


def coverage_bins(reads: DataFrame, size: int, strict: bool = False) -> DataFrame:
    """Bases of each bin: a read covers [pos, pos + read_len], its query length and one more base.

    A read is exploded to its bins, not to its bases.  ``strict`` takes the reference span without the extra base.
    """
    last = F.col("pos") + ((C.reference_length() - 1) if strict else F.col("read_len"))
    placed = reads.filter((F.col("ref_id") != -1) & (F.col("pos") != -1)).select("ref_id", "pos", last.alias("last"))
    each = placed.withColumn("bin", F.explode(F.sequence(F.floor(F.col("pos") / size).cast("int"), F.floor(F.col("last") / size).cast("int"))))
    bases = F.least("last", F.col("bin") * size + size - 1) - F.greatest("pos", F.col("bin") * size) + 1
    return each.groupBy("ref_id", "bin").agg(F.sum(bases).cast("long").alias("coverage"))


def zero_filled(bins: DataFrame, sequences: DataFrame, size: int, chunk: int = 1 << 16) -> DataFrame:
    """Every bin of every sequence, made ``chunk`` bins at a time."""
    last = (F.ceil(F.col("length") / size) - 1).cast("int")
    chunks = sequences.select("ref_id", "ref_name", last.alias("last")).filter("last >= 0").select("ref_id", "ref_name", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(chunk))).alias("from"))
    every = chunks.select("ref_id", "ref_name", F.explode(F.sequence("from", F.least(F.col("last"), F.col("from") + chunk - 1))).alias("bin"))
    return every.join(bins, ["ref_id", "bin"], "left").select("ref_name", (F.col("bin") * size + 1).alias("position"), F.coalesce("coverage", F.lit(0).cast("long")).alias("coverage"))


def mean_coverage(bins: DataFrame, sequences: DataFrame) -> DataFrame:
    total = bins.groupBy("ref_id").agg(F.sum("coverage").alias("bases"))
    return sequences.join(total, "ref_id", "left").select("ref_name", F.round(F.coalesce("bases", F.lit(0)) / F.col("length"), 6).alias("mean_coverage"))


def _truth(strict: bool) -> Column:
    part = F.split("name", "_")
    near = lambda k: F.coalesce(F.abs(F.get(part, F.lit(k)).try_cast("int") - F.col("pos")) <= 5, F.lit(False))
    return (F.get(part, F.lit(0)) == F.col("ref_name")) & (near(1) if strict else near(1) | near(2))


def mapping_truth(reads: DataFrame, sequences: DataFrame, strict: bool = False) -> DataFrame:
    """Reads named chr_n1_n2_... against where they are mapped, within five bases; ``strict`` looks at n1 alone."""
    known = reads.filter((F.col("ref_id") != -1) & (F.col("pos") != -1)).join(sequences, "ref_id")
    return known.groupBy("ref_name").agg(F.count("*").alias("reads"), F.count_if(_truth(strict)).alias("correct"))


def correctly_mapped(reads: DataFrame, sequences: DataFrame, strict: bool = False) -> DataFrame:
    """The reads that :func:`mapping_truth` counts as correct."""
    return reads.join(sequences.select("ref_id", "ref_name"), "ref_id").filter(_truth(strict)).select(*reads.columns)


COMPARED = ["ref_id", "pos", "cigar"]


def compared(reads: DataFrame, region: tuple[int, int, int] | None = None) -> DataFrame:
    """Rows that compare looks at: placed reads, or those that start in the region."""
    if region is None:
        return reads.filter("ref_id >= 0 AND pos >= 0").select(*COMPARED)
    ref, a, b = region
    return reads.filter((F.col("ref_id") == ref) & F.col("pos").between(a, b)).select(*COMPARED)


def compare(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Multisets of what b adds, what it lacks, and what both have."""
    return {"added": b.exceptAll(a), "removed": a.exceptAll(b), "common": a.intersectAll(b)}


def compare_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of how many rows b adds, lacks and shares, by one grouping."""
    both = a.select(*COMPARED, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*COMPARED, F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy(*COMPARED).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(n(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("added"), n(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("removed"), n(F.least("x", "y")).alias("common"))


def same_dictionary(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both dictionaries (ref_id, ref_name, length) are the same."""
    columns = ["ref_id", "ref_name", "length"]
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).unionByName(y.exceptAll(x)).agg((F.count("*") == 0).alias("same"))


def compare_regions(a: DataFrame, b: DataFrame, regions: DataFrame) -> DataFrame:
    """added and removed in each region (closed, ref_id, start, stop), by one grouped count instead of a set operation each."""
    both = a.select(*COMPARED, F.lit(1).alias("d")).unionByName(b.select(*COMPARED, F.lit(-1).alias("d")))
    diff = both.groupBy(*COMPARED).agg(F.sum("d").alias("d")).filter("d != 0")
    at = (F.col("pos"), F.col("pos"))
    inside = ranges.range_join(diff, regions.withColumn("interval_id", F.lit(0)), span=at).select("ref_id", "start", "stop", "d")
    return inside.groupBy("ref_id", "start", "stop").agg(F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("d"), F.lit(0))).alias("removed"))


def index_metadata(reads: DataFrame) -> DataFrame:
    return reads.groupBy("ref_id").agg(F.count_if(~C.has("unmapped")).alias("mapped"), F.count_if(C.has("unmapped")).alias("unmapped"))


def linear_index(reads: DataFrame, offset: Column, bits: int = 14) -> DataFrame:
    """Least offset of the reads over each window of 2^bits bases."""
    placed = reads.filter("ref_id >= 0").select("ref_id", F.explode(F.sequence(F.shiftright("pos", bits), F.shiftright(C.end_position() - 1, bits))).alias("window"), offset.alias("offset"))
    return placed.groupBy("ref_id", "window").agg(F.min("offset").alias("offset"))
