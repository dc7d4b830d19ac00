"""Scan-level operators: filters, limit, trim, sorting, merging, FASTQ lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C


def filter_reads(reads: DataFrame, region: tuple[int, int, int] | None = None, mapq: int | None = None, length: str | None = None, trim: tuple[int, int] = (0, 0)) -> DataFrame:
    """Region overlap by query length on 0-based positions, least mapping quality, length spec; then trims both ends."""
    if region:
        ref, a, b = region
        reads = reads.filter((F.col("ref_id") == ref) & (F.col("pos") + F.col("read_len") >= a) & (F.col("pos") <= b))
    if mapq is not None:
        reads = reads.filter(F.col("mapq") >= mapq)
    if length:
        reads = reads.filter(F.col("read_len").between(*C.parse_length(length)))
    begin, end = trim
    if begin or end:
        reads = reads.filter(F.col("read_len") > begin + end)
        cut = lambda c: F.substring(c, F.lit(begin + 1), F.col("read_len") - begin - end)
        reads = reads.withColumns({"seq": cut("seq"), "qual": cut("qual")}).withColumn("read_len", F.col("read_len") - begin - end)
    return reads


def limit_reads(reads: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n in input order: a top-k, not a full sort."""
    return reads.orderBy(*order).limit(n)


def position_order(rest: Sequence[str] = ()) -> list[Column]:
    """Placed reads first, by reference, position, forward before reverse, name and flag."""
    return [(F.col("ref_id") == -1).asc(), F.col("ref_id").asc(), F.col("pos").asc(), C.has("reverse").asc(), F.col("name").asc(), F.col("flag").asc(), *map(F.col, rest)]


def sort_reads(reads: DataFrame, by: str = "position", rest: Sequence[str] = ()) -> DataFrame:
    """A range shuffle with spilling; ``by``: position, name, or a column (nulls last)."""
    if by == "position":
        return reads.orderBy(*position_order(rest))
    return reads.orderBy(F.col(by).asc_nulls_last(), *rest)


def merge(*inputs: DataFrame) -> DataFrame:
    out = inputs[0]
    for other in inputs[1:]:
        out = out.unionByName(other)
    return out


def chain(n: int) -> Column:
    """Chain of a read when reads are split by reference."""
    return F.when(F.col("ref_id") < 0, 0).otherwise(F.col("ref_id") % n).cast("int")


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+"), "name", F.lit("\n"), "qual").alias("record"))


def toggle_pairs(reads: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds pair and mate (0 or 1): reads of a key pair up as they come, the third begins a new pair."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1
    return reads.withColumn("pair", F.floor(n / 2).cast("int")).withColumn("mate", (n % 2).cast("int"))


def fastq_split(reads: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs, orphans).  The later read's strand decides which one is /1; the /2 one is turned to the other strand."""
    w = W.partitionBy("name").orderBy(*order)
    own = reads.select("name", *[c for c in order if c != "name"], F.struct("flag", "seq", "qual").alias("a"))
    first = own.select("name", "a", F.lead("a").over(w).alias("b"), F.row_number().over(w).alias("n")).filter("n % 2 = 1")
    swap = C.has("reverse", F.col("b.flag"))
    pick = lambda f, x, y: F.when(swap, F.col(f"{x}.{f}")).otherwise(F.col(f"{y}.{f}"))
    pairs = first.filter("b is not null").select("name", pick("seq", "a", "b").alias("seq1"), pick("qual", "a", "b").alias("qual1"), C.reverse_complement(pick("seq", "b", "a")).alias("seq2"), F.reverse(pick("qual", "b", "a")).alias("qual2"))
    return pairs, first.filter("b is null").select("name", F.col("a.seq").alias("seq"), F.col("a.qual").alias("qual"))


def ranked(rows: DataFrame, group: Sequence[str], stretch: Column, order: Sequence, name: str = "rank") -> DataFrame:
    """Adds each row's number (from 1) in ``order`` within its group.

    ``stretch`` doesn't fall along the order.  Rows are sorted within a stretch of a group, and the counts of the stretches
    before are added: a group of any size is spread over tasks, and only one row a stretch is summed in one place.
    """
    marked = rows.withColumn("_stretch", stretch)
    counts = marked.groupBy(*group, "_stretch").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over((W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy("_stretch")) - F.col("_n")).alias("_before")
    key = [*group, "_stretch"]
    ahead = counts.select(*[F.col(k).alias(f"_of_{k}") for k in key], before)
    same = None
    for k in key:
        equal = F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        same = equal if same is None else same & equal
    here = marked.withColumn("_row", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return here.join(ahead, same).withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_row", "_before", "_stretch", *[f"_of_{k}" for k in key])
