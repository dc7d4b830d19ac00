"""Text of the reports: statistics, coverage tables and comparisons, from one-row or ordered DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Row

from . import stats


def _share(n: int, of: int) -> str:
    return f" ({100 * n / of if of else float('nan'):5.1f}%)"


def stats_lines(counts: Row, is_sorted: bool, lengths: list[Row] | None = None, inserts: Row | None = None) -> list[str]:
    """Lines of the statistics report.  ``lengths``: (read_len, reads) in order; ``inserts``: mean and median."""
    line = lambda title, n, of=None: f"{title + ':':<19}{n:>10}" + ("" if of is None else _share(n, of))
    total, paired = counts["total"], counts["paired"]
    out = [line("Total reads", total)]
    for title, name in (("Mapped reads", "mapped"), ("Forward strand", "forward_strand"), ("Reverse strand", "reverse_strand"), ("Failed QC", "failed_qc"), ("Duplicates", "duplicates"), ("Paired-end reads", "paired")):
        out.append(line(title, counts[name], total))
    if paired:
        out += [line("'Proper-pairs'", counts["proper_pairs"], paired), line("Both pairs mapped", counts["both_mapped"], paired), line("Read 1", counts["first_mate"]), line("Read 2", counts["second_mate"]), line("Singletons", counts["singletons"], paired)]
    out.append(f"{'Sorted:':<19}{'Yes' if is_sorted else 'No':>10}")
    if lengths is not None:
        out.append("Read lengths:")
        out += [f" {r['read_len']:>5}bp:          {r['reads']:>10}" + _share(r["reads"], total) for r in lengths]
    if inserts is not None:
        out.append("Insert size (absolute value):")
        if inserts["mean"] is not None:
            out += [f"    Mean:          {inserts['mean']:>10.1f}", f"    Median:        {inserts['median']:>10.1f}"]
    return out


def stats_report(reads: DataFrame, lengths: bool = False, inserts: bool = False) -> list[str]:
    """The statistics report of reads with ``idx``: three small results come to the driver."""
    counts = stats.flagstat(reads).first()
    order = stats.out_of_order(reads, ["idx"], F.lit(0), F.shiftright(F.col("idx"), 16)).first()
    by_length = stats.length_histogram(reads).orderBy("read_len").collect() if lengths else None  # as many rows as lengths
    return stats_lines(counts, order is None or order["is_sorted"], by_length, stats.insert_sizes(reads).first() if inserts else None)


def coverage_table(reads: DataFrame, sequences: DataFrame, size: int = 100, verify: bool = False, strict: bool = False, zeros: bool = True, span: bool = False) -> DataFrame:
    """(ref_name, position, coverage[, correct_maps]) of all bins, or of those with any coverage."""
    table = stats.zero_filled(stats.coverage_bins(reads, size, span), sequences, size)
    if verify:
        right = stats.correctly_mapped(reads, sequences, strict)
        own = stats.zero_filled(stats.coverage_bins(right, size, span), sequences, size).withColumnRenamed("coverage", "correct_maps")
        table = table.join(own, ["ref_name", "position"])
    return table if zeros else table.filter("coverage > 0")


def coverage_lines(table: DataFrame) -> DataFrame:
    """``value``: the table's rows as tab-separated lines, in the order of names and positions."""
    columns = [c for c in ("ref_name", "position", "coverage", "correct_maps") if c in table.columns]
    return table.orderBy("ref_name", "position").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value"))


def write_coverage(table: DataFrame, path: str) -> None:
    """``path/header`` and ``path/rows``: text files which one after another are the table."""
    title = "chromosome\tposition\tcoverage" + ("\tcorrect_maps" if "correct_maps" in table.columns else "")
    table.sparkSession.createDataFrame([(title,)], "value string").coalesce(1).write.text(f"{path}/header")
    coverage_lines(table).write.text(f"{path}/rows")


def mean_coverage_lines(table: DataFrame) -> list[str]:
    """Lines of mean coverage for each sequence, by name."""
    rows = table.orderBy("ref_name").collect()  # as many rows as sequences
    return ["Average coverage:"] + [f"   {r['ref_name']:>20}: {r['mean_coverage']:>8.6g}x" for r in rows]


def compare_line(name: str, added: int, removed: int, width: int = 0) -> str | None:
    """The line of one region; none where nothing differs."""
    return f"{name:>{width}}\t{added:>8} added\t{removed:>8} removed" if added or removed else None


def change_lines(a: DataFrame, b: DataFrame, names: list[str]) -> Iterator[str]:
    """``Add:`` and ``Del:`` lines of what b adds and lacks, with 0-based places, streamed to the driver."""
    found = stats.compare(a, b)
    for title, kind in (("Add", "added"), ("Del", "removed")):
        for r in found[kind].orderBy(*stats.COMPARED).toLocalIterator():
            yield f"{title}: {names[r['ref_id']] if 0 <= r['ref_id'] < len(names) else '*'}:{r['pos']} {r['cigar']}"
