"""Operators on small tables made for their edges: empty groups, borders of stretches and chunks."""

from pyspark.sql import functions as F

from strandspark.operators import ranges, stats, view


def test_ranks_go_on_across_stretches(spark):
    rows = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate([("a", 5), ("a", 1), (None, 3), ("a", 300), ("b", 7), (None, 2), ("a", 5)])], "g string, v int, i int")
    got = {(r.g, r.v, r.i): r.rank for r in view.ranked(rows, ["g"], F.floor(F.col("v") / 4), ["v", "i"]).collect()}
    assert got == {("a", 1, 1): 1, ("a", 5, 0): 2, ("a", 5, 6): 3, ("a", 300, 3): 4, (None, 2, 5): 1, (None, 3, 2): 2, ("b", 7, 4): 1}
    assert {r.i: r.n for r in view.ranked(rows, [], F.floor(F.col("v") / 100), ["v", "i"], "n").collect()} == {1: 1, 5: 2, 2: 3, 0: 4, 6: 5, 4: 6, 3: 7}
    assert view.ranked(rows.limit(0), ["g"], F.col("v"), ["v"]).count() == 0


def test_order_is_checked_across_stretches(spark):
    def breaks(places):
        reads = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(places)], "idx long, ref_id int, pos int")
        return [stats.out_of_order(reads, ["idx"], F.lit(0), F.floor(F.col("idx") / n)).first() for n in (1, 2, 3, 100)]

    for got in breaks([(0, 1), (0, 5), (-1, 3), (0, 5), (1, 2), (1, -1), (1, 9)]):
        assert (got.breaks, got.is_sorted) == (0, True)
    for got in breaks([(0, 5), (0, 1), (1, 0), (0, 9), (0, 8), (2, 2)]):
        assert (got.breaks, got.is_sorted) == (3, False)


def test_bins_are_filled_in_chunks(spark):
    bins = spark.createDataFrame([(0, 2, 7), (1, 0, 5)], "ref_id int, bin int, coverage long")
    sequences = spark.createDataFrame([(0, "x", 45), (1, "y", 9), (2, "z", 0)], "ref_id int, ref_name string, length int")
    for chunk in (1, 2, 3, 100):
        got = [tuple(r) for r in stats.zero_filled(bins, sequences, 10, chunk).orderBy("ref_name", "position").collect()]
        assert got == [("x", 1, 0), ("x", 11, 0), ("x", 21, 7), ("x", 31, 0), ("x", 41, 0), ("y", 1, 5)]


def test_crowded_intervals_are_left_out(spark):
    assigned = spark.createDataFrame([(i, 7 if i < 3 else 8) for i in range(5)], "idx long, interval_id long")
    assert {r.interval_id: (r.reads, r.skipped) for r in ranges.overloaded(assigned, 3).collect()} == {7: (3, True), 8: (2, False)}
    assert {r.idx for r in ranges.without_overloaded(assigned, 3).collect()} == {3, 4}


def test_reads_span_what_they_cover(spark):
    rows = [(10, 8, "8M", 0), (10, 8, "2H3S5M", 0), (10, 8, "8M", 4), (10, 9, "3M3I3M", 0), (10, 4, "4I", 0), (10, 8, "4M10D4M", 0)]
    reads = spark.createDataFrame(rows, "pos int, read_len int, cigar string, flag int")
    a, b = ranges.read_span()
    assert [(r.a, r.b) for r in reads.select(a.alias("a"), b.alias("b")).collect()] == [(10, 17), (10, 12), (10, 10), (10, 15), (10, 10), (10, 27)]
