import pytest

from strandspark.functions import columns as C
from strandspark.operators import stats
from strandspark.sources import fasta, header, sam

SAM = """@HD\tVN:1.0\tSO:unsorted
@SQ\tSN:c1\tLN:1000
@SQ\tSN:c2\tLN:500
r1\t99\tc1\t11\t60\t5M1I4M\t=\t101\t95\tACGTACGTAC\tIIIIIIIIII\tNM:i:1\tRG:Z:a b
r1\t147\tc1\t101\t60\t10M\t=\t11\t-95\tACGTACGTAC\tIIIIIIIIII\tNM:i:-300
r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII
"""


def test_sam_round_trip(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    reads, head = sam.read_sam(spark, str(tmp_path / "a.sam"))
    assert "".join(r.value + "\n" for r in sam.sam_lines(reads, head).orderBy("idx").collect()) == SAM.split("LN:500\n")[1]
    assert head.text() == SAM[: SAM.index("r1")]
    rows = reads.orderBy("idx").collect()
    assert (rows[0].pos, rows[0].tags["NM"].type, rows[1].tags["NM"].type, rows[2].ref_id, rows[2].pos) == (10, "C", "s", -1, -1)
    assert stats.flagstat(reads).first().total == 3
    sam.write_sam(reads, head, str(tmp_path / "out"))
    assert sam.read_sam(spark, [str(tmp_path / "out/header"), str(tmp_path / "out/reads")])[0].count() == 3


def test_header_rules():
    h = header.parse_header("@SQ\tSN:x\tLN:5\n@PG\tID:p\n@CO\thello")
    assert h.hd["SO"] == "unknown" and h.lookup == {"x": (0, 5)}
    assert [p["ID"] for p in h.with_program("p", "1", "c").with_program("p", "1", "c").programs] == ["p", "p-2", "p-3"]
    for bad in ("@HD\tVN:1.0", "@SQ\tSN:x", "@XX\ta:b"):
        try:
            header.parse_header(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_region_and_length_specs():
    seqs = {"c": (3, 100)}
    assert C.parse_region("c", seqs) == (3, 0, 100) and C.parse_region("c:7", seqs) == (3, 7, 7) and C.parse_region("c:7..9", seqs) == (3, 7, 9)
    assert [C.parse_length(x) for x in ("64", "64-72", "-64")] == [(64, 64), (64, 72), (0, 64)] and C.parse_length("+64")[0] == 64


GENOME = ">a x\nACGTA\nCG\n>b\nTTTT\n>empty\n>c y z\nAAAAAAA\nCCCCCCC\nGG"


def test_fasta_chunks_and_index(spark, tmp_path):
    path = str(tmp_path / "g.fa")
    (tmp_path / "g.fa").write_text(GENOME)
    want = [("a", 7, 5, 5, 6), ("b", 4, 17, 4, 5), ("empty", 0, 29, 0, 0), ("c", 16, 36, 7, 8)]
    for size in (1, 3, 7, 1000):
        assert fasta.make_index(spark, path, size) == want
    got = {(r.name, r.ref_id, r.start): r.bases for r in fasta.read_fasta(spark, path, chunk=5).collect()}
    assert got == {("a", 0, 0): "ACGTA", ("a", 0, 5): "CG", ("b", 1, 0): "TTTT", ("c", 3, 0): "AAAAA", ("c", 3, 5): "AACCC", ("c", 3, 10): "CCCCG", ("c", 3, 15): "G"}
    fasta.write_index(want, path + ".fai")
    assert fasta.read_index(path + ".fai") == want and {tuple(r) for r in fasta.fasta_index(spark, path).collect()} == set(want)
    head = header.parse_header("@SQ\tSN:b\tLN:4\n@SQ\tSN:c\tLN:16")
    assert {(r.name, r.ref_id) for r in fasta.read_fasta(spark, path, head).collect()} == {("b", 0), ("c", 1)}
    whole = fasta.read_fasta(spark, path).filter("name = 'a'")
    assert whole.select(fasta.subsequence("bases", F_lit(3), F_lit(3)).alias("s")).first().s == "TAC"
    for wrong in ([("a", 7, 6, 5, 6)], [("c", 17, 36, 7, 8)], [("x", 4, 17, 4, 5)]):
        with pytest.raises(ValueError, match="the index is wrong|ends beyond"):
            fasta.check_index(path, wrong)
    (tmp_path / "odd.fa").write_text(">a\nAC\nACGT\nA\n")
    with pytest.raises(ValueError, match="differ in length"):
        fasta.make_index(spark, str(tmp_path / "odd.fa"))
    (tmp_path / "no.fa").write_text("ACGT\n")
    with pytest.raises(ValueError, match="no FASTA"):
        fasta.make_index(spark, str(tmp_path / "no.fa"))


def test_interval_and_region_lists(spark, tmp_path):
    head = header.parse_header("@SQ\tSN:z\tLN:9\n@SQ\tSN:a\tLN:50\n@SQ\tSN:b\tLN:4")
    (tmp_path / "i.txt").write_text("a:2-5\nb:3\na\n\nb:1-2\n")
    got = fasta.read_intervals(spark, str(tmp_path / "i.txt"), head).orderBy("idx").collect()
    assert [(r.ref_name, r.ref_id, r.start, r.stop) for r in got] == [("a", 1, 1, 4), ("b", 2, 2, 2), ("a", 1, 0, 49)]
    (tmp_path / "bad.txt").write_text("q:1-2\n")
    with pytest.raises(Exception, match="unknown sequence q"):
        fasta.read_intervals(spark, str(tmp_path / "bad.txt"), head).collect()
    (tmp_path / "r.txt").write_text("a:2-5\t2_3.0_1_95_x_AC\nb:1-2\tnothing\nb:1-3\nb:1-4\t3_x\n")
    rows = {r.region: r for r in fasta.read_repeat_regions(spark, str(tmp_path / "r.txt")).collect()}
    r = rows["a:2-5"]
    assert (r.start, r.stop, r.unit_length, r.purity, r.unit) == (2, 5, 2, 95.0, "AC") and set(rows) == {"a:2-5", "b:1-4"}
    assert {r.message for r in fasta.skipped_regions(spark, str(tmp_path / "r.txt")).collect()} == {"improper second column found for b:1-2", "improper second column found for b:1-3"}


def test_sam_names_may_begin_with_an_at(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM + "@odd\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    reads, head = sam.read_sam(spark, str(tmp_path / "a.sam"))
    assert reads.filter("name = '@odd'").count() == 1 and reads.count() == 4 and len(head.sequences) == 2
    (tmp_path / "none.sam").write_text("r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    with pytest.raises(ValueError, match="no header"):
        sam.read_sam(spark, str(tmp_path / "none.sam"))
    (tmp_path / "bad.sam").write_text(SAM.replace("\tc2\t", "\tc9\t").replace("c1\t11", "c9\t11"))
    with pytest.raises(Exception, match="unknown reference c9"):
        sam.read_sam(spark, str(tmp_path / "bad.sam"))[0].collect()


def F_lit(n):
    from pyspark.sql import functions as F

    return F.lit(n)
