"""Commands over files: what they print and write."""

import io
import sys

import pytest

from strandspark import commands
from strandspark.sources import bam, files, sam

# pairs on two sequences: one pair is a duplicate of another, one read stands alone, one has no place
ROWS = [
    ("a", 99, "c1", 11, 60, "10M", "=", 51, 50), ("b", 99, "c1", 11, 50, "10M", "=", 51, 50), ("c", 0, "c1", 31, 20, "4M2D6M", "*", 0, 0), ("a", 147, "c1", 51, 60, "10M", "=", 11, -50),
    ("b", 147, "c1", 51, 50, "10M", "=", 11, -50), ("d", 16, "c2", 5, 9, "3S7M", "*", 0, 0), ("e", 4, "*", 0, 0, "*", "*", 0, 0),
]
HEADER = "@HD\tVN:1.4\tSO:unsorted\n@SQ\tSN:c1\tLN:300\n@SQ\tSN:c2\tLN:100\n@RG\tID:g\tLB:lib\n@PG\tID:first\tCL:first -x\n@PG\tID:second\n"


def lines(rows=ROWS):
    out = []
    for n, f, r, p, q, c, m, mp, i in rows:
        qual = "5" * 10 if n == "b" else "I" * 10
        out.append("\t".join(map(str, (n, f, r, p, q, c, m, mp, i, "ACGTACGTAC", qual, "RG:Z:g"))))
    return out


@pytest.fixture
def path(tmp_path):
    (tmp_path / "in.sam").write_text(HEADER + "".join(x + "\n" for x in lines()))
    return str(tmp_path / "in.sam")


def go(spark, *arguments):
    return list(commands.run(list(map(str, arguments)), spark))


def body(out):
    return [x for x in out if not x.startswith("@")]


def test_view(spark, path, tmp_path):
    assert body(go(spark, "view", path)) == lines()
    head = [x for x in go(spark, "view", path) if x.startswith("@PG")]
    assert len(head) == 3 and "VN:" in head[-1] and len([x for x in go(spark, "view", path, "--nopg") if x.startswith("@PG")]) == 2
    assert body(go(spark, "view", path, "-q", 50)) == [x for x, r in zip(lines(), ROWS, strict=True) if r[4] >= 50]
    assert body(go(spark, "view", path, "-r", "c1:45..60", "-n", 1)) == [lines()[3]]
    assert go(spark, "view", path, "-F", "fastq", "-B", 2, "-E", 3, "-n", 1) == ["@a\nGTACG\n+a\nIIIII"]
    with pytest.raises(ValueError, match="FASTQ only"):
        go(spark, "view", path, "-B", 2)
    for kind in ("bam", "rawbam", "sam"):
        target = str(tmp_path / f"out.{kind}")
        assert go(spark, "view", path, "-o", target) == []
        if kind == "sam":
            assert sam.read_sam(spark, [f"{target}/header", f"{target}/reads"])[0].count() == 7
        else:
            bam.join_parts(target, f"{target}.whole")
            assert body(go(spark, "view", f"{target}.whole")) == lines()
    with pytest.raises(ValueError, match="cannot write cram"):
        go(spark, "view", path, "-o", str(tmp_path / "x.cram"))
    assert [files.format_of(x) for x in ("a.BAM", "a.bamraw", "x.rawbam", "q.fastq", "y")] == ["bam", "rawbam", "rawbam", "fastq", None]


def test_count_stdin_and_many_files(spark, path, monkeypatch):
    assert go(spark, "count", path) == ["7"] and go(spark, "count", path, path, "-i", path) == ["21"]
    with open(path, "rb") as f:
        monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(f.read())))
    assert go(spark, "count") == ["7"]
    both = body(go(spark, "view", path, path))
    assert len(both) == 14 and [x.split("\t")[3] for x in both] == sorted([x.split("\t")[3] for x in both if x.split("\t")[2] == "c1"], key=int) + ["5", "5", "0", "0"]


def test_stats(spark, path):
    out = go(spark, "stats", path, "-I", "-L")
    assert out[:3] == ["Total reads:                7", "Mapped reads:               6 ( 85.7%)", "Forward strand:             4 ( 57.1%)"]
    assert "Both pairs mapped:          4 (100.0%)" in out and "Read 1:                     2" in out and "Sorted:                   Yes" in out
    assert out[-5:] == ["Read lengths:", "    10bp:                   7 (100.0%)", "Insert size (absolute value):", "    Mean:                50.0", "    Median:              50.0"]


def test_coverage(spark, path, tmp_path):
    out = go(spark, "coverage", path, "-b", 100, "--omituncoveredbases")
    assert out[:2] == ["Average coverage:", "                     c1: 0.183333x"] and out[3:] == ["c1\t1\t55", "c2\t1\t11"]
    assert len(go(spark, "coverage", path)) == 3 + 3 + 1
    go(spark, "coverage", path, "-V", "-o", tmp_path / "c")
    text = lambda part: "".join(p.read_text() for p in sorted((tmp_path / "c" / part).glob("part-*")))
    assert text("header") == "chromosome\tposition\tcoverage\tcorrect_maps\n" and text("rows").splitlines()[0] == "c1\t1\t55\t0"


def test_compare(spark, path, tmp_path):
    other = tmp_path / "other.sam"
    other.write_text(HEADER + "".join(x + "\n" for x in [*lines()[1:], lines()[2].replace("4M2D6M", "10M")]))
    assert go(spark, "compare", path, path) == []
    assert go(spark, "compare", path, other) == ["\t       1 added\t       1 removed"]
    assert go(spark, "compare", path, other, "-p", "-r", "c1:25..40", "-r", "c2") == ["Add: c1:30 10M", "c1:25..40\t       1 added\t       0 removed"]
    assert go(spark, "compare", path, path, other)[0] == f"{path}:"


def test_dedup_and_mergesort(spark, path):
    marked = {tuple(x.split("\t")[:2]) for x in body(go(spark, "dedup", path, "-F", "sam"))}
    assert {n for n, f in marked if int(f) & 1024} == {"b"} and len(marked) == 7
    assert [x.split("\t")[0] for x in body(go(spark, "dedup", path, "-r", "-F", "sam"))] == ["a", "c", "a", "d", "e"]
    out = go(spark, "mergesort", path, path, "-q", 20, "-F", "sam", "-n", 3, "--nosplit", "-d")
    assert out[0] == "@HD\tVN:1.4\tSO:coordinate" and [x.split("\t")[0] for x in body(out)] == ["a", "a", "b", "b", "c", "c", "a", "a", "b", "b"]
    by_name = body(go(spark, "mergesort", path, "-b", "-F", "sam"))
    assert [x.split("\t")[0] for x in by_name] == ["a", "a", "b", "b", "c", "d", "e"]
    assert len(body(go(spark, "mergesort", path, "-R", "-F", "sam"))) == 5


def test_history_version_help(spark, path):
    assert go(spark, "history", path) == ["first -x", "second"]
    assert go(spark, "version")[0].startswith("strandspark") and any("mergesort" in x for x in go(spark, "help"))
    with pytest.raises(SystemExit):
        go(spark, "nothing")


def test_localrealign_and_repeatseq(spark, tmp_path):
    import numpy as np

    genome = "".join(np.random.default_rng(5).choice(list("ACGT"), 600))
    gone = genome[:300] + genome[304:]
    rows = [("one", 0, "c", 271, 60, "30M4D30M", "*", 0, 0, gone[270:330], "I" * 60, "NM:i:4")]
    rows += [(f"r{k}", 0, "c", 251 + k, 60, "60M", "*", 0, 0, gone[250 + k : 310 + k], "I" * 60, "NM:i:9") for k in range(1, 6)]
    rows.sort(key=lambda r: r[3])
    (tmp_path / "in.sam").write_text("@HD\tVN:1.4\tSO:coordinate\n@SQ\tSN:c\tLN:600\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    (tmp_path / "g.fa").write_text(">c\n" + "\n".join(genome[i : i + 60] for i in range(0, 600, 60)) + "\n")
    (tmp_path / "iv").write_text("c:290-320\n")
    out = body(go(spark, "localrealign", tmp_path / "in.sam", "-R", tmp_path / "g.fa", "-L", tmp_path / "iv", "-F", "sam"))
    assert len(out) == 6 and all("4D" in x.split("\t")[5] and "NM:i:4" in x for x in out)
    (tmp_path / "regions").write_text("c:301-306\t1_6_1_100_x_A\nc:100-101\tnone\n")
    said = go(spark, "repeatseq", tmp_path / "in.sam", "-R", tmp_path / "g.fa", "-L", tmp_path / "regions", "--calls", "--repeatseq", "--outfile", tmp_path / "q", "--tag", ".t")
    assert said == ["improper second column found for c:100-101"]
    assert "".join(p.read_text() for p in (tmp_path / "q.t.calls").glob("part-*")).startswith("c:301-306\t1_6_1_100_x_A\t")


def test_execute(spark, tmp_path):
    (tmp_path / "in").write_text("hi")
    (tmp_path / "s").write_text('up = { exec "tr a-z A-Z < $input > $output" }\nrun { up }')
    assert go(spark, "execute", tmp_path / "s", tmp_path / "in", "--print") == [f"up(Exec(tr a-z A-Z < {tmp_path}/in > {tmp_path}/in.up))"]
    assert go(spark, "execute", tmp_path / "s", tmp_path / "in", "--test") == [] and not (tmp_path / "in.up").exists()
    assert go(spark, "execute", tmp_path / "s", tmp_path / "in") == [] and (tmp_path / "in.up").read_text() == "HI"
    (tmp_path / "bad").write_text("x = { exec 'exit 1' }\nrun { x }")
    with pytest.raises(ValueError, match="failed"):
        go(spark, "execute", tmp_path / "bad")


def test_fastq_files(spark, path, tmp_path):
    go(spark, "view", path, "-o", tmp_path / "q.fastq")
    text = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    record = lambda n, seq, qual: f"@{n}\n{seq}\n+{n}\n{qual}\n"
    assert text("q_1.fastq") == record("a/1", "ACGTACGTAC", "I" * 10) + record("b/1", "ACGTACGTAC", "5" * 10)
    assert text("q_2.fastq") == record("a/2", "GTACGTACGT", "I" * 10) + record("b/2", "GTACGTACGT", "5" * 10)
    assert text("q.fastq") == "".join(record(n, "ACGTACGTAC", "I" * 10) for n in "cde")
    go(spark, "view", path, "-o", tmp_path / "t.fastq", "-B", 2, "-E", 3, "-q", 60)
    assert text("t_1.fastq") == record("a/1", "GTACG", "IIIII") and text("t_2.fastq") == record("a/2", "CGTAC", "IIIII")
