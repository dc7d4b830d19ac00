import random

import pytest

from strandspark.sources import bam, header, sam

HEAD = "@HD\tVN:1.0\tSO:unsorted\n@SQ\tSN:c1\tLN:100000\n@SQ\tSN:c2\tLN:500\n@RG\tID:a b\n"


def _sam(n):
    rng = random.Random(5)
    lines = []
    for i in range(n):
        size = rng.choice([0, 1, 10, 75, 300])
        seq = "".join(rng.choice("ACGTN") for _ in range(size)) or "*"
        qual = "".join(chr(rng.randint(33, 73)) for _ in range(size)) or "*"
        tags = rng.sample(["NM:i:300", "AS:i:-7", "RG:Z:a b", "XF:f:0.5", "XA:A:q", "XB:B:s,1,-2,3", "XH:H:1AE3"], rng.randint(0, 7))
        cigar = f"{size}M" if size else "*"
        lines.append("\t".join([f"read{i}", "99", "c1", str(rng.randint(1, 90000)), "60", cigar, "c2", "7", "-95", seq, qual, *tags]))
    return HEAD + "".join(line + "\n" for line in lines)


@pytest.mark.parametrize("raw", [False, True])
def test_round_trip_in_ranges(spark, tmp_path, raw):
    (tmp_path / "a.sam").write_text(_sam(3000))
    reads, head = sam.read_sam(spark, str(tmp_path / "a.sam"))
    out = str(tmp_path / "parts")
    assert bam.write_bam(reads.repartitionByRange(3, "idx").sortWithinPartitions("idx"), head, out, raw) == 3000
    bam.join_parts(out, str(tmp_path / "a.bam"))
    assert bam.sniff(str(tmp_path / "a.bam")) == ("raw" if raw else "bam") and bam.sniff(str(tmp_path / "a.sam")) == "sam"
    want = [r.value for r in sam.sam_lines(reads, head).orderBy("idx").collect()]
    for size in (1 << 26, 50_000, 7_001):  # many ranges begin within blocks and records, some hold no block
        back, again = bam.read_bam(spark, str(tmp_path / "a.bam"), size)
        assert again == head
        assert [r.value for r in sam.sam_lines(back, again).orderBy("idx").collect()] == want
    twice, _ = bam.read_bam(spark, [str(tmp_path / "a.bam")] * 2)
    assert twice.count() == 6000 and twice.select("idx").distinct().count() == 6000


def test_empty_cut_and_foreign_files(spark, tmp_path):
    head = header.parse_header(HEAD)
    (tmp_path / "e.sam").write_text(HEAD)
    reads, _ = sam.read_sam(spark, str(tmp_path / "e.sam"))
    bam.write_bam(reads, head, str(tmp_path / "e"))
    bam.join_parts(str(tmp_path / "e"), str(tmp_path / "e.bam"))
    assert bam.read_bam(spark, str(tmp_path / "e.bam"))[0].count() == 0
    (tmp_path / "x").write_bytes(b"PK")
    with pytest.raises(ValueError):
        bam.sniff(str(tmp_path / "x"))
    (tmp_path / "cut.bam").write_bytes((tmp_path / "e.bam").read_bytes()[:40])
    with pytest.raises(ValueError):
        bam.read_bam(spark, str(tmp_path / "cut.bam"))


def test_bins_and_blocks():
    assert [bam._bin(*x) for x in ((-1, 0), (0, 1), (16383, 16385), (0, 1 << 29))] == [4680, 4681, 585, 0]
    data = random.Random(1).randbytes(200_000)
    blocks = bam.compress(data)
    at, got = 0, b""
    while at < len(blocks):
        size = bam._block_size(blocks, at)
        got += bam.zlib.decompress(blocks[at + 18 : at + size - 8], -15)
        at += size
    assert got == data
