import random
import zlib

import pytest

from strandspark.functions import alignment as A
from strandspark.sources import bai, bam, sam

HEAD = "@HD\tVN:1.4\tSO:coordinate\n@SQ\tSN:c1\tLN:2000000\n@SQ\tSN:c2\tLN:500\n@SQ\tSN:c3\tLN:90000\n"


def overlapping_bins(begin, end):
    """All bins that a stretch may have records in, by the definition of their levels."""
    out = {0}
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out |= set(range(first + (begin >> shift), first + ((end - 1) >> shift) + 1))
    return out


def test_index_finds_every_record(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for ref, size in (("c1", 1_999_000), ("c3", 80_000)):
        for p in sorted(rng.randint(1, size) for _ in range(1500)):
            cigar = rng.choice(["20M", "10M5000N10M", "3S17M", "5M2D15M", "9M1I10M"])
            rows.append((ref, p, cigar, rng.choice([0, 16, 4])))
    lines = [f"r{i}\t{f}\t{c}\t{p}\t60\t{g}\t*\t0\t0\t{'ACGTACGTAC' * 2}\t{'I' * 20}" for i, (c, p, g, f) in enumerate(rows)]
    lines += [f"u{i}\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII" for i in range(7)]
    (tmp_path / "a.sam").write_text(HEAD + "\n".join(lines) + "\n")
    reads, head = sam.read_sam(spark, str(tmp_path / "a.sam"))
    bam.write_bam(reads.repartitionByRange(2, "idx").sortWithinPartitions("idx"), head, str(tmp_path / "parts"))
    path = str(tmp_path / "a.bam")
    bam.join_parts(str(tmp_path / "parts"), path)
    whole = bai.record_offsets(spark, path).orderBy("begin").collect()
    assert len(whole) == len(lines) and [r.finish for r in whole[:-1]] == [r.begin for r in whole[1:]]
    for size in (700, 20_000):
        assert bai.record_offsets(spark, path, size).orderBy("begin").collect() == whole
    # every offset points at the record it says
    data = (tmp_path / "a.bam").read_bytes()
    for r, line in list(zip(whole, lines, strict=True))[:: 100]:
        block = zlib.decompressobj(31).decompress(data[r.begin >> 16 :])
        assert line.split("\t")[0].encode() in block[(r.begin & 0xFFFF) + 36 :][:10]
    bai.write_index(spark, path, range_bytes=5000)
    references, without = bai.read_index(path + ".bai")
    assert without == 7 and len(references) == 3 and references[1] == ({}, [])
    for k, name in ((0, "c1"), (2, "c3")):
        by_bin, line = references[k]
        own = [(r, x) for r, x in zip(whole, rows, strict=False) if x[0] == name]
        assert by_bin[bai.OWN_BIN] == [(own[0][0].begin, own[-1][0].finish), (sum(x[3] != 4 for _, x in own), sum(x[3] == 4 for _, x in own))]
        spans = [(r, p - 1, p - 1 + sum(n for n, op in A.parse_cigar(g) if op in "MDN")) for r, (_, p, g, _) in own]
        for _ in range(200):
            begin = rng.randint(0, 1_999_000 if k == 0 else 80_000)
            end = begin + rng.choice([1, 50, 20_000])
            chunks = [c for b in overlapping_bins(begin, end) if b in by_bin for c in by_bin[b]]
            least = line[begin >> 14] if begin >> 14 < len(line) else 1 << 62
            for r, a, b in spans:
                if a < end and begin < b:
                    assert r.begin >= least and any(x <= r.begin < y for x, y in chunks)
    with pytest.raises(ValueError, match="no blocks"):
        bai.write_index(spark, str(tmp_path / "a.sam"))
