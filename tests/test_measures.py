"""Measures of a batch of reads against the plain definitions, read by read."""

import numpy as np
import pyarrow as pa

from strandspark.functions import alignment as A
from strandspark.operators import measures
from strandspark.plans import catalog


def test_a_batch_is_measured_as_its_reads():
    rng, rows = np.random.default_rng(4), []
    text = lambda n, letters="ACGTNacg": "".join(rng.choice(list(letters), n))
    for k in range(400):
        a, b, c = (int(x) for x in rng.integers(1, 9, 3))
        cigar, size = [(f"{a}M", a), (f"{a}S{b}M", a + b), (f"{a}M{b}D{c}M", a + c), (f"{a}M{b}I{c}M2S", a + b + c + 2), (f"2H{a}=1X{b}N{c}M", a + 1 + c), ("*", 4), (f"{a}I{b}M", a + b)][k % 7]
        start, lead = int(rng.integers(0, 50)), int(rng.integers(0, 7))
        rows.append((k, start + lead, cigar, text(size, "ACGTN"), text(size, "#%5I"), start, text(int(rng.integers(lead, lead + 30)), "AACG" if k % 2 else "ACGTN") or None))
    batch = pa.RecordBatch.from_pylist([dict(zip(("k", "pos", "cigar", "seq", "qual", "_start", "_bases"), r, strict=True)) for r in rows])
    names = [c.split()[0] for c in measures.ADDED.split(", ")]
    for around in (0, 1, 2, 5):
        want = []
        for _, pos, cigar, seq, qual, start, bases in rows:
            cigar, reference, at = A.parse_cigar(cigar), (bases or "").upper(), pos - start
            own, scores = A.unclipped_bases(seq, qual, cigar)
            codes, ref = A.codes(own), A.codes(reference)
            low, high = max(0, at - around), min(len(reference), at + len(own) + around)
            best = A.best_offset(codes, scores, ref[low:high], at - low, len(own))
            left = A.reclip(A.left_align(A.unclip(cigar), reference, own, at), cigar)
            want.append((A.format_cigar(left), A.edit_distance(seq, qual, cigar, reference, at), A.aligned_mismatches(seq, qual, cigar, reference, at)[1], A.mismatch_quality(codes, scores, ref, at), best[0] + low + start, best[1]))
        for what in (names, ["nm", "uq"], ["best_pos", "best_quality"], ["mismatch_quality"], ["left_aligned"]):
            for part in (batch, batch.slice(0, 0), batch.slice(7, 1)):
                (got,) = measures._measure([part], ["k"], around, what)
                assert got.schema.names == ["k", *what]
                for row in got.to_pylist():
                    assert [row[c] for c in what] == [want[row["k"]][names.index(c)] for c in what], (rows[row["k"]], around)


def test_reads_are_not_shuffled_to_a_small_reference(spark, capsys):
    catalog.QUERIES["q_nm_uq"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
