"""Measures of reads against the reference, row by row in Arrow batches: no group, no shuffle beyond the join with the reference."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import columns as C

#: What :func:`measured` adds: left-aligned CIGAR, NM and UQ, mismatch sums without gaps at the read's own place, and the best place.
ADDED = "left_aligned string, nm int, uq int, mismatch_quality int, best_pos int, best_quality int"
_KINDS = {c.split()[0]: c.split()[1] for c in ADDED.split(", ")}
_TYPES = {"string": pa.string(), "int": pa.int32()}


class _Batch:
    """Reads of a batch with the stretches of reference around them, as bytes one after another."""

    def __init__(self, batch) -> None:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        texts = column("cigar").to_pylist()
        known = {x: A.parse_cigar(x) for x in set(texts)}
        self.cigars = [known[x] for x in texts]
        self.seq, self.qual, self.bases = (column(c).to_pylist() for c in ("seq", "qual", "_bases"))
        self.bases = [(x or "").upper() for x in self.bases]
        self.start = np.array([x or 0 for x in column("_start").to_pylist()], np.int64)
        self.at = np.array(column("pos").to_pylist(), np.int64) - self.start
        self.sizes = np.array([len(x) for x in self.bases], np.int64)
        self.of_bases, self.of_seq, self.of_qual = (np.cumsum([0, *map(len, x)])[:-1].astype(np.int64) for x in (self.bases, self.seq, self.qual))
        self.reference, self.text = A.codes("".join(self.bases)), A.codes("".join(self.seq))
        self.scores = A.phred("".join(self.qual))
        self.text_sizes, self.score_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.seq, self.qual))

    def places(self, letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each base under the CIGAR operations ``letters``: read, place in the read, place on its reference, place among those."""
        rows, q0, r0, size, k0 = [], [], [], [], []
        for i, cigar in enumerate(self.cigars):
            q = r = k = 0
            for n, op in cigar:
                if op in letters:
                    rows.append(i)
                    q0.append(q)
                    r0.append(r)
                    size.append(n)
                    k0.append(k)
                    k += n
                if op in "MIS=X":
                    q += n
                if op in "MDN=X":
                    r += n
        n = np.array(size, np.int64)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        spread = lambda x: np.repeat(np.array(x, np.int64), n)
        row = spread(rows)
        return row, spread(q0) + within, self.at[row] + spread(r0) + within, spread(k0) + within

    def added(self, row: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(row, values, len(self.cigars)).astype(np.int64)  # whole numbers below 2^53


def _edits(b: _Batch) -> dict[str, list]:
    """NM and UQ: :func:`alignment.aligned_mismatches` of each read."""
    row, q, r, _ = b.places("M=X")
    ok = (r >= 0) & (r < b.sizes[row]) & (q < b.text_sizes[row])
    row, q, r = row[ok], q[ok], r[ok]
    text = b.text[b.of_seq[row] + q]
    text = np.where((text >= 97) & (text <= 122), text - 32, text)
    differ = text != b.reference[b.of_bases[row] + r]
    row, q = row[differ], q[differ]
    scored = b.score_sizes[row] >= b.text_sizes[row]
    gaps = np.array([sum(n for n, op in c if op in "ID") for c in b.cigars], np.int64)
    return {"nm": b.added(row, np.ones(len(row))) + gaps, "uq": b.added(row[scored], b.scores[b.of_qual[row[scored]] + q[scored]])}


def _sums(b: _Batch, row: np.ndarray, text: np.ndarray, scores: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
    """:func:`alignment.mismatch_quality` of each read from its place ``at`` on."""
    place = at[row] + k
    inside = place < b.sizes[row]
    ref = b.reference[np.where(inside, b.of_bases[row] + place, 0)] if len(b.reference) else np.zeros(len(row), np.uint8)
    differ = (text != ref) & A.REGULAR[text] & A.REGULAR[ref]
    return b.added(row, np.where(inside, np.where(differ, scores, 0), A.BEYOND))


def _offsets(b: _Batch, around: int, best: bool) -> dict[str, list]:
    """Mismatch sum of each read without gaps, and (``best``) its best place within ``around``."""
    row, q, _, k = b.places("MI=X")
    ok = (q < b.text_sizes[row]) & (b.score_sizes[row] >= b.text_sizes[row])
    row, q, k = row[ok], q[ok], k[ok]
    text, scores = b.text[b.of_seq[row] + q], b.scores[b.of_qual[row] + q]
    own = _sums(b, row, text, scores, k, b.at)
    if not best:
        return {"mismatch_quality": own}
    size = np.bincount(row, minlength=len(b.cigars))
    low, high = np.maximum(0, b.at - around), np.minimum(b.sizes, b.at + size + around)
    last = np.maximum(b.at - 1, high - size)  # the last place that is looked at
    least, where = np.full(len(own), np.iinfo(np.int64).max), b.at.copy()
    for step in range(-around, around + 1):
        at = b.at + step
        use = (at >= low) & (at <= last)
        if not use.any():
            continue
        pick = use[row]
        sums = _sums(b, row[pick], text[pick], scores[pick], k[pick], at)
        better = use & (sums < least)
        least, where = np.where(better, sums, least), np.where(better, at, where)
    better = least < own
    return {"mismatch_quality": own, "best_pos": np.where(better, where, b.at) + b.start, "best_quality": np.where(better, least, own)}


def _left(b: _Batch) -> dict[str, list]:
    out = []
    for cigar, seq, qual, reference, at in zip(b.cigars, b.seq, b.qual, b.bases, b.at.tolist(), strict=True):
        if sum(op in "ID" for _, op in cigar) == 1:
            bases = A.unclipped_bases(seq, qual, cigar)[0]
            cigar = A.reclip(A.left_align(A.unclip(cigar), reference, bases, at), cigar)
        out.append(A.format_cigar(cigar))
    return {"left_aligned": out}


def _measure(batches, names: list[str], around: int, what: list[str]):
    """Only what is asked for is measured, and a batch of reads at once."""
    for batch in batches:
        found = {}
        if batch.num_rows:
            b = _Batch(batch)
            if "left_aligned" in what:
                found |= _left(b)
            if {"nm", "uq"} & set(what):
                found |= _edits(b)
            if {"mismatch_quality", "best_pos", "best_quality"} & set(what):
                found |= _offsets(b, around, bool({"best_pos", "best_quality"} & set(what)))
        own = [batch.column(batch.schema.get_field_index(n)) for n in names]
        yield pa.RecordBatch.from_arrays(own + [pa.array(found.get(c, []), _TYPES[_KINDS[c]]) for c in what], names=names + what)


def measured(reads: DataFrame, reference: DataFrame, keep: list[str], around: int = 2, chunk: int = 1 << 16, what: list[str] | None = None) -> DataFrame:
    """``keep`` columns of placed reads and ADDED, or those of ADDED that ``what`` names.  ``reference``: (ref_id, start, bases) in chunks of ``chunk`` bases.

    A read meets the chunk it begins in, to which the next one's first bases are joined, as many as the longest read needs.
    ``around`` is how far from its place a read's best place is looked for.
    """
    what = list(_KINDS) if what is None else what
    more = 1 << 13
    at = F.floor(F.col("start") / chunk)
    part = lambda near, bases: F.struct((at - near).alias("_chunk"), F.lit(near).alias("near"), bases.alias("bases"), F.when(F.lit(near == 0), F.col("start")).alias("_from"))
    parts = reference.select("ref_id", F.explode(F.array(part(0, F.col("bases")), part(1, F.substring("bases", 1, more)), part(-1, F.right("bases", F.lit(64))))).alias("p")).select("ref_id", "p.*")
    # grouped, not joined with itself: the planner takes a join's size for the product of its sides', and would shuffle all reads to five keys
    one = lambda near: F.coalesce(F.max(F.when(F.col("near") == near, F.col("bases"))), F.lit(""))
    joined = parts.groupBy("ref_id", "_chunk").agg(F.max("_from").alias("_from"), one(-1).alias("_before"), one(0).alias("bases"), one(1).alias("_next")).filter("_from is not null")
    full = joined.select("ref_id", "_chunk", (F.col("_from") - F.length("_before")).alias("_text_from"), F.concat("_before", "bases", "_next").alias("_text"))
    met = reads.filter("ref_id >= 0").withColumn("_chunk", F.floor(F.col("pos") / chunk)).join(full, ["ref_id", "_chunk"])
    # only the stretch around the read goes to Python
    span = F.greatest(C.reference_length(), F.col("read_len"))
    first = F.greatest(F.col("pos") - around - 64, F.col("_text_from"))
    part = F.substring("_text", first - F.col("_text_from") + 1, F.col("pos") - first + span + around + 64)
    needed = list(dict.fromkeys([*keep, "pos", "cigar", "seq", "qual"]))
    rows = met.select(*needed, first.cast("int").alias("_start"), part.alias("_bases"))
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep]) + "".join(f", {c} {_KINDS[c]}" for c in what)
    return rows.mapInArrow(lambda batches: _measure(batches, keep, around, what), schema)
