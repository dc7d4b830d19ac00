"""Column -> Column functions.  Everything stays in the JVM and inside code generation."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the SAM format: flag bits, CIGAR letters, base alphabet.
FLAGS = {
    "paired": 0x1, "proper_pair": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20,
    "first": 0x40, "second": 0x80, "secondary": 0x100, "failed_qc": 0x200, "duplicate": 0x400,
}
CIGAR_OPS = "MIDNSHP=X"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# flags ---------------------------------------------------------------------------------------------------------------


def has(name: str, flag="flag") -> Column:
    return col(flag).bitwiseAND(FLAGS[name]) != 0


def set_flag(name: str, value: Column | bool = True, flag="flag") -> Column:
    on, off = col(flag).bitwiseOR(FLAGS[name]), col(flag).bitwiseAND(~FLAGS[name])
    if isinstance(value, bool):
        return on if value else off
    return F.when(value, on).otherwise(off)


def flag_letters(flag="flag") -> Column:
    """Letters p P u U r R 1 2 s f d for the bits in order (paired, proper, unmapped, mate, reverse, mate, first, second ...)."""
    return F.concat(*[F.when(has(n, flag), F.lit(c)).otherwise(F.lit("")) for n, c in zip(FLAGS, "pPuUrR12sfd", strict=True)])


# CIGAR ---------------------------------------------------------------------------------------------------------------


def cigar_ops(cigar="cigar") -> Column:
    """array<struct<len:int, op:string>>; ``*`` gives an empty array."""
    parts = F.regexp_extract_all(col(cigar), F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def format_cigar(ops: Column) -> Column:
    return F.when(F.size(ops) == 0, F.lit("*")).otherwise(F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), ""))


def cigar_sum(letters: str, ops: Column | None = None) -> Column:
    """Sum of the lengths of the operations in ``letters``."""
    ops = cigar_ops() if ops is None else ops
    return F.aggregate(ops, F.lit(0), lambda s, x: s + F.when(x["op"].isin(*letters), x["len"]).otherwise(0))


def reference_length(ops: Column | None = None) -> Column:
    return cigar_sum("MDN=X", ops)


def read_size(ops: Column | None = None) -> Column:
    return cigar_sum("MIS=X", ops)


def end_position(pos="pos", ops: Column | None = None, padded: bool = False, closed: bool = False) -> Column:
    """Half-open end on the reference; ``padded`` counts insertions, ``closed`` gives the last base."""
    return col(pos) + cigar_sum("MDNX=I" if padded else "MDNX=", ops) - (1 if closed else 0)


def _with_clips(ops: Column | None, finish) -> Column:
    """``finish`` of a struct: length of the S and H operations that the CIGAR begins (lead) and ends with (tail), and on the reference (span).

    One pass over the operations, parsed once.
    """
    start = F.struct(F.lit(0).alias("lead"), F.lit(0).alias("tail"), F.lit(0).alias("span"), F.lit(True).alias("first"))

    def step(s, x):
        clip, n = x["op"].isin("S", "H"), x["len"]
        return F.struct(
            (s["lead"] + F.when(s["first"] & clip, n).otherwise(0)).alias("lead"), F.when(clip, s["tail"] + n).otherwise(0).alias("tail"),
            (s["span"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), n).otherwise(0)).alias("span"), (s["first"] & clip).alias("first"),
        )

    return F.aggregate(cigar_ops() if ops is None else ops, start, step, finish)


def unclipped_start(pos="pos", ops: Column | None = None) -> Column:
    return _with_clips(ops, lambda s: col(pos) - s["lead"])


def unclipped_end(pos="pos", ops: Column | None = None) -> Column:
    return _with_clips(ops, lambda s: col(pos) + s["span"] - 1 + s["tail"])


def five_prime(pos="pos", flag="flag", ops: Column | None = None) -> Column:
    return _with_clips(ops, lambda s: F.when(has("reverse", flag), col(pos) + s["span"] - 1 + s["tail"]).otherwise(col(pos) - s["lead"]))


def alignment_blocks(pos="pos", ops: Column | None = None) -> Column:
    """array<struct<read_start, ref_start, len>> of the M, = and X operations, 0-based."""
    ops = cigar_ops() if ops is None else ops
    block = "array<struct<read_start:int,ref_start:int,len:int>>"
    start = F.struct(F.lit(0).alias("q"), col(pos).cast("int").alias("r"), F.array().cast(block).alias("out"))

    def step(s, x):
        match, n = x["op"].isin("M", "=", "X"), x["len"]
        return F.struct(
            (s["q"] + F.when(x["op"].isin("M", "I", "S", "=", "X"), n).otherwise(0)).alias("q"),
            (s["r"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), n).otherwise(0)).alias("r"),
            F.when(match, F.concat(s["out"], F.array(F.struct(s["q"].alias("read_start"), s["r"].alias("ref_start"), n.alias("len"))))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(ops, start, step, lambda s: s["out"])


def unclip_cigar(ops: Column | None = None) -> Column:
    """The CIGAR text without its S, H and P operations."""
    ops = cigar_ops() if ops is None else ops
    return format_cigar(F.filter(ops, lambda x: ~x["op"].isin("S", "H", "P")))


def reclip_cigar(inner: Column, ops: Column | None = None) -> Column:
    """CIGAR text of the operations ``inner`` between the S, H and P operations that ``ops`` begins and ends with."""
    ops = cigar_ops() if ops is None else ops
    clip = lambda x: x["op"].isin("S", "H", "P")
    lead = F.aggregate(ops, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + (s["go"] & clip(x)).cast("int")).alias("n"), (s["go"] & clip(x)).alias("go")), lambda s: s["n"])
    tail = F.aggregate(F.reverse(ops), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + (s["go"] & clip(x)).cast("int")).alias("n"), (s["go"] & clip(x)).alias("go")), lambda s: s["n"])
    none = lead >= F.size(ops)
    return format_cigar(F.when(none, inner).otherwise(F.concat(F.slice(ops, F.lit(1), lead), inner, F.when(tail > 0, F.slice(ops, F.size(ops) - tail + 1, tail)).otherwise(F.slice(ops, F.lit(1), F.lit(0))))))


# regions and lengths --------------------------------------------------------------------------------------------------


def parse_region(text: str, sequences: dict[str, tuple[int, int]]) -> tuple[int, int, int]:
    """``chr``, ``chr:a`` (one position) or ``chr:a..b`` -> (ref_id, a, b); sequences: name -> (ref_id, length)."""
    m = re.fullmatch(r"([^:]+)(?::(\d+)(?:\.\.(\d+))?)?", text)
    if not m or m[1] not in sequences:
        raise ValueError(f"invalid region {text}")
    ref, length = sequences[m[1]]
    if m[2] is None:
        return ref, 0, length
    a, b = int(m[2]), int(m[3] or m[2])
    if a >= length or b > length:
        raise ValueError(f"region {text} lies beyond its sequence")
    return ref, a, b


def parse_length(spec: str) -> tuple[int, int]:
    """``64``, ``64-72``, ``+64`` (at least) or ``-64`` (at most) -> closed range."""
    if m := re.fullmatch(r"\+(\d+)", spec):
        return int(m[1]), 2**31 - 1
    if m := re.fullmatch(r"-(\d+)", spec):
        return 0, int(m[1])
    if m := re.fullmatch(r"(\d+)(?:-(\d+))?", spec):
        return int(m[1]), int(m[2] or m[1])
    raise ValueError(f"invalid length {spec}")


# bases and qualities --------------------------------------------------------------------------------------------------


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCAtgca"))


def is_regular_base(base) -> Column:
    return col(base).rlike(r"\A[ACGTacgt*]\z")


def bases_equal(a, b) -> Column:
    return F.upper(col(a)) == F.upper(col(b))


def bisulfite_equal(read, ref, reverse) -> Column:
    """Equal bases, or a C read as T (on the reverse strand a G read as A)."""
    r, g = F.upper(col(read)), F.upper(col(ref))
    return (r == g) | F.when(col(reverse), (g == "G") & (r == "A")).otherwise((g == "C") & (r == "T"))


def quality_scores(qual="qual") -> Column:
    return F.transform(F.split(col(qual), ""), lambda c: F.ascii(c) - 33)


def quality_sum(qual="qual", least: int = 15) -> Column:
    """Sum of the Phred scores of at least ``least``."""
    return F.aggregate(F.filter(quality_scores(qual), lambda q: q >= least), F.lit(0), lambda s, q: s + q)


def phred_probability(q) -> Column:
    return 1 - F.pow(F.lit(10.0), -col(q) / 10)


def log_factorial(n) -> Column:
    """ln n!, by Stirling's series beyond a table of small numbers; within 1e-10 of the sum of logarithms."""
    x = col(n).cast("double") + 1
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)]), F.least(col(n).cast("int"), F.lit(15)) + 1)
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(col(n) < 16, small).otherwise(series)


def log_multinomial(*counts) -> Column:
    """ln of (sum of the counts)! over the product of their factorials."""
    total = col(counts[0])
    for c in counts[1:]:
        total = total + col(c)
    out = log_factorial(total)
    for c in counts:
        out = out - log_factorial(c)
    return out


def mean_base_quality(qual="qual") -> Column:
    n = F.length(col(qual))
    return F.aggregate(quality_scores(qual), F.lit(0.0), lambda s, q: s + phred_probability(q)) / n


# bins -----------------------------------------------------------------------------------------------------------------


def ucsc_bin(begin, end) -> Column:
    """Smallest of the five levels of bins that holds [begin, end)."""
    b, e = col(begin), col(end) - 1
    out = F.lit(0)
    for shift in (26, 23, 20, 17, 14):
        first = ((1 << (29 - shift)) - 1) // 7
        out = F.when(F.shiftright(b, shift) == F.shiftright(e, shift), first + F.shiftright(b, shift)).otherwise(out)
    return out.cast("int")


# closed intervals (contig, start, stop) -------------------------------------------------------------------------------


class Interval:
    """A closed interval of three columns."""

    def __init__(self, contig, start, stop) -> None:
        self.contig, self.start, self.stop = col(contig), col(start), col(stop)

    def same_contig(self, o: Interval) -> Column:
        return self.contig == o.contig

    def overlaps(self, o: Interval) -> Column:
        return self.same_contig(o) & (self.start <= o.stop) & (o.start <= self.stop)

    def contiguous(self, o: Interval) -> Column:
        return self.same_contig(o) & (self.start <= o.stop + 1) & (o.start <= self.stop + 1)

    def contains(self, o: Interval) -> Column:
        return self.same_contig(o) & (self.start <= o.start) & (o.stop <= self.stop)

    def before(self, o: Interval) -> Column:
        return (self.contig < o.contig) | (self.same_contig(o) & (self.stop < o.start))

    def past(self, o: Interval) -> Column:
        return (self.contig > o.contig) | (self.same_contig(o) & (self.start > o.stop))

    def between(self, low: Interval, high: Interval) -> Column:
        return ~self.before(low) & ~self.past(high)

    def distance(self, o: Interval) -> Column:
        return F.when(self.same_contig(o), F.abs(self.start - o.start))

    def min_distance(self, o: Interval) -> Column:
        return F.when(self.same_contig(o), F.greatest(F.lit(0), self.start - o.stop, o.start - self.stop))

    def size(self) -> Column:
        return self.stop - self.start + 1

    def overlap_size(self, o: Interval) -> Column:
        return F.when(self.overlaps(o), F.least(self.stop, o.stop) - F.greatest(self.start, o.start) + 1).otherwise(0)

    def reciprocal_overlap(self, o: Interval) -> Column:
        return F.least(self.overlap_size(o) / self.size(), self.overlap_size(o) / o.size())

    def _made(self, start: Column, stop: Column) -> Column:
        return F.struct(self.contig.alias("contig"), start.alias("start"), stop.alias("stop"))

    def merge(self, o: Interval) -> Column:
        """Their union if they touch, else null."""
        return F.when(self.contiguous(o), self.span(o))

    def span(self, o: Interval) -> Column:
        return F.when(self.same_contig(o), self._made(F.least(self.start, o.start), F.greatest(self.stop, o.stop)))

    def intersect(self, o: Interval) -> Column:
        return F.when(self.overlaps(o), self._made(F.greatest(self.start, o.start), F.least(self.stop, o.stop)))

    def subtract(self, o: Interval) -> Column:
        """Array of the up to two pieces of this one outside the other."""
        left = F.when(self.start < o.start, self._made(self.start, F.least(self.stop, o.start - 1)))
        right = F.when(self.stop > o.stop, self._made(F.greatest(self.start, o.stop + 1), self.stop))
        whole = F.array(self._made(self.start, self.stop))
        return F.when(~self.overlaps(o), whole).otherwise(F.array_compact(F.array(left, right)))

    def split(self, at) -> Column:
        """Two pieces, the second beginning at ``at``; one if ``at`` lies outside."""
        p = col(at)
        both = F.array(self._made(self.start, p - 1), self._made(p, self.stop))
        return F.when((p > self.start) & (p <= self.stop), both).otherwise(F.array(self._made(self.start, self.stop)))

    def compare(self, o: Interval) -> Column:
        return F.when(self.overlaps(o), 0).when(self.before(o), -1).otherwise(1)

    def text(self, name) -> Column:
        """``chr:a-b``, 1-based."""
        return F.concat(col(name), F.lit(":"), (self.start + 1).cast("string"), F.lit("-"), (self.stop + 1).cast("string"))


# alleles --------------------------------------------------------------------------------------------------------------


def allele_kind(allele) -> Column:
    a = col(allele)
    return F.when(a.isin("", "-"), "null").when(a == ".", "no_call").when(a.rlike(r"^<.*>$") | a.contains("[") | a.contains("]"), "symbolic").otherwise("bases")


def _bases(allele: Column) -> Column:
    return F.when(allele.isin("-", ""), 0).otherwise(F.length(allele))


def variant_type(ref, alt) -> Column:
    """NO_VARIATION, SYMBOLIC, INDEL, SNP or MNP of one alternate allele."""
    r, a = col(ref), col(alt)
    n, m = _bases(r), _bases(a)
    return F.when(a == ".", "NO_VARIATION").when(allele_kind(a) == "symbolic", "SYMBOLIC").when(n != m, "INDEL").when(n == 1, "SNP").otherwise("MNP")


def variant_types(ref, alts) -> Column:
    """The type that all alternate alleles (an array) have, MIXED if they differ, NO_VARIATION without any."""
    kinds = F.array_distinct(F.transform(col(alts), lambda a: variant_type(ref, a)))
    return F.when(F.size(kinds) == 0, "NO_VARIATION").when(F.size(kinds) == 1, kinds[0]).otherwise("MIXED")


def simple_indel(ref, alt) -> Column:
    """insertion, deletion or complex, for alleles that share their first base; null if no indel."""
    r, a = col(ref), col(alt)
    return F.when(F.length(r) == F.length(a), F.lit(None)).when((F.length(r) == 1) & a.startswith(r), "insertion").when((F.length(a) == 1) & r.startswith(a), "deletion").otherwise("complex")


# tags: map<string, struct<type:string, value:string>> -----------------------------------------------------------------


def tag(name: str, tags="tags") -> Column:
    return F.try_element_at(col(tags), F.lit(name))["value"]


def tag_type(name: str, tags="tags") -> Column:
    return F.try_element_at(col(tags), F.lit(name))["type"]


def has_tag(name: str, tags="tags") -> Column:
    return F.map_contains_key(col(tags), F.lit(name))


def edit_tag(name: str, kind: str, value, tags="tags") -> Column:
    made = F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), col(value).cast("string").alias("value")))
    return F.map_concat(remove_tag(name, tags), made)


def add_tag(name: str, kind: str, value, tags="tags") -> Column:
    """Unchanged if the tag is there already."""
    return F.when(has_tag(name, tags), col(tags)).otherwise(edit_tag(name, kind, value, tags))


def remove_tag(name: str, tags="tags") -> Column:
    return F.map_filter(col(tags), lambda k, _: k != name)
