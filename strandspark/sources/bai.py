"""Index of a sorted BAM file: where in the file the records of each bin and of each stretch of a sequence lie.

Ranges of the file are scanned for the virtual offsets of their records; bins, chunks and linear offsets are groupings of
those.  The driver sees the index alone, one sequence at a time.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from .bam import CIGAR, CORE, RANGE, _at, _blocks, _first_record, _start, sniff

# Fixed values of the format: magic, bin of the sequence's own numbers, bits of a linear window.
MAGIC, OWN_BIN, WINDOW_BITS = b"BAI\1", 37450, 14
#: Chunks of a bin that are nearer than this, in bytes of the file, are one.
NEAR = 32_768
OFFSETS = "ref_id int, pos int, stop int, flag int, begin long, finish long"
_REFERENCE_OPS = frozenset("MDN=X")


def _records(path: str, start: int, skip: int, end: int, refs: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """OFFSETS of the records that begin in blocks from ``start`` on and before ``end``."""
    system, name = _at(path)
    with system.open_input_file(name) as f:
        size = f.size()
        blocks, buf, starts, places, last = _blocks(f, size, start, False), bytearray(), [], [], size

        def fill(least: int) -> bool:
            nonlocal last
            while len(buf) < least:
                at, data = next(blocks, (None, b""))
                if at is None:
                    return False
                if not data:
                    last = at
                    continue
                starts.append(len(buf))
                places.append(at)
                buf.extend(data)
            return True

        def offset(at: int) -> int:
            if at >= len(buf) and not fill(at + 1):
                return last << 16
            k = bisect_right(starts, at) - 1
            return places[k] << 16 | (at - starts[k])

        window = 1 << 18
        while skip < 0:
            whole = not fill(window)
            found = _first_record(buf, refs, whole)
            window *= 2
            if found is not None:
                skip = found
        at, here = skip, None
        while fill(at + 4):
            here = offset(at)
            if here >> 16 >= end:
                return
            length = struct.unpack_from("<i", buf, at)[0]
            if not fill(at + 4 + length):
                raise ValueError(f"{path} ends within a record")
            _, ref, pos, name_size, _, _, ops, flag, *_ = struct.unpack_from(CORE, buf, at)
            cigar = struct.unpack_from(f"<{ops}I", buf, at + 36 + name_size)
            span = sum(x >> 4 for x in cigar if CIGAR[x & 15] in _REFERENCE_OPS)
            at += 4 + length
            yield ref, pos, pos + max(span, 1), flag, here, offset(at)
            if at > 1 << 22:
                cut = bisect_right(starts, at) - 1
                gone = starts[cut] if cut >= 0 and at < len(buf) else at
                del buf[:gone]
                keep = [i for i, s in enumerate(starts) if s >= gone]
                starts[:], places[:] = [starts[i] - gone for i in keep], [places[i] for i in keep]
                at -= gone


def _scan(batches):
    names = [c.split()[0] for c in OFFSETS.split(", ")]
    kinds = [pa.int32()] * 4 + [pa.int64()] * 2
    for batch in batches:
        for row in batch.to_pylist():
            rows = []
            for record in _records(**row):
                rows.append(record)
                if len(rows) == 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def record_offsets(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """OFFSETS: place, end, flag and virtual offsets (of the record, and behind it) of each record of a BAM file."""
    if sniff(path) != "bam":
        raise ValueError(f"{path} has no blocks to point at")
    header, size, place, skip = _start(path, False)
    splits = [(path, at, skip if at == place else -1, min(at + range_bytes, size), len(header.sequences)) for at in range(place, max(size, place + 1), range_bytes)]
    table = spark.createDataFrame(splits, "path string, start long, skip long, end long, refs int")
    return table.repartitionByRange(len(splits), "start").mapInArrow(_scan, OFFSETS)


def bins(offsets: DataFrame) -> DataFrame:
    """(ref_id, bin, begin, finish): the chunks of each bin, near ones put together."""
    placed = offsets.filter("ref_id >= 0").withColumn("bin", C.ucsc_bin("pos", "stop"))
    w = W.partitionBy("ref_id", "bin").orderBy("begin")
    far = F.shiftright("begin", 16) - F.shiftright(F.max("finish").over(w.rowsBetween(W.unboundedPreceding, -1)), 16) >= NEAR
    chunk = F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(w)
    return placed.withColumn("chunk", chunk).groupBy("ref_id", "bin", "chunk").agg(F.min("begin").alias("begin"), F.max("finish").alias("finish")).drop("chunk")


def linear(offsets: DataFrame) -> DataFrame:
    """(ref_id, window, offset): the first record over each window of 2^WINDOW_BITS bases."""
    window = F.explode(F.sequence(F.shiftright("pos", WINDOW_BITS), F.shiftright(F.col("stop") - 1, WINDOW_BITS))).alias("window")
    return offsets.filter("ref_id >= 0 and pos >= 0").select("ref_id", "begin", window).groupBy("ref_id", "window").agg(F.min("begin").alias("offset"))


def metadata(offsets: DataFrame) -> DataFrame:
    """(ref_id, begin, finish, mapped, unmapped) of each sequence; ref_id -1 has the reads without a place."""
    return offsets.groupBy("ref_id").agg(F.min("begin").alias("begin"), F.max("finish").alias("finish"), F.count_if(~C.has("unmapped")).alias("mapped"), F.count_if(C.has("unmapped")).alias("unmapped"))


def write_index(spark: SparkSession, path: str, target: str | None = None, range_bytes: int = RANGE) -> None:
    """Write ``path.bai`` for a BAM file sorted by place."""
    offsets = record_offsets(spark, path, range_bytes)
    header, *_ = _start(path, False)
    own = {r["ref_id"]: r for r in metadata(offsets).collect()}  # a row for each sequence
    chunks = _by_reference(bins(offsets).orderBy("ref_id", "bin", "begin"))
    windows = _by_reference(linear(offsets).orderBy("ref_id", "window"))
    system, name = _at(target or f"{path}.bai")
    with system.open_output_stream(name) as out:
        out.write(MAGIC + struct.pack("<i", len(header.sequences)))
        for ref in range(len(header.sequences)):
            by_bin: dict[int, list[tuple[int, int]]] = {}
            for r in chunks(ref):
                by_bin.setdefault(r["bin"], []).append((r["begin"], r["finish"]))
            if ref in own:
                by_bin[OWN_BIN] = [(own[ref]["begin"], own[ref]["finish"]), (own[ref]["mapped"], own[ref]["unmapped"])]
            out.write(struct.pack("<i", len(by_bin)))
            for number, pairs in by_bin.items():
                out.write(struct.pack("<Ii", number, len(pairs)) + b"".join(struct.pack("<QQ", *p) for p in pairs))
            line: list[int] = []
            for r in windows(ref):
                line += [line[-1] if line else 0] * (r["window"] - len(line)) + [r["offset"]]
            out.write(struct.pack(f"<i{len(line)}Q", len(line), *line))
        without = own.get(-1)
        out.write(struct.pack("<Q", without["mapped"] + without["unmapped"] if without else 0))


def _by_reference(rows: DataFrame):
    """A function that gives the ordered rows of one sequence after another, streamed to the driver."""
    stream, held = rows.toLocalIterator(), []

    def of(ref: int) -> list:
        out = []
        while True:
            r = held.pop() if held else next(stream, None)
            if r is None:
                return out
            if r["ref_id"] != ref:
                held.append(r)
                return out
            out.append(r)

    return of


def read_index(path: str) -> tuple[list[tuple[dict[int, list[tuple[int, int]]], list[int]]], int]:
    """([(chunks by bin, linear offsets) of each sequence], reads without a place) of an index file."""
    system, name = _at(path)
    with system.open_input_stream(name) as f:
        data = f.read()
    if data[:4] != MAGIC:
        raise ValueError(f"{path} is no index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        count = struct.unpack_from("<i", data, at)[0]
        at, by_bin = at + 4, {}
        for _ in range(count):
            number, n = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
            by_bin[number] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 8 + 16 * n
        n = struct.unpack_from("<i", data, at)[0]
        out.append((by_bin, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
        at += 4 + 8 * n
    return out, struct.unpack_from("<Q", data, at)[0] if at + 8 <= len(data) else 0
