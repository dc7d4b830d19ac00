"""BAM, compressed in BGZF blocks or raw: files are read in byte ranges, and written as one part for each partition.

The driver reads headers only.  A range's task looks for the first block, then for the first place from which a chain of
records holds; it emits the records that begin in its range, a few megabytes at a time.  Parts are complete runs of
blocks, so header, parts and the empty last block one after another are a BAM file.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from .header import Header, parse_header

# Fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
CIGAR = "MIDNSHP=X"
BLOCK_MAGIC = b"\x1f\x8b\x08\x04"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
BIN_LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
CORE = "<iiiBBHHHiiii"

#: Bytes of file that one task reads; bytes of records decoded at a time; bytes of records in a block.
RANGE, BATCH, PAYLOAD = 64 << 20, 4 << 20, 65_280
SCHEMA = (
    "idx long, name string, flag int, ref_id int, pos int, mapq int, cigar string, mate_ref_id int, mate_pos int, "
    "insert_size int, seq string, qual string, read_len int, tags map<string,struct<type:string,value:string>>"
)
_PAIRS = [a + b for a in BASES for b in BASES]
_CODE = {c: i for i, c in enumerate(BASES)}
_TAGS = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))
_TYPES = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string(), *[pa.int32()] * 3, pa.string(), pa.string(), pa.int32(), _TAGS]


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


def sniff(path: str) -> str:
    """``sam``, ``bam`` or ``raw`` (BAM without compression), by the first two bytes; anything else is refused."""
    system, name = _at(path)
    with system.open_input_file(name) as f:
        start = f.read(2)
    if start[:1] == b"@":
        return "sam"
    found = {b"\x1f\x8b": "bam", b"BA": "raw"}.get(start)
    if not found:
        raise ValueError(f"{path} is neither SAM nor BAM")
    return found


def _block_size(data: bytes, at: int) -> int:
    """Length of the block that begins there; 0 if none does, -1 if its header is cut off."""
    if len(data) < at + 12:
        return -1 if data[at : at + 4] == BLOCK_MAGIC[: len(data) - at] else 0
    if data[at : at + 4] != BLOCK_MAGIC:
        return 0
    extra = struct.unpack_from("<H", data, at + 10)[0]
    if len(data) < at + 12 + extra:
        return -1
    k, end = at + 12, at + 12 + extra
    while k + 4 <= end:
        length = struct.unpack_from("<H", data, k + 2)[0]
        if data[k : k + 2] == b"BC" and length == 2 and k + 6 <= end:
            return struct.unpack_from("<H", data, k + 4)[0] + 1
        k += 4 + length
    return 0


def _blocks(f, size: int, start: int, raw: bool) -> Iterator[tuple[int, bytes]]:
    """(place in the file, content) of each block from the first one that begins at ``start`` or later."""
    if raw:
        for at in range(start, size, 1 << 16):
            f.seek(at)
            yield at, f.read(min(1 << 16, size - at))
        return
    f.seek(start)
    data, at = f.read(4 << 16), 0
    while at < len(data):  # the block must be followed by another, or by the end
        length = _block_size(data, at)
        if length > 0 and (start + at + length == size or _block_size(data, at + length)):
            break
        at = data.find(BLOCK_MAGIC, at + 1)
        if at < 0:
            return
    place = start + at
    data = data[at:]
    while True:
        while len(data) < 1 << 16 and (more := f.read(1 << 20)):
            data += more
        at = 0
        while at < len(data):
            length = _block_size(data, at)
            if length == 0:
                raise ValueError(f"no block at byte {place + at}")
            if length < 0 or at + length > len(data):
                break
            extra = struct.unpack_from("<H", data, at + 10)[0]
            yield place + at, zlib.decompress(data[at + 12 + extra : at + length - 8], -15)
            at += length
        place, data = place + at, data[at:]
        if not (more := f.read(1 << 20)):
            if data:
                raise ValueError("the file ends within a block")
            return
        data += more


def _holds(buf, at: int, refs: int) -> int:
    """End of the record that may begin there, 0 if none can; only for places with 36 bytes or more behind them."""
    size, ref, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = struct.unpack_from(CORE, buf, at)
    if not (-1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and name and bases >= 0):
        return 0
    if size < 32 + name + 4 * ops + (bases + 1) // 2 + bases:
        return 0
    text = bytes(buf[at + 36 : at + 36 + name])
    if len(text) == name and (text[-1] or not all(33 <= c <= 126 for c in text[:-1])):
        return 0
    return at + 4 + size


def _first_record(buf, refs: int, whole: bool) -> int | None:
    """The first place from which records follow each other to the buffer's end; None where more bytes are needed to tell."""
    for start in range(len(buf) + 1):
        at, seen = start, 0
        while at + 36 <= len(buf) and (end := _holds(buf, at, refs)):
            at, seen = end, seen + (end <= len(buf))
        if at + 36 <= len(buf) or (whole and at != len(buf)):
            continue
        if whole or seen >= 3:
            return start
        return None
    return len(buf)


def _tags(buf: bytes, at: int, end: int) -> list:
    out = []
    while at + 3 <= end:
        key, kind = buf[at : at + 2].decode("ascii"), chr(buf[at + 2])
        at += 3
        if kind in NUMBERS:
            value = struct.unpack_from("<" + NUMBERS[kind], buf, at)[0]
            at += struct.calcsize(NUMBERS[kind])
            value = str(np.float32(value)) if kind == "f" else str(value)
        elif kind == "A":
            value, at = chr(buf[at]), at + 1
        elif kind in "ZH":
            stop = buf.index(b"\0", at)
            value, at = buf[at:stop].decode("utf-8", "replace"), stop + 1
        elif kind == "B":
            item, n = chr(buf[at]), struct.unpack_from("<i", buf, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[item]}", buf, at + 5)
            at += 5 + n * struct.calcsize(NUMBERS[item])
            value = ",".join([item, *(str(np.float32(v)) if item == "f" else str(v) for v in values)])
        else:
            raise ValueError(f"tag {key} has unknown type {kind}")
        out.append((key, {"type": kind, "value": value}))
    return list(dict(out).items())


def _record(buf: bytes, at: int, idx: int) -> tuple:
    size, ref, pos, name, mapq, _, ops, flag, bases, mate, mate_pos, insert = struct.unpack_from(CORE, buf, at)
    k, end = at + 36, at + 4 + size
    text = buf[k : k + name - 1].decode("utf-8", "replace")
    k += name
    cigar = "".join(f"{v >> 4}{CIGAR[v & 15]}" for v in struct.unpack_from(f"<{ops}I", buf, k)) or "*"
    k += 4 * ops
    seq = "".join([_PAIRS[b] for b in buf[k : k + (bases + 1) // 2]])[:bases] or "*"
    k += (bases + 1) // 2
    qual = buf[k : k + bases]
    qual = bytes(q + 33 for q in qual).decode("latin-1") if qual and qual[0] != 255 else "*"
    return idx, text, flag, ref, pos, mapq, cigar, mate, mate_pos, insert, seq, qual, bases, _tags(buf, k + bases, end)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


def _read_range(path: str, raw: bool, start: int, skip: int, end: int, refs: int, idx: int) -> Iterator[pa.RecordBatch]:
    """Records that begin in blocks (raw: bytes) from ``start`` on and before ``end``; ``skip`` bytes of the first, or -1: look for one."""
    system, name = _at(path)
    with system.open_input_file(name) as f:
        blocks = _blocks(f, f.size(), start, raw)
        buf, own, window = bytearray(), 0, BATCH // 4  # ``own``: bytes of the buffer from blocks of this range

        def fill(least: int) -> bool:
            nonlocal own
            while len(buf) < least:
                at, data = next(blocks, (None, b""))
                if at is None:
                    return False
                inside = max(0, end - at)
                own += min(len(data), inside) if raw else len(data) * (inside > 0)
                buf.extend(data)
            return True

        while skip < 0:
            whole = not fill(window)
            found = _first_record(buf, refs, whole)
            window *= 2
            if found is not None:
                skip = found
        fill(skip)
        del buf[:skip]
        own -= skip
        while own > 0 or (own == 0 and not buf and fill(1) and own > 0):
            fill(BATCH)
            at, rows, data = 0, [], bytes(buf)
            while at < own and at + 4 <= len(data):
                size = struct.unpack_from("<i", data, at)[0]
                if size < 32:
                    raise ValueError(f"{path}: a record of {size} bytes")
                if at + 4 + size > len(data):
                    break
                rows.append(_record(data, at, idx))
                idx, at = idx + 1, at + 4 + size
            if rows:
                yield _batch(rows)
            del buf[:at]
            own -= at
            if own > 0 and not rows:
                need = 4 + struct.unpack_from("<i", buf)[0] if len(buf) >= 4 else 4
                if not fill(max(need, len(buf) + 1)):
                    raise ValueError(f"{path} ends within a record")


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield from _read_range(**row)


def _start(path: str, raw: bool) -> tuple[Header, int, int, int]:
    """Header, file size, and the block and byte in it where the first record begins."""
    system, name = _at(path)
    with system.open_input_file(name) as f:
        size = f.size()
        buf, ends, blocks = bytearray(), [], _blocks(f, size, 0, raw)

        def need(n: int) -> None:
            while len(buf) < n:
                at, data = next(blocks, (None, b""))
                if at is None:
                    raise ValueError(f"{path} ends within its header")
                buf.extend(data)
                ends.append((len(buf), at, len(data)))

        need(8)
        if buf[:4] != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        length = struct.unpack_from("<i", buf, 4)[0]
        at = 8 + length
        need(at + 4)
        text = bytes(buf[8:at]).rstrip(b"\0").decode("utf-8", "replace")
        count = struct.unpack_from("<i", buf, at)[0]
        at += 4
        found = []
        for _ in range(count):
            need(at + 4)
            n = struct.unpack_from("<i", buf, at)[0]
            need(at + 8 + n)
            found.append((bytes(buf[at + 4 : at + 3 + n]).decode(), struct.unpack_from("<i", buf, at + 4 + n)[0]))
            at += 8 + n
    header = parse_header(text)
    if header.sequences and [(s["SN"], int(s["LN"])) for s in header.sequences] != found:
        raise ValueError(f"{path}: sequences of the header text and of the list differ")
    if not header.sequences:
        header = Header(header.hd, tuple({"SN": s, "LN": str(n)} for s, n in found), header.read_groups, header.programs, header.comments)
    for end, place, n in ends:
        if at < end:
            return header, size, place, at - (end - n)
    return header, size, ends[-1][1], at - (ends[-1][0] - ends[-1][2])


def read_bam(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE) -> tuple[DataFrame, Header]:
    """(reads, header of the first file), as ``read_sam`` gives them; ``idx`` follows the order of files and of records.

    Paths are absolute or URIs that executors can open.  Files with other sequences than the first are refused; a file
    that ends within a block or a record is an error, and one without records gives no rows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    splits, first = [], None
    for path in paths:
        raw = {"bam": False, "raw": True}.get(sniff(path))
        if raw is None:
            raise ValueError(f"{path} is SAM text")
        header, size, place, skip = _start(path, raw)
        first = first or header
        if not first.same_dictionary(header):
            raise ValueError(f"{path} has other sequences than {paths[0]}")
        for at in range(place, max(size, place + 1), range_bytes):
            splits.append((path, raw, at, skip if at == place else -1, min(at + range_bytes, size), len(header.sequences), len(splits) << 33))
    table = spark.createDataFrame(splits, "path string, raw boolean, start long, skip long, end long, refs int, idx long")
    return table.repartitionByRange(len(splits), "idx").mapInArrow(_read, SCHEMA), first


def _bin(begin: int, end: int) -> int:
    for shift, base in BIN_LEVELS:
        if begin >> shift == (end - 1) >> shift:
            return base + (begin >> shift)
    return 0


def _encode_tag(key: str, kind: str, value: str) -> bytes:
    head = key.encode() + kind.encode()
    number = lambda k, v: struct.pack("<" + NUMBERS[k], float(v) if k == "f" else int(v))
    if kind in NUMBERS:
        return head + number(kind, value)
    if kind == "A":
        return head + value.encode("latin-1")[:1]
    if kind == "B":
        item, *values = value.split(",")
        return head + item.encode() + struct.pack("<i", len(values)) + b"".join(number(item, v) for v in values)
    return head + value.encode() + b"\0"


def encode(r: dict) -> bytes:
    """The BAM record of a row; the bin is worked out from position and CIGAR."""
    ops, n = [], 0
    for c in "" if r["cigar"] == "*" else r["cigar"]:
        if c.isdigit():
            n = n * 10 + int(c)
        else:
            ops.append((n, c))
            n = 0
    span = sum(n for n, c in ops if c in "MDN=X")
    seq = "" if r["seq"] == "*" else r["seq"]
    codes = [_CODE.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    qual = bytes([255] * len(seq)) if r["qual"] == "*" else bytes(ord(c) - 33 for c in r["qual"])
    if len(qual) != len(seq):
        raise ValueError(f"read {r['name']}: bases and qualities differ in length")
    name = r["name"].encode() + b"\0"
    tags = b"".join(_encode_tag(k, v["type"], v["value"]) for k, v in r["tags"] or [])
    body = name + struct.pack(f"<{len(ops)}I", *(n << 4 | CIGAR.index(c) for n, c in ops)) + packed + qual + tags
    place = _bin(r["pos"], r["pos"] + max(span, 1)) & 0xFFFF
    return struct.pack(CORE, 32 + len(body), r["ref_id"], r["pos"], len(name), r["mapq"], place, len(ops), r["flag"], len(seq), r["mate_ref_id"], r["mate_pos"], r["insert_size"]) + body


def compress(data: bytes, level: int = 6) -> bytes:
    """BGZF blocks of the data, without the empty last one."""
    out = []
    for k in range(0, len(data), PAYLOAD):
        part = data[k : k + PAYLOAD]
        worker = zlib.compressobj(level, zlib.DEFLATED, -15)
        deflated = worker.compress(part) + worker.flush()
        head = BLOCK_MAGIC + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(deflated) + 25)
        out.append(head + deflated + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def _write(batches, path: str, raw: bool, level: int):
    """One part for each partition; an attempt writes a file of its own, which takes the part's name at the end."""
    system, folder = _at(path)
    number = TaskContext.get().partitionId()
    own, rows, rest = f"{folder}/_{number:05d}-{uuid.uuid4().hex}", 0, b""
    with system.open_output_stream(own) as out:
        for batch in batches:
            rest += b"".join(map(encode, batch.to_pylist()))
            rows += batch.num_rows
            whole = len(rest) if raw else len(rest) - len(rest) % PAYLOAD
            out.write(rest[:whole] if raw else compress(rest[:whole], level))
            rest = rest[whole:]
        out.write(rest if raw else compress(rest, level))
    system.move(own, f"{folder}/part-{number:05d}")
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([rows], pa.int64())], names=["part", "rows"])


def write_bam(reads: DataFrame, header: Header, path: str, raw: bool = False, level: int = 6) -> int:
    """Write ``path/header``, ``path/part-*`` in the order of partitions and ``path/tail``; the number of reads.

    Only counts of parts come to the driver.  :func:`join_parts` makes one file of them.
    """
    system, folder = _at(path)
    system.create_dir(folder)
    text = header.text().encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(header.sequences))
    for s in header.sequences:
        name = s["SN"].encode() + b"\0"
        head += struct.pack("<i", len(name)) + name + struct.pack("<i", int(s["LN"]))
    columns = [c.split()[0] for c in SCHEMA.split(", ")][1:]
    parts = reads.select(*columns).mapInArrow(lambda batches: _write(batches, path, raw, level), "part int, rows long").collect()
    for name, data in (("header", head if raw else compress(head, level)), ("tail", b"" if raw else LAST_BLOCK)):
        with system.open_output_stream(f"{folder}/{name}") as out:
            out.write(data)
    return sum(r["rows"] for r in parts)


def join_parts(path: str, target: str) -> None:
    """One BAM file from the parts, copied a few megabytes at a time."""
    system, folder = _at(path)
    names = sorted(i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.base_name.startswith("part-"))
    to, name = _at(target)
    with to.open_output_stream(name) as out:
        for part in [f"{folder}/header", *names, f"{folder}/tail"]:
            with system.open_input_file(part) as f:
                while data := f.read(BATCH):
                    out.write(data)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
