"""FASTA in chunks by its index, interval and repeat-region lists, FASTQ sink.

An index row says where a sequence's bases begin and how long its lines are, so any stretch is a byte range.  A file without
an index is indexed by ranges of bytes; sequences are read in chunks of ``CHUNK`` bases, of any length of file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .header import Header

#: Bases of a chunk (as the readers of reference windows expect), and bytes that one indexing task reads.
CHUNK, RANGE = 1 << 16, 64 << 20
INDEX = "name string, length long, offset long, line_bases long, line_bytes long"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


def _lines(f, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its end) from the first line that begins at ``start`` or later."""
    if start:
        f.seek(start - 1)
        at, rest, skip = start - 1, b"", True
    else:
        f.seek(0)
        at, rest, skip = 0, b"", False
    while True:
        data = f.read(1 << 20)
        parts = (rest + data).split(b"\n")
        if not data:
            if rest and not skip:
                yield at, rest
            return
        rest = parts.pop()
        for part in parts:
            line = part + b"\n"
            if not skip:
                yield at, line
            skip = False
            at += len(line)


def _scan(batches):
    """What a range of a FASTA file holds: a row for each run of lines of one sequence.

    (offset, name or null where the run goes on from before, bases, first line's bases and bytes, whether the lines are even).
    """
    for batch in batches:
        for row in batch.to_pylist():
            system, name = _at(row["path"])
            out: list[list] = []
            with system.open_input_file(name) as f:
                for at, line in _lines(f, row["start"], f.size()):
                    if at >= row["end"]:
                        break
                    if line.startswith(b">"):
                        out.append([at + len(line), line[1:].split()[0].decode() if line[1:].split() else "", 0, 0, 0, True, 0])
                        continue
                    bases = len(line.rstrip(b"\r\n"))
                    if not out:
                        out.append([at, None, 0, 0, 0, True, 0])
                    run = out[-1]
                    if not bases:
                        continue
                    if not run[3]:
                        run[3], run[4] = bases, len(line)
                    elif run[6] != run[3]:
                        run[5] = False  # a line of another length stands before others
                    run[2] += bases
                    run[6] = bases
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["offset", "name", "bases", "line_bases", "line_bytes", "even", "last"])


def make_index(spark: SparkSession, path: str, range_bytes: int = RANGE) -> list[tuple[str, int, int, int, int]]:
    """INDEX rows of a FASTA file; ranges are scanned apart, and their few rows are put together here."""
    system, name = _at(path)
    info = system.get_file_info(name)
    starts = range(0, max(info.size, 1), range_bytes)
    splits = spark.createDataFrame([(path, s, min(s + range_bytes, info.size)) for s in starts], "path string, start long, end long")
    rows = splits.repartitionByRange(len(starts), "start").mapInArrow(_scan, "offset long, name string, bases long, line_bases long, line_bytes long, even boolean, last long").orderBy("offset").collect()
    out: list[list] = []
    last = 0
    for r in rows:
        if r["name"] is not None:
            out.append([r["name"], 0, r["offset"], 0, 0])
        elif not out:
            if r["bases"]:
                raise ValueError(f"{path} is no FASTA file")
            continue
        own = out[-1]
        if r["bases"]:
            if own[3] and (last != own[3] or (r["line_bases"] != own[3] and r["bases"] > r["line_bases"])):
                raise ValueError(f"{path}: lines of {own[0]} differ in length")
            if not r["even"]:
                raise ValueError(f"{path}: lines of {own[0]} differ in length")
            own[3], own[4] = own[3] or r["line_bases"], own[4] or r["line_bytes"]
            own[1] += r["bases"]
            last = r["last"]
    return [tuple(r) for r in out]


def read_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """INDEX rows of a ``.fai`` file."""
    system, name = _at(path)
    with system.open_input_stream(name) as f:
        rows = [line.split("\t") for line in f.read().decode().splitlines() if line]
    if any(len(r) != 5 for r in rows):
        raise ValueError(f"{path}: an index has five columns")
    return [(r[0], *map(int, r[1:])) for r in rows]


def write_index(index: list[tuple[str, int, int, int, int]], path: str) -> None:
    system, name = _at(path)
    with system.open_output_stream(name) as f:
        f.write("".join("\t".join(map(str, r)) + "\n" for r in index).encode())


def check_index(path: str, index: list[tuple[str, int, int, int, int]]) -> None:
    """Fails where a sequence's bases don't follow its header line, or reach beyond the file."""
    system, name = _at(path)
    with system.open_input_file(name) as f:
        size = f.size()
        for seq, length, offset, bases, width in index:
            f.seek(max(0, offset - 4096))
            before = f.read(min(4096, offset))
            header = before[:-1].rsplit(b"\n", 1)[-1] if before.endswith(b"\n") else b""
            long = len(header) == len(before) - 1 and offset > 4096  # a header line longer than what was read
            if not long and (not header.startswith(b">") or header[1:].split()[:1] != [seq.encode()]):
                raise ValueError(f"{path}: the index is wrong about {seq}")
            if length and offset + (length - 1) // bases * width + (length - 1) % bases + 1 > size:
                raise ValueError(f"{path}: {seq} ends beyond the file")


def open_index(spark: SparkSession, path: str) -> list[tuple[str, int, int, int, int]]:
    """The index beside a FASTA file, checked; made (and not written) where there is none."""
    system, name = _at(f"{path}.fai")
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return make_index(spark, path)
    index = read_index(f"{path}.fai")
    check_index(path, index)
    return index


def _read_chunks(batches):
    for batch in batches:
        for r in batch.to_pylist():
            system, name = _at(r["path"])
            first, last = r["start"], r["start"] + r["count"] - 1
            place = lambda k: r["offset"] + k // r["line_bases"] * r["line_bytes"] + k % r["line_bases"]  # noqa: E731, B023
            with system.open_input_file(name) as f:
                f.seek(place(first))
                data = f.read(place(last) + 1 - place(first)).replace(b"\n", b"").replace(b"\r", b"")
            if len(data) != r["count"]:
                raise ValueError(f"{r['path']} ends within {r['name']}")
            yield pa.RecordBatch.from_arrays([pa.array([r["name"]]), pa.array([r["ref_id"]], pa.int32()), pa.array([first], pa.int32()), pa.array([data.decode("latin-1")])], names=["name", "ref_id", "start", "bases"])


def read_fasta(spark: SparkSession, path: str, header: Header | None = None, chunk: int = CHUNK) -> DataFrame:
    """(name, ref_id, start, bases): chunks of ``chunk`` bases.  ``ref_id`` is the place in the header's dictionary, or else in
    the file; sequences that the header doesn't know are left out."""
    index = open_index(spark, path)
    ids = {n: i for n, (i, _) in header.lookup.items()} if header else {r[0]: i for i, r in enumerate(index)}
    rows = [(path, n, ids[n], *r) for n, *r in index if n in ids and r[0]]
    schema = "path string, name string, ref_id int, length long, offset long, line_bases long, line_bytes long"
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long")))
    every = spark.createDataFrame(rows, schema).withColumn("start", starts).withColumn("count", F.least(F.lit(chunk).cast("long"), F.col("length") - F.col("start")))
    total = sum(r[3] // chunk + 1 for r in rows)
    return every.repartition(max(1, min(total, 4096)), "name", "start").mapInArrow(_read_chunks, "name string, ref_id int, start int, bases string")


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """INDEX as a table."""
    return spark.createDataFrame(open_index(spark, path), INDEX)


def dictionary(index: list[tuple[str, int, int, int, int]]) -> tuple:
    """Header sequences of an index."""
    return tuple({"SN": n, "LN": str(length)} for n, length, *_ in index)


def sequences(spark: SparkSession, header: Header) -> DataFrame:
    """(ref_id, ref_name, length) of a header."""
    return spark.createDataFrame([(i, n, size) for n, (i, size) in header.lookup.items()], "ref_id int, ref_name string, length int")


def subsequence(bases, start, length):
    """0-based slice; beyond the sequence is an error."""
    s, n = F.col(start) if isinstance(start, str) else start, F.col(length) if isinstance(length, str) else length
    b = F.col(bases) if isinstance(bases, str) else bases
    return F.when((s < 0) | (s + n > F.length(b)), F.raise_error(F.lit("position beyond the sequence")).cast("string")).otherwise(F.substring(b, s + 1, n))


def read_intervals(spark: SparkSession, path: str, header: Header | None = None) -> DataFrame:
    """``chr:a-b``, ``chr:a`` or ``chr`` lines, 1-based closed -> idx, ref_name, start, stop, 0-based closed (and ref_id, from a header).

    Lists are read up to their first blank line.  With a header a whole sequence ends where it does, and unknown sequences
    are errors.
    """
    p = r"^([^:]+)(?::(\d+)(?:-(\d+))?)?$"
    part = lambda k: F.nullif(F.regexp_extract(F.trim("value"), p, k), F.lit(""))
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("idx"), "value")
    blank = lines.filter(F.trim("value") == "").agg(F.min("idx").alias("end"))
    rows = lines.join(F.broadcast(blank), F.col("end").isNull() | (F.col("idx") < F.col("end")))  # one row
    wrong = F.raise_error(F.concat(F.lit("invalid interval "), F.col("value")))
    name = F.coalesce(part(1), wrong)
    made = rows.select("idx", name.alias("ref_name"), (F.coalesce(part(2), F.lit("1")).cast("int") - 1).alias("start"), (F.coalesce(part(3), part(2)).cast("int") - 1).alias("stop"))
    if header is None:
        return made
    known = made.join(F.broadcast(sequences(spark, header)), "ref_name", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown sequence "), F.col("ref_name"))).cast("int")
    return known.select("idx", "ref_name", F.coalesce("ref_id", unknown).alias("ref_id"), "start", F.coalesce("stop", F.col("length") - 1).alias("stop"))


def _regions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).filter(F.trim("value") != "").select("value", F.split("value", "\t").alias("f")).select("value", F.get("f", F.lit(0)).alias("region"), F.coalesce(F.get("f", F.lit(1)), F.lit("")).alias("second"))
    return rows.withColumn("valid", F.col("second").contains("_"))


def skipped_regions(spark: SparkSession, path: str) -> DataFrame:
    """(value, message) of lines that :func:`read_repeat_regions` leaves out."""
    return _regions(spark, path).filter("not valid").select("value", F.concat(F.lit("improper second column found for "), "region").alias("message"))


def read_repeat_regions(spark: SparkSession, path: str) -> DataFrame:
    """``chr:a-b <tab> unit_x_x_purity_..._SEQ`` -> region, second, ref_name, start, stop (1-based), unit_length, purity, unit.

    Lines whose second column has no ``_`` are left out; :func:`skipped_regions` tells them.
    """
    u = F.split("second", "_")
    p = r"^([^:]+):(\d+)-(\d+)$"
    return _regions(spark, path).filter("valid").select(
        "region", "second", F.regexp_extract("region", p, 1).alias("ref_name"), F.regexp_extract("region", p, 2).cast("int").alias("start"), F.regexp_extract("region", p, 3).cast("int").alias("stop"),
        F.get(u, F.lit(0)).try_cast("int").alias("unit_length"), F.get(u, F.lit(3)).try_cast("double").alias("purity"), F.element_at(u, -1).alias("unit"),
    )


def write_fastq(pairs: DataFrame, orphans: DataFrame, path: str) -> None:
    """``path_1.fastq``, ``path_2.fastq`` and ``path.fastq`` (orphans by name), each a folder of text."""
    record = lambda name, seq, qual, end: F.concat(F.lit("@"), name, F.lit(end + "\n"), seq, F.lit("\n+"), name, F.lit(end + "\n"), qual).alias("value")
    n = F.col("name")
    for k in (1, 2):
        pairs.orderBy("name").select(record(n, F.col(f"seq{k}"), F.col(f"qual{k}"), f"/{k}")).write.text(f"{path}_{k}.fastq")
    orphans.orderBy("name").select(record(n, F.col("seq"), F.col("qual"), "")).write.text(f"{path}.fastq")
