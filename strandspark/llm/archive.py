"""Content-addressed WARC archive: payload bytes once under a strong digest, record headers apart, records by a join."""

from __future__ import annotations

import gzip
import uuid
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ship import remote, shared_folder

_HERE = "strandspark.llm.archive"
#: Payloads of fewer bytes are always responses of their own; they are stored once all the same.
LEAST = 1000
#: Places in the bitmap of repeated digests (16 MB at most when broadcast), and in each of its rows.
_PLACES, _ROW = 1 << 27, 1 << 15
END = "\r\n"
_ENCODED = "X-Target-URI-Encoding"


def _field(name: str, value) -> list:
    return [F.lit(f"{name}: "), value, F.lit(END)]


def write_archive(pages: DataFrame, path: str, least: int = LEAST, date: str | None = None) -> None:
    """Write one WARC/1.1 record for each row of (page_id, url, html) under ``path``.

    ``path/payloads`` has (digest, payload): each distinct payload once, under its SHA-256.  ``path/headers`` has (digest,
    revisit, header): the exact header block of each record, up to and with its blank line.  Of records with equal payloads of
    at least ``least`` bytes the one with the largest page_id is the response and the others are revisits of it.  ``date`` is
    the records' date, by default the time of the call.  Null html is an empty payload; a null url gives no target; one with
    line ends is percent-encoded, percent signs too, under a header of its own, so every url is read back as it was.  Rows
    that repeat the largest page_id and payload are all responses; a null page_id counts as the smallest.  Other columns are
    not looked at.  An empty table gives an empty archive.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    owners = keyed.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    named = keyed.join(owners.drop("n"), "digest")
    revisit = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    empty = F.lit("")
    encoded = F.replace(F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.when(F.col("url").isNull(), empty).when(F.col("url").rlike("[\r\n]"), F.concat(*_field("WARC-Target-URI", encoded), *_field(_ENCODED, F.lit("percent")))).otherwise(F.concat(*_field("WARC-Target-URI", F.col("url"))))
    header = F.concat(
        F.lit("WARC/1.1" + END),
        *_field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        *_field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        *_field("WARC-Date", F.lit(date)),
        target,
        *_field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(*_field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), *_field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("owner").cast("string"), F.lit(">"))))).otherwise(empty),
        *_field("Content-Type", F.lit("text/html; charset=utf-8")),
        *_field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(END),
    )
    named.select("digest", revisit.alias("revisit"), header.alias("header")).write.parquet(f"{path}/headers")
    # a payload that no other row has is written as it is read; the others, and a few at the same places of the bitmap, meet their owners
    key = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63))).alias("key")
    kept = pages.select(key("page_id"), F.sha2(payload, 256).alias("digest"), payload.alias("payload")).withColumn("place", _place())
    placed = kept.join(F.broadcast(_repeated(owners)), F.col("row") == F.floor(F.col("place") / _ROW), "left")
    shared = F.coalesce(F.expr(f"shiftright(cast(conv(hex(substring(bits, cast(place % {_ROW} div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) & 1 = 1"), F.lit(False))
    # the join on both columns has no hot key (a digest's copies differ in page_id), and dropping repeats needs no other shuffle
    mine = placed.filter(shared).select("key", "digest", "payload").join(owners.select("digest", key("owner")), ["digest", "key"], "left_semi")
    once = placed.filter(~shared).select("digest", "payload")
    once.unionByName(mine.dropDuplicates(["digest", "key"]).select("digest", "payload")).write.parquet(f"{path}/payloads")


def _place() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(_PLACES))


def _repeated(owners: DataFrame) -> DataFrame:
    """(row, bits): a bitmap over the places of all digests that more than one row has; of bounded size, so others share places."""
    places = owners.filter("n > 1").select(_place().alias("place"))
    return places.select(F.floor(F.col("place") / _ROW).alias("row"), (F.col("place") % _ROW).alias("at")).repartition("row").groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits"))


def _bad(kind: str = "string") -> Column:
    return F.raise_error(F.lit("archive: a payload does not match its digest")).cast(kind)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload); a payload whose SHA-256 isn't its address fails the read."""
    return spark.read.parquet(f"{path}/payloads").select(F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(_bad()).alias("digest"), "payload")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: digest and ``record``, the exact bytes of each WARC record.

    Headers of responses meet the payloads by their digest; a revisit's record has no payload and needs no join.
    """
    headers = spark.read.parquet(f"{path}/headers")
    close = F.lit(END * 2)
    responses = headers.filter("not revisit").join(_stored(spark, path), "digest").select("digest", F.concat(F.col("header").cast("binary"), F.col("payload"), close.cast("binary")).alias("record"))
    return responses.unionByName(headers.filter("revisit").select("digest", F.concat("header", close).cast("binary").alias("record")))


def _of(header, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def parse_records(records: DataFrame) -> DataFrame:
    """(..., record) -> page_id, url, record_type, refers_to, date, payload_digest, content, and all other columns.

    Everything is read from the record's bytes.  ``content`` is what follows the blank line, as long as the header says; a
    response whose content isn't of that length, or not of the digest in its header, fails the read.
    """
    text = F.col("record").cast("string")
    head = F.substring_index(text, END * 2, 1)
    parts = records.withColumn("header", F.concat(head, F.lit(END))).withColumn("content", F.substring(text, F.length(head) + 5, F.length(text) - F.length(head) - 8).cast("binary"))
    h = F.col("header")
    url = _of(h, "WARC-Target-URI")
    plain = F.replace(F.replace(F.replace(url, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    digest = F.substring(_of(h, "WARC-Payload-Digest"), 6, 40)
    whole = F.octet_length("content") == _of(h, "Content-Length").cast("long")
    right = whole & ((_of(h, "WARC-Type") == "revisit") | (F.sha1("content") == digest))
    number = lambda name: F.regexp_extract(h, rf"{name}: <urn:page:(-?\d+)>", 1).try_cast("long")
    others = [c for c in records.columns if c != "record"]
    return parts.select(
        *others, number("WARC-Record-ID").alias("page_id"), F.when(_of(h, _ENCODED).isNull(), url).otherwise(plain).alias("url"), _of(h, "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        _of(h, "WARC-Date").alias("date"), F.when(right, digest).otherwise(_bad()).alias("payload_digest"), "content",
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """digest, page_id, url, record_type, refers_to, date, payload_bytes and payload_digest of each record, read from whole records.

    Of a response they are those of its content.  Of a revisit they are those of the payload under its address, whose SHA-1
    must be the one in its header.
    """
    parsed = parse_records(read_records(spark, path))
    own = parsed.filter("record_type = 'response'").select("*", F.octet_length("content").cast("long").alias("payload_bytes")).drop("content")
    stored = _stored(spark, path).select("digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    again = parsed.filter("record_type = 'revisit'").drop("content").join(stored, "digest")
    return own.unionByName(again.withColumn("payload_digest", F.when(F.col("sha1") == F.col("payload_digest"), F.col("sha1")).otherwise(_bad())).drop("sha1"))


def _write(batches, to: str, compress: bool):
    """A file for each partition, a gzip member for each record; an attempt's file takes its name at the end."""
    from pyspark import TaskContext

    system, folder = fs.FileSystem.from_uri(to[5:] if to.startswith("file:/") and not to.startswith("file://") else to)
    number, n = TaskContext.get().partitionId(), 0
    name = f"{folder}/part-{number:05d}.warc" + (".gz" if compress else "")
    own = f"{folder}/_{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as out:
        for batch in batches:
            for record in batch.column(0).to_pylist():
                out.write(gzip.compress(record, 6, mtime=0) if compress else record)
                n += 1
    system.move(own, name)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["records"])


def export_warc(spark: SparkSession, path: str, to: str, compress: bool = True) -> int:
    """Write the records as WARC files in the folder ``to``, one gzip member a record; the number of records."""
    fs.FileSystem.from_uri(to)[0].create_dir(fs.FileSystem.from_uri(to)[1])
    rows = read_records(spark, path).select("record").mapInArrow(remote(f"{_HERE}:_write", to=to, compress=compress), "records long")
    return rows.agg(F.sum("records")).first()[0] or 0


def op6(spark, sf_dir: str) -> DataFrame:
    """Archive all pages and read the records back; see :func:`write_archive` for nulls, empty and repeated rows."""
    path = f"{shared_folder(spark)}/archive/{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM m
"""
