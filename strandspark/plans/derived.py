"""A reads relation derived from ``lineitem`` by integer arithmetic, with its dictionary, read groups and intervals."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows equal on these columns are interchangeable; the table has no key.
ORDER = ["ref_id", "pos", "flag", "score", "l_linenumber", "l_partkey", "l_suppkey", "name"]
SEQUENCES = {f"chr{i + 1}": (i, 1100) for i in range(5)}
READ_GROUPS = {"rg0": "libA", "rg1": "libB"}

_FLAG = [
    ("l_linenumber <= 5", 1), ("l_linenumber <= 5 AND l_returnflag = 'N'", 2), ("l_discount = 0.0", 4), ("l_linenumber <= 5 AND l_tax = 0.0", 8),
    ("l_linestatus = 'O'", 16), ("l_linenumber IN (1, 3, 5)", 64), ("l_linenumber IN (2, 4)", 128), ("l_quantity = 50", 256), ("l_quantity = 49", 512), ("l_quantity = 48", 1024),
]
COLUMNS = {
    "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey",
    "name": "concat('q', CAST(l_orderkey AS VARCHAR(20)))",
    "rg": "concat('rg', CAST(l_suppkey % 3 AS VARCHAR(5)))",
    "ref_id": "CAST(CASE WHEN l_discount = 0.0 AND l_tax = 0.0 THEN -1 ELSE l_suppkey % 5 END AS INT)",
    "pos": "CAST((l_partkey % 40) * 25 AS INT)",
    "mapq": "CAST(l_quantity AS INT)",
    "read_len": "CAST(30 + l_partkey % 71 AS INT)",
    "score": "CAST(FLOOR(l_extendedprice) AS BIGINT)",
    "insert_size": "CAST(FLOOR(l_extendedprice) AS BIGINT) % 1000 - 500",
    "flag": " + ".join(f"(CASE WHEN {c} THEN {v} ELSE 0 END)" for c, v in _FLAG),
    "orderkey": "l_orderkey",
}
_CIGAR = """CASE l_linenumber % 4 WHEN 0 THEN concat(CAST(read_len AS VARCHAR(10)), 'M')
 WHEN 1 THEN concat('3S', CAST(read_len - 3 AS VARCHAR(10)), 'M') WHEN 2 THEN concat('10M2D', CAST(read_len - 10 AS VARCHAR(10)), 'M')
 ELSE concat('12M1I', CAST(read_len - 17 AS VARCHAR(10)), 'M4S') END"""
_SEQ = "substr(translate(repeat(md5(concat(CAST(orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(5)))), 4), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, read_len)"
_QUAL = "substr(translate(repeat(md5(CAST(l_partkey AS VARCHAR(20))), 4), '0123456789abcdef', '#%(+.0369<?ABDFI'), 1, read_len)"

#: The relation as a subquery for DuckDB.
SQL = f"(SELECT t.*, {_CIGAR} AS cigar, {_SEQ} AS seq, {_QUAL} AS qual FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in COLUMNS.items())} FROM lineitem) t)"


#: The same for Spark: letters are translated once, then repeated, which gives the same text for a quarter of the work.
_REPEATED = re.compile(r"translate\(repeat\((.*), 4\), ('[^']*', '[^']*')\)")
_SPARK_SEQ, _SPARK_QUAL = (_REPEATED.sub(r"repeat(translate(\1, \2), 4)", x) for x in (_SEQ, _QUAL))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lineitem.select(*[F.expr(v).alias(k) for k, v in COLUMNS.items()]).select("*", F.expr(_CIGAR).alias("cigar"), F.expr(_SPARK_SEQ).alias("seq"), F.expr(_SPARK_QUAL).alias("qual"))


def sequences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, size) for n, (i, size) in SEQUENCES.items()], "ref_id int, ref_name string, length int")


def read_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(READ_GROUPS.items()), "rg string, library string")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, start, stop), closed."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.expr("CAST(p_partkey % 5 AS INT)").alias("ref_id"), F.expr("CAST((p_partkey % 20) * 50 AS INT)").alias("start"), F.expr("CAST((p_partkey % 20) * 50 + 30 AS INT)").alias("stop")).distinct()


INTERVALS_SQL = "(SELECT DISTINCT CAST(p_partkey % 5 AS INT) AS ref_id, CAST((p_partkey % 20) * 50 AS INT) AS start, CAST((p_partkey % 20) * 50 + 30 AS INT) AS stop FROM part)"


#: Bases of the derived reference: one row of (ref_id, start, bases) for each sequence, as Spark and DuckDB say it.
_BLOCK = "md5(concat('ref', CAST(ref_id AS VARCHAR(3)), '-', CAST(k AS VARCHAR(3))))"
_TO_BASES = "'0123456789abcdef', 'ACGTACGTACGTACGT'"


def reference(spark: SparkSession) -> DataFrame:
    """(ref_id, start, bases) of the derived reference; the sequences are shorter than a chunk."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(34)), lambda k: F.md5(F.concat(F.lit("ref"), F.col("ref_id").cast("string"), F.lit("-"), k.cast("string")).cast("binary")))
    text = F.translate(F.array_join(blocks, ""), "0123456789abcdef", "ACGTACGTACGTACGT")
    return sequences(spark).select("ref_id", F.lit(0).alias("start"), F.substring(text, F.lit(1), F.col("length")).alias("bases"))


REFERENCE_SQL = (
    "(SELECT ref_id, substr(translate(string_agg(" + _BLOCK + ", '' ORDER BY k), " + _TO_BASES + "), 1, 1100) AS ref FROM (SELECT unnest(range(0, 5)) AS ref_id), (SELECT unnest(range(0, 35)) AS k) GROUP BY ref_id)"
)
