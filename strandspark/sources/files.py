"""Reads and their header together, loaded from and saved to any of the formats."""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import view
from . import bam, fasta, sam
from .header import Header

#: Endings of file names, the longer ones first, and the formats they stand for.
SUFFIXES = (("rawbam", "rawbam"), ("bamraw", "rawbam"), ("fastq", "fastq"), ("cram", "cram"), ("bam", "bam"), ("sam", "sam"))
STDIN = "stdin"


@dataclass(frozen=True)
class ReadSet:
    """Reads and the header that they belong to; operators give a new one."""

    reads: DataFrame
    header: Header

    def map(self, f) -> ReadSet:
        return replace(self, reads=f(self.reads))

    @property
    def sequences(self) -> DataFrame:
        return fasta.sequences(self.reads.sparkSession, self.header)

    @property
    def read_groups(self) -> DataFrame:
        """(rg, library) of the header's read groups that name one."""
        rows = [(g["ID"], g["LB"]) for g in self.header.read_groups if "LB" in g]
        return self.reads.sparkSession.createDataFrame(rows, "rg string, library string")


def format_of(name: str) -> str | None:
    """The format that a file name's ending stands for, whatever its case."""
    return next((f for suffix, f in SUFFIXES if name.lower().endswith(suffix)), None)


def spool_stdin(folder: str | None = None) -> str:
    """Standard input as a file: formats are told by their first bytes, and ranges of them are read."""
    number, path = tempfile.mkstemp(prefix="reads-", dir=folder)
    with os.fdopen(number, "wb") as out:
        while data := sys.stdin.buffer.read(1 << 20):
            out.write(data)
    return path


def load(spark: SparkSession, paths: Sequence[str], folder: str | None = None) -> ReadSet:
    """The reads of all files, told apart by their first bytes; without paths, those of standard input.

    ``idx`` follows the order of files and of their reads.  The header is the first file's; other dictionaries are refused.
    """
    paths = [spool_stdin(folder) if p == STDIN else p for p in (paths or [STDIN])]
    kinds = [bam.sniff(p) for p in paths]
    groups: list[tuple[bool, list[str]]] = []
    for path, kind in zip(paths, kinds, strict=True):
        text = kind == "sam"
        if groups and groups[-1][0] == text and not text:
            groups[-1][1].append(path)
        else:
            groups.append((text, [path]))
    if len(groups) > 60:
        raise ValueError("more than 60 SAM files at once")
    sets = [sam.read_sam(spark, own[0]) if text else bam.read_bam(spark, own) for text, own in groups]
    first = sets[0][1]
    for _, header in sets[1:]:
        if not first.same_dictionary(header):
            raise ValueError("the files have different sequences")
    if len(sets) == 1:
        return ReadSet(*sets[0])
    return ReadSet(view.merge(*[r.withColumn("idx", F.col("idx") + (k << 57)) for k, (r, _) in enumerate(sets)]), first)


def merged(found: ReadSet, files: int) -> ReadSet:
    """Several sorted files are one sorted stream."""
    return found.map(lambda r: view.sort_reads(r, rest=["idx"])) if files > 1 else found


def save(found: ReadSet, path: str, kind: str | None = None, level: int = 6, ordered: Sequence[str] = ("idx",)) -> None:
    """Write in the named format, or in that of the path's ending (BAM if it has none), as parts in the reads' order.

    Fastq takes pairs apart, as :func:`strandspark.sources.fasta.write_fastq` says.
    """
    kind = kind or format_of(path) or "bam"
    if kind == "sam":
        sam.write_sam(found.reads, found.header, path)
    elif kind in ("bam", "rawbam"):
        bam.write_bam(found.reads, found.header, path, raw=kind == "rawbam", level=level)
    elif kind == "fastq":
        fasta.write_fastq(*view.fastq_split(found.reads, list(ordered)), path.removesuffix(".fastq"))
    else:
        raise ValueError(f"cannot write {kind}")
