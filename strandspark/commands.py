"""Named commands over files of reads: options, and what they run.  ``python -m strandspark.commands NAME ...``.

A command is a function of (session, options) that yields lines for standard output; what it writes goes to ``--out``.
Options that steer threads and temporary files of a single process (``nothreads``, ``nosplit``, ``n``) are taken and have no
effect on results; ``threads`` and ``tmpdir`` set up a local session.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import workflow
from .functions import columns as C
from .functions.genotype import flat_prior, prior_from_table
from .operators import dedup, realign, repeats, reports, stats, view
from .sources import fasta, files, sam
from .sources.files import ReadSet

NAME, VERSION = "strandspark", "0.2"
STDOUT = "stdout"
Command = Callable[[SparkSession, argparse.Namespace], Iterator[str]]
#: Commands by name, with their help and the function that adds their options: a new one is registered here.
COMMANDS: dict[str, tuple[Command, str, Callable[[argparse.ArgumentParser], None]]] = {}


def command(name: str, text: str, *options: tuple):
    """Register a command; an option is (flags..., settings)."""

    def add(run: Command) -> Command:
        def configure(parser: argparse.ArgumentParser) -> None:
            for *flags, settings in options:
                parser.add_argument(*flags, **settings)

        COMMANDS[name] = (run, text, configure)
        return run

    return add


_OUT = ("--out", "-o", {"default": STDOUT, "help": "output; omit for stdout"})
_REGION = ("--region", "-r", {"help": "chr, chr:a or chr:a..b"})
_MAPQ = ("--mapq", "-q", {"type": int, "help": "least mapping quality"})
_REFERENCE = ("--reference", "-R", {"required": True, "help": "FASTA file"})
_INTERVALS = ("--intervals", "-L", {"required": True, "help": "list of intervals"})


def _load(spark: SparkSession, o: argparse.Namespace) -> ReadSet:
    found = files.load(spark, o.files, o.tmpdir)
    return files.merged(found, len(o.files))


def _with_program(found: ReadSet, o: argparse.Namespace) -> ReadSet:
    return found if o.nopg else ReadSet(found.reads, found.header.with_program(NAME, VERSION, o.line))


def _put(found: ReadSet, o: argparse.Namespace, default: str = "bam") -> Iterator[str]:
    """Write to ``--out``; SAM or FASTQ lines where that is standard output."""
    if o.out != STDOUT:
        files.save(_with_program(found, o), o.out, o.format, o.compression)
        return
    if (o.format or default) == "fastq":
        for r in view.fastq_lines(found.reads).toLocalIterator():
            yield r["record"]
        return
    if (o.format or "sam") != "sam":
        raise ValueError(f"{o.format} goes to a file: give --out")
    yield from _with_program(found, o).header.text().splitlines()
    for r in sam.sam_lines(found.reads, found.header).toLocalIterator():
        yield r["value"]


def _filtered(found: ReadSet, o: argparse.Namespace, **more) -> ReadSet:
    region = C.parse_region(o.region, found.header.lookup) if o.region else None
    return found.map(lambda r: view.filter_reads(r, region=region, mapq=o.mapq, **more))


@command("view", "filter, trim and copy reads", _OUT, _REGION, _MAPQ, ("--count", "-n", {"type": int}), ("--length", "-l", {}), ("--trimbegin", "-B", {"type": int, "default": 0}), ("--trimend", "-E", {"type": int, "default": 0}))
def view_command(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    kind = o.format or (files.format_of(o.out) if o.out != STDOUT else None)
    if (o.trimbegin or o.trimend) and kind != "fastq":
        raise ValueError("reads are trimmed for FASTQ only")
    found = _filtered(_load(spark, o), o, length=o.length, trim=(o.trimbegin, o.trimend))
    if o.count is not None:
        found = found.map(lambda r: view.limit_reads(r, o.count, ["idx"]))
    yield from _put(found, o, "sam")


@command("count", "number of reads")
def count_command(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    yield str(files.load(spark, o.files, o.tmpdir).reads.count())


@command("stats", "counts of flags, lengths and insert sizes", ("--inserts", "-I", {"action": "store_true"}), ("--lengths", "-L", {"action": "store_true"}))
def stats_command(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    found = files.load(spark, o.files, o.tmpdir)
    yield from reports.stats_report(found.reads, o.lengths, o.inserts)


@command("coverage", "coverage of bins", _OUT, ("--verifymapping", "-V", {"action": "store_true"}), ("--omituncoveredbases", {"action": "store_true"}), ("--binsize", "-b", "-B", {"type": int, "default": 100}), ("--strict", "-S", {"action": "store_true"}))
def coverage_command(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    found = files.load(spark, o.files, o.tmpdir)
    yield from reports.mean_coverage_lines(stats.mean_coverage(stats.coverage_bins(found.reads, o.binsize), found.sequences))
    table = reports.coverage_table(found.reads, found.sequences, o.binsize, o.verifymapping, o.strict, not o.omituncoveredbases)
    if o.out != STDOUT:
        reports.write_coverage(table, o.out)
        return
    for r in reports.coverage_lines(table).toLocalIterator():
        yield r["value"]


@command("compare", "what files add to and lack of the first one", ("--region", "-r", {"action": "append", "default": []}), ("--print", "-p", {"action": "store_true", "dest": "show"}))
def compare_command(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    if len(o.files) < 2:
        raise ValueError("two files are needed at least")
    first = files.load(spark, o.files[:1])
    width = max(map(len, o.region), default=0)
    for path in o.files[1:]:
        other = files.load(spark, [path])
        if len(o.files) > 2:
            yield f"{path}:"
        for name in o.region or [""]:
            region = C.parse_region(name, first.header.lookup) if name else None
            a, b = stats.compared(first.reads, region), stats.compared(other.reads, region)
            if o.show:
                yield from reports.change_lines(a, b, first.header.names)
            row = stats.compare_counts(a, b).first()
            line = reports.compare_line(name, row["added"], row["removed"], width)
            if line:
                yield line


def _deduplicated(found: ReadSet, remove: bool) -> ReadSet:
    """Marks by the sum of good base qualities, over all chromosomes at once."""
    reads = found.reads.withColumns({"rg": C.tag("RG"), "score": C.quality_sum()})
    marked = dedup.mark_duplicates(reads, found.read_groups, remove=remove)
    return ReadSet(marked.select(*found.reads.columns), found.header)


@command("dedup", "mark or remove duplicates", _OUT, ("--remove", "-r", "-R", "--removeduplicates", {"action": "store_true"}))
def dedup_command(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    found = _deduplicated(_load(spark, o), o.remove)
    yield from _put(found.map(lambda r: r.orderBy("idx")), o)


@command(
    "mergesort", "merge, filter and sort files, and mark duplicates", _OUT, _REGION, _MAPQ, ("--byname", "-b", {"action": "store_true"}), ("-n", {"type": int, "default": 500_000}),
    ("--compresstempfiles", "-C", {"action": "store_true"}), ("--markduplicates", "-M", {"action": "store_true"}), ("--removeduplicates", "-R", {"action": "store_true"}),
)
def mergesort_command(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    found = _filtered(files.load(spark, o.files, o.tmpdir), o)
    if o.markduplicates or o.removeduplicates:
        found = _deduplicated(found, o.removeduplicates)
    found = found.map(lambda r: view.sort_reads(r, "name" if o.byname else "position", ["idx"]))
    yield from _put(ReadSet(found.reads, found.header.sorted_by("queryname" if o.byname else "coordinate")), o)


@command("localrealign", "realign reads around gaps", _OUT, _REFERENCE, _INTERVALS)
def localrealign_command(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    found = _load(spark, o)
    intervals = fasta.read_intervals(spark, o.intervals, found.header).select("ref_id", "start", "stop")
    reference = fasta.read_fasta(spark, o.reference, found.header)
    reads = found.reads.withColumn("rg", F.coalesce(C.tag("RG"), F.lit("")))
    done = realign.realigned(reads, intervals, reference, found.sequences).select(*found.reads.columns)
    yield from _put(ReadSet(done, found.header.sorted_by("coordinate")), o)


@command(
    "repeatseq", "genotype repeat loci", _REFERENCE, _INTERVALS, ("--length", "-l", {"help": "LENGTH or MIN:MAX"}), ("--before", "-B", {"type": int, "default": 3}), ("--after", "-A", {"type": int, "default": 3}),
    ("--quality", "-Q", {"type": int, "default": 0}), ("--multi", "-M", {"action": "store_true"}), ("--properlypaired", "-P", {"action": "store_true"}), ("--haploid", "-H", {"action": "store_true"}),
    ("--repeatseq", {"action": "store_true"}), ("--calls", {"action": "store_true"}), ("--tag", {"default": ""}), ("--flank", {"type": int, "default": repeats.FLANK}), ("--outfile", {}),
    ("--priors", {"help": "rows of unit class, length class, quality class, right, wrong"}),
)
def repeatseq_command(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    found = files.load(spark, o.files, o.tmpdir)
    reference = fasta.read_fasta(spark, o.reference, found.header)
    for r in fasta.skipped_regions(spark, o.intervals).toLocalIterator():
        yield r["message"]
    at = repeats.loci(fasta.read_repeat_regions(spark, o.intervals), reference, found.sequences, o.flank)
    low, _, high = (o.length or "0:1073741824").partition(":")
    prior = flat_prior
    if o.priors:
        with open(o.priors) as f:
            prior = prior_from_table([line.split() for line in f if line.strip()])
    called = repeats.genotypes(found.reads, at, o.flank, o.haploid, prior, length=(int(low), int(high or low)), left=o.before, right=o.after, mapq=o.quality, unique=o.multi, proper=o.properlypaired)
    base = o.outfile or (o.files or [files.STDIN])[0].rsplit("/", 1)[-1]
    repeats.write_genotypes(called, base + o.tag, o.repeatseq, o.calls)


@command("history", "the programs in the header")
def history_command(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    for p in files.load(spark, o.files, o.tmpdir).header.programs:
        yield p.get("CL") or p["ID"]


@command("execute", "run a workflow script", ("--test", {"action": "store_true"}), ("--print", {"action": "store_true", "dest": "show"}), ("--print_execution", "-x", {"action": "store_true"}), ("--define", "-p", {"action": "append", "default": []}))
def execute_command(spark: SparkSession | None, o: argparse.Namespace) -> Iterator[str]:
    if len(o.files) not in (1, 2):
        raise ValueError("one workflow script is needed, and at most one input")
    plan = workflow.load(o.files[0]).plan(o.files[1] if len(o.files) > 1 else None, workflow.definitions(o.define))
    if o.show or o.print_execution:
        yield plan.text()
    elif not o.test and not plan.run():
        raise ValueError(f"{o.files[0]} failed")


@command("version", "the version")
def version_command(spark: SparkSession | None, o: argparse.Namespace) -> Iterator[str]:
    yield f"{NAME} {VERSION}"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog=NAME)
    kinds = top.add_subparsers(dest="command", required=True)
    for name, (_, text, configure) in COMMANDS.items():
        p = kinds.add_parser(name, help=text, conflict_handler="resolve")
        p.add_argument("files", nargs="*")
        p.add_argument("--in", "-i", dest="more", action="append", default=[])
        p.add_argument("--format", "-F")
        p.add_argument("--compression", "-c", type=int, default=6, choices=range(10))
        p.add_argument("--nopg", action="store_true")
        p.add_argument("--verbose", "-v", action="store_true")
        p.add_argument("--threads", "-t", type=int)
        p.add_argument("--nothreads", "-d", action="store_true")
        p.add_argument("--tmpdir", "-T")
        p.add_argument("--nosplit", action="store_true")
        configure(p)
    kinds.add_parser("help", help="this text")
    return top


def session(o: argparse.Namespace) -> SparkSession:
    """The active session, or a local one of as many threads as asked for."""
    found = SparkSession.getActiveSession()
    if found:
        return found
    builder = SparkSession.builder.appName(NAME).config("spark.sql.session.timeZone", "UTC")
    if o.threads or o.nothreads:
        builder = builder.master(f"local[{1 if o.nothreads else o.threads}]")
    if o.tmpdir:
        builder = builder.config("spark.local.dir", o.tmpdir)
    return builder.getOrCreate()


def run(arguments: list[str], spark: SparkSession | None = None) -> Iterator[str]:
    """The lines that a command gives for standard output."""
    o = parser().parse_args(arguments)
    if o.command == "help":
        yield from parser().format_help().splitlines()
        return
    o.files, o.line = o.more + o.files, " ".join([NAME, *arguments])
    began = time.time()
    needs = None if o.command in ("execute", "version") else spark or session(o)
    yield from COMMANDS[o.command][0](needs, o)
    if o.verbose:
        print(f"{o.command}: {time.time() - began:.1f} s", file=sys.stderr)


def main() -> int:
    try:
        for line in run(sys.argv[1:]):
            print(line)
    except (ValueError, OSError) as error:
        print(f"{NAME}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
