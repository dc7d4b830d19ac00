"""Size-aware heavy-light join of word-shingle sets by Jaccard similarity, and the groups that it links.

A document's set is its distinct ``words``-word shingles (64-bit hashes).  Equal sets are one class, of which the smallest
doc_id stands for all.  With sizes n and m, similarity ``percent`` needs an overlap of c(n + m) shingles.

Light: a set of at most ``boundary`` shingles, and those it can be similar to, enumerate all their subsets of size c(n + m)
for each possible sum; a shared subset is a link, so a group needs no pairs.  Heavy: larger sets post shingles to inverted
lists, as many as a similar set can't miss all of.  The boundary is where the two costs, counted from the histogram of
sizes, have the smallest sum.

A heavy set that has as many shingles of its own (in no other document) as it would post has no similar set: its lists
could hold those alone.  One grouping finds these, over all shingles of sets up to ``FULL`` and a fixed fraction of the hash
range for larger ones; most documents need no lists then, and passages or lines that many documents share cost nothing.

Lists are scanned without pairs first: every member meets its list's first one of like size.  Groups are formed, and only
members of different groups in a list make pairs then; those not met before are tested, so no link between groups is lost.
A test compares counts by hash bucket (an upper bound of the overlap), and then the sets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ship import release, release_since, remote, stash, stashed, swept
from .text import chunks, grams, mix

_HERE = "strandspark.llm.jaccard"
#: Sets up to this size are looked at whole for shingles of their own; of larger ones, the part of the hash range that holds
#: this many times the shingles they would post.
FULL, WIDER = 256, 1.65
#: Sizes up to which the boundary is looked for, and cost of a posting (it is scanned and tested) in subset keys.
SMALL, POSTING = 32, 3


def overlap(total: int, percent: int) -> int:
    """Smallest overlap of two sets with that sum of sizes and 100 * overlap >= percent * union."""
    return -(-percent * total // (100 + percent))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _partners(n: int, percent: int) -> range:
    """Sizes m >= n that a set of n shingles can be similar to."""
    return range(n, 100 * n // percent + 1)


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size; sizes: number of sets of each size up to SMALL."""
    def cost(x: int) -> int:
        out = sum(k * prefix(n, percent) * POSTING for n, k in sizes.items() if n > x)
        for n in range(1, x + 1):
            for m in _partners(n, percent):
                c = overlap(n + m, percent)
                out += sizes.get(n, 0) * math.comb(n, c) + (sizes.get(m, 0) * math.comb(m, c) if m > n else 0)
        return out

    return min(range(SMALL + 1), key=lambda x: (cost(x), x))


def _subset_keys(s: np.ndarray, boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of sizes, hash of subset) of all subsets that a light link with this set can share."""
    n = len(s)
    sums = [n + m for m in _partners(n, percent)] if n <= boundary else []
    sums += [n + m for m in range(max(1, -(-percent * n // 100)), min(n - 1, boundary) + 1)]
    with np.errstate(over="ignore"):
        each = mix(s)
        total = each.sum(dtype=np.uint64)
        out_sums, out_keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for t in sorted(set(sums)):
            gone = n - overlap(t, percent)
            if gone < 0:
                continue
            if gone == 0:
                keys = np.array([total])
            else:
                index = np.array(list(combinations(range(n), gone)))
                keys = total - each[index].sum(axis=1, dtype=np.uint64)
            out_sums.append(np.full(len(keys), t))
            out_keys.append(mix(keys))
    return np.concatenate(out_sums), np.concatenate(out_keys)


def _sets(column, words: int):
    """(row, sorted shingle hashes) of each text."""
    for a, _, w in chunks(column, lower=True):
        g = grams(w.hash, words)
        for i in range(len(w.first) - 1):
            lo, hi = w.first[i], w.first[i + 1]
            if hi - lo >= words:
                yield a + i, np.unique(g[lo : hi - words + 1])
            elif hi > lo:
                yield a + i, mix(grams(w.hash[lo:hi], hi - lo) + np.uint64(hi - lo))
            else:
                yield a + i, np.empty(0, np.uint64)


def _classes(batches, words: int):
    """Size and digest of each text's set."""
    import xxhash

    for batch in batches:
        sets = [(len(s), xxhash.xxh3_128_digest(s.tobytes())) for _, s in _sets(batch.column(1), words)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.binary())], names=["doc_id", "n", "digest"])


class _Rows:
    """Numbers for rows of a batch, given out as batches of a bounded size."""

    #: Numbers of a column that are held before they are given out.
    HELD = 1 << 19

    def __init__(self, doc_ids: pa.Array, names: list[str]) -> None:
        self.doc_ids, self.names, self.parts, self.size = doc_ids, names, [], 0

    def add(self, row: int, *columns: np.ndarray) -> bool:
        """True once there is enough to give out."""
        self.parts.append((np.full(len(columns[0]), row), *columns))
        self.size += len(columns[0])
        return self.size >= self.HELD

    def give(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)] or [np.empty(0, np.int64)] * len(self.names)
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([self.doc_ids.take(pa.array(columns[0])), *[pa.array(c.view(np.int64)) for c in columns[1:]]], names=self.names)


def _own(batches, words: int, percent: int, boundary: int):
    """(doc_id, shingle) of heavy sets; the lowest bit tells the whole sets of small ones from the parts of large ones.

    Similar sets are both whole or both in part: sizes a little above FULL are in both.
    """
    top = np.uint64(min(1.0, WIDER * (100 - percent) / 100) * ((1 << 64) - 1))
    for batch in batches:
        rows = _Rows(batch.column(0), ["doc_id", "shingle"])
        for row, s in _sets(batch.column(1), words):
            if len(s) <= boundary:
                continue
            if len(s) <= 100 * FULL // percent and rows.add(row, s & ~np.uint64(1)):
                yield rows.give()
            if len(s) > FULL and rows.add(row, s[: np.searchsorted(s, top)] | np.uint64(1)):
                yield rows.give()
        yield rows.give()


def _signature(s: np.ndarray) -> bytes:
    """Counts of the set's hashes by their low bits, in about a quarter as many buckets as the set has members."""
    bits = min(12, max(4, math.ceil(math.log2(max(len(s), 1))) - 2))
    counts = np.bincount((s & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"w" + counts.astype("<u4").tobytes()


def _signature_counts(x: bytes) -> np.ndarray:
    return np.frombuffer(x[1:], "<u4").astype(np.int64) if len(x) % 2 else np.frombuffer(x, np.uint8).astype(np.int64)


def _light(batches, words: int, percent: int, boundary: int):
    """(doc_id, n, sum of sizes, subset key) of sets that a light set can be similar to."""
    for batch in batches:
        rows = _Rows(batch.column(0), ["doc_id", "n", "total", "key"])
        for row, s in _sets(batch.column(1), words):
            if 0 < len(s) <= 100 * boundary // percent:
                sums, keys = _subset_keys(s, boundary, percent)
                if rows.add(row, np.full(len(keys), len(s)), sums, keys):
                    yield rows.give()
        yield rows.give()


#: Rows with whole sets that are taken out of a batch at once.
SLICE = 256


def _members(batches, words: int):
    """Size, bucket counts and members of each text's set."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), SLICE):
            part = batch.slice(at, SLICE)
            sets = [s for _, s in _sets(part.column(1), words)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "signature", "members"])


def _shingles(batches):
    for batch in batches:
        for start in range(0, max(batch.num_rows, 1), SLICE):
            part = batch.slice(start, SLICE)
            sets = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
            at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], names=["doc_id", "n", "shingle"])


def _possible(batches, percent: int):
    """Pairs (a, b, signature a, size a, signature b, size b) whose bucket counts allow the similarity."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), SLICE):
            part, keep = batch.slice(at, SLICE), []
            for x, n, y, m in zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True):
                p, q = _signature_counts(x), _signature_counts(y)
                size = min(len(p), len(q))
                most = int(np.minimum(p.reshape(-1, size).sum(0), q.reshape(-1, size).sum(0)).sum())
                keep.append(100 * most >= percent * (n + m - most))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _similar(batches, percent: int):
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), SLICE):
            part, keep = batch.slice(at, SLICE), []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                o = int((both[1:] == both[:-1]).sum())
                keep.append(100 * o >= percent * (len(p) + len(q) - o))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each vertex of edges (a, b): the smallest id of its component.

    Alternating large-star and small-star steps, each a minimum by vertex and a join, until the edges stay the same.
    """
    spark = edges.sparkSession
    now = stash(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            out = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
            out.stashed_at = now.stashed_at  # the one table that it reads
            return out
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = stash(large)
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = stash(small.filter("a != b").distinct())
        release(spark, now, down)
        now = after


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar."""
    known = sets.select("doc_id", "signature", "n")
    fit = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    both = pairs.join(known.toDF("a", "sa", "na"), "a").join(known.toDF("b", "sb", "nb"), "b").filter(fit)
    likely = stash(both.select("a", "b", "sa", "na", "sb", "nb").mapInArrow(remote(f"{_HERE}:_possible", percent=percent), "a long, b long"))
    members = sets.select("doc_id", "members")
    full = likely.join(members.toDF("a", "xa"), "a").join(members.toDF("b", "xb"), "b")
    return full.select("a", "b", "xa", "xb").mapInArrow(remote(f"{_HERE}:_similar", percent=percent), "a long, b long")


def _vertices(texts: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) with the ids of ``several`` made different for different texts, and (vertex, doc_id) of the made ones.

    One text keeps the id; the others get a hash of id and text, which stands in no order to the ids.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    first = stash(texts.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(mark).alias("first")))
    marked = texts.join(first, "doc_id", "left").withColumn("mark", mark)
    made = F.col("first").isNotNull() & (F.col("mark") != F.col("first"))
    vertex = F.xxhash64("doc_id", "mark")
    named = marked.select(F.when(made, vertex).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    return named, stash(marked.filter(made).select(vertex.alias("vertex"), "doc_id").distinct())


def link(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row of (doc_id, text).

    class_id: the smallest doc_id with the same set; component_id: the smallest that links reach.  Texts without words have
    no shingles and stand alone; shorter texts than ``words`` have one, their whole sequence.  Rows of one doc_id are one
    document, of which the texts all link, whatever they say; a null doc_id is in no class and component_id is null.  Texts of
    any length are compared whole; an empty table gives none; other columns are not looked at.
    """
    with swept(docs.sparkSession):
        return _link(docs.select("doc_id", "text"), words, percent)


def _link(texts: DataFrame, words: int, percent: int) -> DataFrame:
    spark = texts.sparkSession
    sets_of = lambda rows: stash(rows.mapInArrow(remote(f"{_HERE}:_classes", words=words), "doc_id long, n long, digest binary"))
    mark = stashed()
    own, made = sets_of(texts), None
    several = own.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x != y").select("doc_id")
    if several.limit(1).count():
        texts, made = _vertices(texts, several)
        own = sets_of(texts)
    classes = own.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members")).filter("members > 1")
    classes = stash(classes.select("digest", "class_id"))
    sizes = {r["n"]: r["k"] for r in own.filter(F.col("n").between(1, SMALL)).groupBy("n").agg(F.count("*").alias("k")).collect()}
    boundary = choose_boundary(sizes, percent)
    labelled = stash(own.join(classes, "digest", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id")))
    named = texts.filter(F.col("doc_id").isNotNull())
    copies = labelled.filter("doc_id != class_id").select("doc_id", "class_id").distinct()

    def by_class(edges: DataFrame, columns: Sequence[str]) -> DataFrame:
        for c in columns:
            edges = edges.join(copies.toDF(c, "_class"), c, "left").withColumn(c, F.coalesce("_class", c)).drop("_class")
        return edges

    # light: members of either size meet the first member of the other
    light = named.mapInArrow(remote(f"{_HERE}:_light", words=words, percent=percent, boundary=boundary), "doc_id long, n long, total long, key long")
    light = stash(by_class(light, ["doc_id"]).distinct())
    ends = light.groupBy("total", "key").agg(F.min(F.when(F.col("n") * 2 <= F.col("total"), F.col("doc_id"))).alias("low"), F.min(F.when(F.col("n") * 2 >= F.col("total"), F.col("doc_id"))).alias("high"), F.count("*").alias("k")).filter("k > 1")
    met = light.join(ends, ["total", "key"])
    light_edges = met.filter("n * 2 <= total and high is not null").select(F.col("doc_id").alias("a"), F.col("high").alias("b")).unionByName(met.filter("n * 2 >= total and low is not null").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))).filter("a != b").distinct()

    # heavy: sets with few shingles of their own, by how common theirs are
    rows = named.mapInArrow(remote(f"{_HERE}:_own", words=words, percent=percent, boundary=boundary), "doc_id long, shingle long")
    alone = rows.groupBy("shingle").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x = y")
    alone = alone.groupBy(F.col("x").alias("doc_id")).agg(F.count_if(F.col("shingle").bitwiseAND(1) == 0).alias("whole"), F.count_if(F.col("shingle").bitwiseAND(1) == 1).alias("part"))
    posted = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1
    enough = ((F.col("n") > 100 * FULL // percent) | (F.coalesce("whole", F.lit(0)) >= posted)) & ((F.col("n") <= FULL) | (F.coalesce("part", F.lit(0)) >= posted))
    open_sets = stash(labelled.filter((F.col("n") > boundary) & (F.col("doc_id") == F.col("class_id"))).distinct().join(alone, "doc_id", "left").filter(~enough).select("doc_id").distinct())
    sets = stash(texts.join(open_sets, "doc_id", "left_semi").mapInArrow(remote(f"{_HERE}:_members", words=words), "doc_id long, n long, signature binary, members binary").dropDuplicates(["doc_id"]))
    every = sets.select("doc_id", "n", "members").mapInArrow(remote(f"{_HERE}:_shingles"), "doc_id long, n long, shingle long")
    common = every.groupBy("shingle").agg(F.count("*").alias("df"))
    common = common.filter("df > 1")
    # a set posts its rarest shingles; those of its own come first and make no list
    ranked = every.join(common, "shingle")
    each = ranked.groupBy("doc_id").agg(F.count("*").alias("shared"))
    order = W.partitionBy("doc_id").orderBy("df", "shingle")
    posts = ranked.join(each, "doc_id").filter(F.col("n") - F.col("shared") < posted).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= posted - (F.col("n") - F.col("shared")))
    # what a set has from this shingle on: all that it can share with one that has none of its rarer shingles
    members = stash(posts.select("doc_id", "n", (F.col("shared") - F.col("place") + 1).alias("ahead"), "shingle"))
    band = F.floor(F.log("n") / math.log(100 / percent))
    heads = stash(members.groupBy("shingle", band.alias("band")).agg(F.min("doc_id").alias("head"), F.count("*").alias("k")))  # apart from the joins, so that these can be split
    in_band = members.withColumn("band", band).join(heads.filter("k > 1"), ["shingle", "band"]).select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    next_band = heads.select("shingle", F.col("head").alias("a"), F.col("band")).join(heads.select("shingle", F.col("head").alias("b"), (F.col("band") + 1).alias("band")), ["shingle", "band"]).select("a", "b")
    ordered = lambda e: e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tried = stash(ordered(in_band.unionByName(next_band)))
    edges = _verified(tried, sets, percent).unionByName(light_edges)
    if made is not None:
        edges = edges.unionByName(ordered(by_class(made.toDF("a", "b"), ["a", "b"])))
    edges = stash(edges)
    groups = stash(components(edges))

    # what is left: members of different groups
    placed = stash(members.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    mixed = stash(placed.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("shingle"))
    rest = placed.join(mixed, "shingle")
    side = lambda x: rest.select("shingle", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("ahead").alias(f"s{x}"), F.col("component").alias(f"c{x}"))
    # in the first list, by rarity, that two sets share, what either has ahead bounds their overlap; other lists may miss them
    enough_ahead = F.least("sa", "sb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    cross = side("a").join(side("b"), "shingle").filter((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent) & enough_ahead)
    left = stash(cross.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    more = _verified(left, sets, percent)
    final = components(edges.unionByName(more))
    release_since(spark, mark, labelled, final, *([made] if made is not None else []))  # all else is read already
    out = labelled.join(final.toDF("class_id", "_component"), "class_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("_component", "class_id").alias("component_id"))
    if made is not None:
        out = stash(out.join(made.toDF("doc_id", "_id"), "doc_id", "left").withColumn("doc_id", F.coalesce("_id", "doc_id")).drop("_id"))
        for c in ("class_id", "component_id"):
            out = out.join(out.groupBy(c).agg(F.min("doc_id").alias("_least")), c, "left").withColumn(c, F.col("_least")).drop("_least")
    return out.select("doc_id", "n_shingles", "class_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest doc_id of each group, with all their columns, of any names; rows without id stay."""
    later = link(docs, words, percent).filter("doc_id != component_id").select("doc_id").distinct()
    return docs.select(F.struct("*").alias("row"), "doc_id").join(later, "doc_id", "left_anti").select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents; see :func:`link` for nulls, empty and repeated rows."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85).select("doc_id", "n_shingles", "component_id", "class_id")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * k >= 85 * (n + m - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
q AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN len(g) = 0 THEN CAST(doc_id AS VARCHAR) ELSE array_to_string(list_sort(g), chr(1)) END) AS class_id FROM s)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.b, s.doc_id)) AS component_id, q.class_id
FROM s LEFT JOIN c ON c.a = s.doc_id JOIN q ON q.doc_id = s.doc_id
"""
