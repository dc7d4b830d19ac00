"""Substring deduplication by seed and extend.

A window is ``WINDOW`` consecutive words.  Each window selects the smallest of its ``SEED``-word hashes (its leftmost), so
equal windows select equal seeds at the same place: the seeds are winnowed anchors.  Consecutive windows of a text that
select the same anchor form its stretch, from which the anchor is extended both ways:

1. Anchors of all documents are joined; an anchor of one document only is no repeat.
2. Occurrences whose whole stretches are equal (one hash) form a class.  In all but its first document every window of the
   stretch repeats.
3. Where an anchor has several classes, each class's first document compares its stretch window by window with the others':
   this finds how far a shared passage goes where it ends inside a stretch.

The union of repeating windows is the maximal repeats of at least ``WINDOW`` words.  Everything that is shuffled is a few
numbers for an anchor (about one for eight words), and minima of them; no group is gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .ship import remote, stash
from .text import Words, chunks, grams, mix

_HERE = "strandspark.llm.substrings"
WINDOW, SEED = 20, 6
_R = 0x9FB21C651E98DF25
_INVERSE = pow(_R, -1, 1 << 64)
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LAST = (1 << 63) - 1


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, at least n each."""
    if len(_tables[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_R, _INVERSE)):
                _tables[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n + 1024, base, np.uint64), dtype=np.uint64)])
    return _tables


class Stretches:
    """Windows of the texts of a chunk, the anchors that they select, and hashes of windows and stretches."""

    def __init__(self, w: Words, window: int) -> None:
        n = len(w.hash)
        self.text, self.window = np.empty(0, np.int64), window
        self.start = self.of = self.first = self.last = np.empty(0, np.int64)
        self.hash = self.anchor = self.key = np.empty(0, np.uint64)
        if n < window:
            return
        seed = min(SEED, window)
        owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        self.start = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
        if not len(self.start):
            return
        g = grams(w.hash, seed)
        places = self.start + np.lib.stride_tricks.sliding_window_view(g, window - seed + 1)[self.start].argmin(axis=1)
        with np.errstate(over="ignore"):
            power, inverse = powers(n + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * power[:n], dtype=np.uint64)])
            span = lambda a, b: mix((total[b] - total[a]) * inverse[a])
            self.hash = span(self.start, self.start + window)
            new = np.ones(len(places), bool)
            new[1:] = (places[1:] != places[:-1]) | (owner[self.start[1:]] != owner[self.start[:-1]])
            self.of = np.cumsum(new) - 1
            self.first = np.flatnonzero(new)
            self.last = np.append(self.first[1:], len(places)) - 1
            a, b = self.start[self.first], self.start[self.last] + window
            self.anchor = g[places[self.first]]
            offset = (places[self.first] - a).astype(np.uint64) * np.uint64(1 << 20) + (b - a).astype(np.uint64)
            self.key = mix(span(a, b) + mix(self.anchor + offset))
        self.text = owner[self.start[self.first]]


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batch(doc_ids: pa.Array, rows: list[np.ndarray], names: list[str], *numbers: list[np.ndarray]) -> pa.RecordBatch:
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(at)), *[_as_long(np.concatenate(x) if x else np.empty(0, np.uint64)) for x in numbers]], names=names)


def _anchors(batches, window: int):
    for batch in batches:
        rows, anchors, keys = [], [], []
        for a, _, w in chunks(batch.column(1)):
            s = Stretches(w, window)
            with np.errstate(over="ignore"):
                _, once = np.unique(mix(s.key + s.text.astype(np.uint64) * np.uint64(_R)), return_index=True)
            once.sort()
            rows.append(s.text[once] + a)
            anchors.append(s.anchor[once])
            keys.append(s.key[once])
        yield _batch(batch.column(0), rows, ["doc_id", "anchor", "stretch"], anchors, keys)


def _windows(batches, window: int):
    """Window hashes of the stretches named in the third column."""
    for batch in batches:
        rows, hashes = [], []
        wanted = batch.column(2)
        offsets, values = wanted.offsets.to_numpy(), wanted.values.to_numpy(zero_copy_only=False)
        for a, b, w in chunks(batch.column(1)):
            s = Stretches(w, window)
            keys = values[offsets[a] : offsets[b]].view(np.uint64)
            use = np.isin(s.key, keys)  # a key names its whole stretch, so another text of the chunk that has it repeats it
            keep = use[s.of]
            text, h = s.text[s.of][keep], s.hash[keep]
            with np.errstate(over="ignore"):
                _, once = np.unique(mix(h + text.astype(np.uint64) * np.uint64(_R)), return_index=True)
            rows.append(text[once] + a)
            hashes.append(h[once])
        yield _batch(batch.column(0), rows, ["doc_id", "window"], hashes)


def _spans(column: pa.Array, late: list[pa.Array], window: int):
    """(first row, Words, words to remove) of each chunk; late: lists of stretch keys and of window hashes."""
    lists = [(x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False), ~x.is_null().to_numpy(zero_copy_only=False)) for x in late]
    for a, b, w in chunks(column):
        s = Stretches(w, window)
        gone = np.zeros(len(s.start), bool)
        edges = np.searchsorted(s.text, np.arange(b - a + 1))
        for i in range(b - a):
            x, y = edges[i], edges[i + 1]
            if x == y:
                continue
            lo, hi = s.first[x], s.last[y - 1] + 1
            own = s.hash[lo:hi]
            by = np.argsort(own, kind="stable")
            gone[lo + by[1:][own[by][1:] == own[by][:-1]]] = True  # all but a window's first place in the text
            for k, (offsets, values, there) in enumerate(lists):
                if there[a + i] and offsets[a + i] < offsets[a + i + 1]:
                    names = values[offsets[a + i] : offsets[a + i + 1]].view(np.uint64)
                    gone[lo:hi] |= np.isin(s.key[x:y], names)[s.of[lo:hi] - x] if k == 0 else np.isin(own, names)
        removed = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(removed, s.start[gone], 1)
        np.add.at(removed, s.start[gone] + window, -1)
        yield a, w, np.cumsum(removed[:-1]) > 0


def _kept_bytes(w: Words, i: int, removed: np.ndarray, space: bytes = b" ") -> bytes:
    lo, hi = w.first[i], w.first[i + 1]
    return space.join([w.data[a:b].tobytes() for a, b in zip(w.start[lo:hi][~removed[lo:hi]].tolist(), w.end[lo:hi][~removed[lo:hi]].tolist(), strict=True)])


def _digests(batches, window: int):
    for batch in batches:
        words, gone, digest = [], [], []
        for _, w, removed in _spans(batch.column(1), [batch.column(2), batch.column(3)], window):
            total = np.concatenate([[0], np.cumsum(removed)])
            words += np.diff(w.first).tolist()
            gone += (total[w.first[1:]] - total[w.first[:-1]]).tolist()
            digest += [hashlib.sha256(_kept_bytes(w, i, removed)).hexdigest() for i in range(len(w.first) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rewrite(batches, window: int, text_at: int, size_at: int | None):
    """Texts without the removed words; each word goes with the white space before it (the first one kept with none)."""
    for batch in batches:
        out = []
        n = batch.num_columns - 2
        for _, w, removed in _spans(batch.column(text_at), [batch.column(n), batch.column(n + 1)], window):
            total = np.concatenate([[0], np.cumsum(removed)])
            for i in range(len(w.first) - 1):
                lo, hi = w.first[i], w.first[i + 1]
                if total[lo] == total[hi]:
                    out.append(None)
                    continue
                begin = np.where(np.arange(lo, hi) > lo, w.end[np.maximum(np.arange(lo, hi) - 1, 0)], w.offsets[i])
                keep = np.flatnonzero(~removed[lo:hi])
                out.append(b"".join(w.data[begin[k] : w.end[lo + k]].tobytes() for k in keep.tolist()).lstrip(b" \t\n\x0b\x0c\r").decode("utf-8", "surrogatepass"))
        old = batch.column(text_at).to_pylist()
        new = [o if x is None else x for o, x in zip(old, out, strict=True)]
        columns = batch.columns[:n]
        columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
        if size_at is not None:
            sizes = [s if x is None else len(x) for s, x in zip(batch.column(size_at).to_pylist(), out, strict=True)]
            columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i) for i in range(n)]))


def _known_id() -> Column:
    """A null id stands after all others, at a place of its text's own, so that null ids are no group of their own."""
    return F.coalesce("doc_id", F.lit(_LAST) - F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 40)))


def _late(docs: DataFrame, window: int) -> DataFrame:
    """id, stretches, windows: lists of those that begin in a document with a smaller id."""
    texts = docs.select(_known_id().alias("doc_id"), "text")
    anchors = stash(texts.mapInArrow(remote(f"{_HERE}:_anchors", window=window), "doc_id long, anchor long, stretch long"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("anchor", "least")
    seeds = stash(anchors.join(shared, "anchor"))
    # written apart from the joins, so that these can be split where an anchor has very many classes
    classes = stash(seeds.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("first")))
    several = stash(classes.groupBy("anchor").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b")).filter("a != b").select("anchor"))
    later = seeds.join(classes, ["anchor", "stretch"]).filter("doc_id > first").select("doc_id", "stretch")
    open_ends = classes.join(several, "anchor").groupBy(F.col("first").alias("doc_id")).agg(F.collect_set("stretch").alias("stretches"))
    windows = stash(texts.join(open_ends, "doc_id").select("doc_id", "text", "stretches").mapInArrow(remote(f"{_HERE}:_windows", window=window), "doc_id long, window long"))
    earliest = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("window", "least")
    late_windows = windows.join(earliest, "window").filter("doc_id > least").select("doc_id", "window")
    none = F.lit(None).cast("long")
    both = later.select("doc_id", "stretch", none.alias("window")).unionByName(late_windows.select("doc_id", none.alias("stretch"), "window"))
    return both.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("stretch").alias("stretches"), F.collect_set("window").alias("windows"))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of (doc_id, text).

    A word goes if it is in a window whose words also begin earlier: in a document with a smaller id, or earlier in the same
    one.  Windows are those of the input.  Null texts have no words; rows of one id are one document's parts, of which none
    is earlier; rows without id come after all others, in the order of a hash of their texts.  Texts of any length are
    compared whole, windows by 64-bit hashes.  An empty table gives none; other columns are not looked at.
    """
    both = docs.select("doc_id", "text", _known_id().alias("id")).join(_late(docs, window), "id", "left")
    return both.select("doc_id", "text", "stretches", "windows").mapInArrow(remote(f"{_HERE}:_digests", window=window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages cut from their texts (n_chars follows); all rows and columns stay, of any names.

    What goes, and what nulls and repeated rows mean, is as for :func:`digests`.
    """
    names = docs.columns
    parts = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(names)]
    both = docs.select(*parts, _known_id().alias("id")).join(_late(docs, window), "id", "left").select(*[f"c{i}" for i in range(len(names))], "stretches", "windows")
    size_at = names.index("n_chars") if "n_chars" in names else None
    schema = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema)])
    return both.mapInArrow(remote(f"{_HERE}:_rewrite", window=window, text_at=names.index("text"), size_at=size_at), schema).toDF(*names)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document; see :func:`digests` for nulls, empty and repeated rows."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r),
k AS (SELECT d.doc_id, len(d.w) AS n, u.i, d.w[u.i] AS word, g.i IS NOT NULL AS gone
      FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS i) u LEFT JOIN g ON g.doc_id = d.doc_id AND g.i = u.i)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id) x USING (doc_id)
"""
