"""Benchmark decontamination by greedy string tiling over a join of seeds.

Words are runs of letters and digits (A-Z count as a-z; signs of Unicode part words too).  Documents meet benchmark items by a join on the hashes of ``LEAST`` words
(seeds).  Of each pair that can reach the coverage, the longest common run of words not marked yet is marked, again and
again, until no run of ``LEAST`` words is left; runs are found by running Karp-Rabin hashes.  The share of an item's words
under such tiles is its coverage, whatever their order in the document.

1. A Bloom filter of the benchmark's seeds, of bounded size, leaves few words of few documents: runs under possible seeds.
   Equal texts count once from here on.
2. A tile of LEAST words has one seed and a longer one more, so a document that covers C words of an item has at least
   C / LEAST of its seed places.  Each item keeps its rarest seeds, as many as such a document can't miss all of, and the
   join is on these: a phrase that very many documents share makes no pairs unless an item has little else.
3. Pairs are tiled, each from the few words left of the document and the item's.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ship import remote, stash
from .substrings import powers
from .text import chunks, grams, mix

_HERE = "strandspark.llm.contamination"
#: Words of a tile at least, and the coverage from which an item has leaked.
LEAST, COVERAGE = 4, 0.5
#: Bits of the filter for each seed of the benchmark, and its least and largest size as a power of two (32 MB).
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 16, 16, 28


class _Sequence:
    """A sequence of word hashes with its unmarked places, and the hashes of its runs of any length."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.words, self.free = words, np.ones(n, bool)
        power, self.inverse = powers(n + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)])

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the unmarked runs of that length, and their hashes."""
        n = len(self.words) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        count = np.concatenate([[0], np.cumsum(self.free)])
        start = np.flatnonzero(count[length:] - count[:n] == length)
        with np.errstate(over="ignore"):
            return start, mix((self.total[start + length] - self.total[start]) * self.inverse[start])


def tiles(test: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in test, start in text, length) of the greedy tiling of two sequences of word hashes, in the order of marking.

    The longest common run of unmarked words is marked first, of several the one with the smallest start in test, then in
    text.  Its length is found by bisection (a common run holds shorter ones), and all of one length are marked in one pass:
    the cost is a few sorts of both sequences for each length that a tile has, also where one word repeats.
    """
    a, b = _Sequence(test), _Sequence(text)
    out: list[tuple[int, int, int]] = []
    most = min(len(test), len(text))
    while most >= least and a.free.sum() >= least:
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if np.isin(a.runs(middle)[1], b.runs(middle)[1]).any() else (low, middle - 1)
        if low < least:
            break
        n = low
        starts, own = a.runs(n)
        others, hashes = b.runs(n)
        both = np.intersect1d(own, hashes)
        use, at = np.isin(own, both), np.isin(hashes, both)
        waiting: dict[int, list[int]] = {}
        for j, h in zip(others[at][::-1].tolist(), hashes[at][::-1].tolist(), strict=True):
            waiting.setdefault(h, []).append(j)  # the smallest start comes last
        behind = 0
        for i, h in zip(starts[use].tolist(), own[use].tolist(), strict=True):
            if i < behind:
                continue
            places = waiting[h]
            while places:
                j = places.pop()  # a place is marked now, or overlaps a run marked before and is never free again
                if b.free[j] and b.free[j + n - 1] and np.array_equal(test[i : i + n], text[j : j + n]):
                    a.free[i : i + n] = b.free[j : j + n] = False
                    out.append((i, j, n))
                    behind = i + n
                    break
        most = n - 1
    return out


def _items(batches):
    """item_id, number of words and word hashes of items."""
    for batch in batches:
        n, words = [], []
        for _, _, w in chunks(batch.column(1), plain=True):
            own = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(w.first) - 1)]
            n += [len(x) for x in own]
            words += [x.tobytes() for x in own]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(words, pa.binary())], names=["item_id", "n", "words"])


def _seeds(words: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    g = grams(words, LEAST)
    if places is None or not len(g):
        return g
    gaps = np.concatenate([[0], np.cumsum(places < 0)])
    return g[gaps[LEAST:] == gaps[: len(g)]]


def _item_seeds(batches):
    """item, seed and how many places of the item have it."""
    for batch in batches:
        found = [np.unique(_seeds(np.frombuffer(x, np.uint64)), return_counts=True) for x in batch.column(1).to_pylist()]
        at = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
        seeds = np.concatenate([s for s, _ in found]) if found else np.empty(0, np.uint64)
        times = np.concatenate([c for _, c in found]) if found else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(seeds.view(np.int64)), pa.array(times, pa.int64())], names=["item", "seed", "times"])


def _bits(seeds: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    last = np.uint64((1 << power) - 1)
    return seeds & last, (seeds >> np.uint64(32)) & last


def _hits(batches, bitmap: np.ndarray, power: int):
    """doc_id, k, l, words, places of texts with possible seeds: the words under them, runs parted by a word of its own kind."""
    names = ["doc_id", "k", "l", "words", "places"]
    six, low = np.uint64(6), np.uint64(63)
    for batch in batches:
        rows, words, places = [], [], []
        for a, _, w in chunks(batch.column(3), plain=True):
            g = grams(w.hash, LEAST)
            if not len(g):
                continue
            here = np.ones(len(g), bool)
            for bit in _bits(g, power):
                here &= ((bitmap[(bit >> six).astype(np.int64)] >> (bit & low)) & np.uint64(1)).astype(bool)
            hit = np.flatnonzero(here)
            text = np.searchsorted(w.first, hit, side="right") - 1
            inside = hit + LEAST <= w.first[text + 1]
            hit, text = hit[inside], text[inside]
            edges = np.flatnonzero(np.diff(text)) + 1
            for own in np.split(hit, edges) if len(hit) else []:
                i = int(np.searchsorted(w.first, own[0], side="right") - 1)
                under = np.unique((own[:, None] + np.arange(LEAST)).ravel())
                cuts = np.flatnonzero(np.diff(under) > 1) + 1
                at = np.insert((under - w.first[i]).astype(np.int32), cuts, -1)
                some = np.insert(w.hash[under], cuts, np.arange(1, len(cuts) + 1, dtype=np.uint64))  # no word hashes to so small a number
                rows.append(a + i)
                words.append(some.tobytes())
                places.append(at.tobytes())
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(words, pa.binary()), pa.array(places, pa.binary())], names=names)


def _text_seeds(batches):
    """k, l and the distinct seeds of each text's runs."""
    for batch in batches:
        found = [np.unique(_seeds(np.frombuffer(x, np.uint64), np.frombuffer(p, np.int32))) for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        at = pa.array(np.repeat(np.arange(len(found)), [len(s) for s in found]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((np.concatenate(found) if found else np.empty(0, np.uint64)).view(np.int64))], names=["k", "l", "seed"])


_TILED = "k long, l long, item long, test_words int, covered_words int, coverage double, tiles array<struct<test_start:int,text_start:int,length:int>>"
_TILE = pa.list_(pa.struct([("test_start", pa.int32()), ("text_start", pa.int32()), ("length", pa.int32())]))


def _tile(batches, coverage: float):
    """(k, l, item, item's words, text's words, places) -> _TILED for pairs with that coverage."""
    for batch in batches:
        rows, sizes, covered, found = [], [], [], []
        for row, (test, text, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
            test, text, places = np.frombuffer(test, np.uint64), np.frombuffer(text, np.uint64), np.frombuffer(places, np.int32)
            shared = np.flatnonzero(np.isin(grams(test, LEAST), grams(text, LEAST)))
            if len(np.unique((shared[:, None] + np.arange(LEAST)).ravel())) < coverage * len(test):
                continue
            known = np.isin(grams(text, LEAST), grams(test, LEAST))  # the words under seeds of other items only can't be in a tile
            under = np.unique((np.flatnonzero(known)[:, None] + np.arange(LEAST)).ravel())
            cuts = np.flatnonzero(np.diff(under) > 1) + 1
            some = np.insert(text[under], cuts, np.arange(1, len(cuts) + 1, dtype=np.uint64))
            where = np.insert(places[under], cuts, -1)
            marked = sorted(tiles(test, some))
            total = sum(n for _, _, n in marked)
            if total >= coverage * len(test):
                rows.append(row)
                sizes.append(len(test))
                covered.append(total)
                found.append([{"test_start": i, "text_start": int(where[j]), "length": n} for i, j, n in marked])
        take = pa.array(rows, pa.int64())
        share = [c / n for c, n in zip(covered, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(take) for c in range(3)), pa.array(sizes, pa.int32()), pa.array(covered, pa.int32()), pa.array(share, pa.float64()), pa.array(found, _TILE)], names=[c.split()[0] for c in _TILED.split(", ", 6)]
        )


def _bitmap(seeds: DataFrame, power: int) -> np.ndarray:
    """The filter, put together by bitwise sums on the cluster; 2^power bits come to the driver at most."""
    last = (1 << power) - 1
    bit = F.explode(F.array(F.col("seed").bitwiseAND(last), F.shiftrightunsigned("seed", 32).bitwiseAND(last))).alias("bit")
    words = seeds.select("seed").distinct().select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(*more, F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).alias("l"), text.alias("text"))


def _found(docs: DataFrame, benchmark: DataFrame, coverage: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(_TILED of distinct texts and distinct items, (doc_id, k, l) of rows with seeds, (item_id, item))."""
    listed = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).mapInArrow(remote(f"{_HERE}:_items"), "item_id long, n int, words binary")
    listed = stash(listed.filter(F.col("n") >= LEAST).withColumn("item", F.xxhash64("words")))
    items = listed.dropDuplicates(["item"]).select("item", "n", "words")
    seeds = items.select("item", "words").mapInArrow(remote(f"{_HERE}:_item_seeds"), "item long, seed long, times long")
    total = listed.agg(F.sum("n")).first()[0] or 0
    power = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(BITS_PER_SEED * total + 1))))
    schema = "doc_id long, k long, l long, words binary, places binary"
    raw = stash(_texts(docs, "doc_id").mapInArrow(remote(f"{_HERE}:_hits", bitmap=_bitmap(seeds, power), power=power), schema))
    texts = raw.select("k", "l", "words", "places").dropDuplicates(["k", "l"])
    known = stash(texts.mapInArrow(remote(f"{_HERE}:_text_seeds"), "k long, l long, seed long"))
    there = seeds.join(known.groupBy("seed").agg(F.count("*").alias("df")), "seed").join(items.select("item", "n"), "item")
    need = F.ceil(F.ceil(F.col("n") * coverage - 1e-9) / LEAST)
    order = W.partitionBy("item").orderBy("df", "seed")
    before, all_places = F.sum("times").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("times"), F.sum("times").over(W.partitionBy("item"))
    rare = there.withColumn("before", before).withColumn("places", all_places).filter(F.col("before") <= F.col("places") - F.greatest(need, F.lit(1)))
    pairs = known.join(rare.select("seed", "item"), "seed").select("k", "l", "item").distinct()
    full = pairs.join(texts, ["k", "l"]).join(items.select("item", F.col("words").alias("test")), "item").select("k", "l", "item", "test", "words", "places")
    return stash(full.mapInArrow(remote(f"{_HERE}:_tile", coverage=coverage), _TILED)), raw.select("doc_id", "k", "l"), listed.select("item_id", "item")


def find(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, test_words, covered_words, coverage and tiles (in word places) of each document and item with at least that coverage.

    Null and empty texts match nothing, nor do items of fewer than ``LEAST`` words.  Repeated rows of either table are found
    each; null ids stay null.  Texts of any length are looked at whole; ties between tiles go to the smaller places.  Empty
    tables give none; other columns are not looked at.
    """
    found, owners, listed = _found(docs, benchmark, coverage)
    return owners.join(found, ["k", "l"]).join(listed, "item").select("doc_id", "item_id", "test_words", "covered_words", "coverage", "tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no item with at least that coverage, with all their columns, whatever their names.

    Decided by the text: rows of equal text go or stay together.  Texts are shuffled only where the contaminated ones' hashes
    are too many for a broadcast by their measured size.
    """
    found, _, _ = _found(docs, benchmark, coverage)
    bad = stash(found.select("k", "l").distinct())
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).alias("l"))
    return rows.join(bad, ["k", "l"], "left_anti").select("row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; see :func:`find` for nulls, empty and repeated rows."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "test_words", "covered_words", "coverage", F.size("tiles").alias("n_tiles"))
