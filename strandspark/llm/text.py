"""Vectorised words, hashes and shingles over whole batches of texts.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` in the UTF-8 text.  Texts of a batch are handled together as
one byte buffer, so the cost is a few numpy passes over the bytes and no Python object is made for a word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pattern of a word for the JVM's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
CHUNK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: As above, but every ASCII byte that is no letter or digit parts words, and so do signs and spaces of Unicode below U+3040.
_PARTS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_SIGN = np.array([i > 127 and unicodedata.category(chr(i))[0] in "PSZ" for i in range(0x3040)])
_BYTE_PLAIN = np.where(_PARTS, np.uint64(0), _BYTE_LOWER)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256) - 1, _P, np.uint64), dtype=np.uint64)])
    return _powers


def _plain_breaks(data: np.ndarray) -> np.ndarray:
    """Bytes that part words where only letters and digits make them."""
    out = _PARTS[data]
    two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    two = two[two + 1 < len(data)]
    if len(two):
        two = two[_SIGN[((data[two] & 31).astype(np.int64) << 6) | (data[two + 1] & 63)]]
        out[two] = out[two + 1] = True
    three = np.flatnonzero((data >= 0xE0) & (data < 0xE4))
    three = three[three + 2 < len(data)]
    if len(three):
        point = ((data[three] & 15).astype(np.int64) << 12) | ((data[three + 1] & 63).astype(np.int64) << 6) | (data[three + 2] & 63)
        three = three[(point < len(_SIGN)) & _SIGN[np.minimum(point, len(_SIGN) - 1)]]
        out[three] = out[three + 1] = out[three + 2] = True
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


class Words:
    """Words of some texts: ``start``/``end`` byte positions in ``data``, ``hash``, and ``first[i]:first[i+1]`` for text i."""

    __slots__ = ("data", "end", "first", "hash", "offsets", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, plain: bool = False) -> None:
        self.data, self.offsets = data, offsets
        word = ~(_plain_breaks(data) if plain else _SPACE[data])
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = ~word[:-1]
        edge[offsets] = True  # a text's first byte follows no word of the text before
        self.start = np.flatnonzero(word & edge[:-1])
        after = np.empty(len(data), dtype=bool)
        after[:-1] = ~word[1:]
        if len(data):
            after[-1] = True
        inner = offsets[(offsets > 0) & (offsets <= len(data))]
        after[inner - 1] = True
        self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        if len(self.start):
            gaps = np.diff(np.append(self.start, len(data)))
            lead = self.start[0]
            relative = np.arange(lead, len(data)) - np.repeat(self.start, gaps)
            with np.errstate(over="ignore"):
                values = (_BYTE_PLAIN if plain else _BYTE_LOWER if lower else _BYTE)[data[lead:]] * _power_table(int(gaps.max()))[relative]
                if plain:
                    values[~word[lead:]] = 0
                self.hash = mix(np.add.reduceat(values, self.start - lead))
        else:
            self.hash = np.empty(0, np.uint64)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, lower: bool = False, plain: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) over a column of strings; null counts as empty.

    ``lower`` takes A-Z as a-z; ``plain`` does too, and lets everything but letters and digits part words.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], lower, plain)
        row = end


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (over the whole buffer: the caller cuts at the ends of texts)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out = out * _Q + h[i : i + n]
    return mix(out)
