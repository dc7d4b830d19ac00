"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks.

Landmarks are short strings (bytes of UTF-8, lower case) that tell toxic from clean training texts.  The kernel between a
word and a landmark counts their common subsequences of ``ORDER`` characters, each weighted by ``DECAY`` to the power of the
span it takes in either string, and is normalised; so letters put between those of an insult, or left out, lower it gently.
A sentence's kernel value with a landmark is the largest one of its words (and of runs of single letters, put together).
The machine works on sentences; a text's features are its best sentence margin and how many sentences are beyond zero, and a
logistic calibration turns them into a probability.

Only words that can reach FLOOR with a landmark come to the dynamic programme: the filter sums what their subsequences of
ORDER bytes have in common with landmarks, whatever the gaps, and divides by the least norm that a string of that length has.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import PER_CLASS, class_weights, held_out, logistic, sample, sigmoid
from .ship import remote
from .text import Words, chunks, grams, mix

_HERE = "strandspark.llm.toxicity"
ORDER, DECAY = 3, 0.75
#: Landmarks, their lengths in bytes, and the longest stretch of a word that the kernel takes at once (longer words: several).
LANDMARKS, SHORT, LONG, STRETCH = 40, 5, 9, 24
#: Kernel values below this count as 0.
FLOOR = 0.3
#: Words whose kernel values a worker keeps.
KEPT = 500_000
#: A mark at both ends of a word, as white space is in a text: insults are told from words that hold them by chance.
_EDGE = b"^"
_JUNK, _FOREIGN = re.compile(rb"[^a-z0-9\x80-\xff]+"), re.compile(rb"[^a-z0-9]+")


def _padded(words: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint8)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w, np.uint8)
    return out


def kernel(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Gap-weighted subsequence kernel of order ORDER between each string of a and each of b, not normalised."""
    if not a or not b:
        return np.zeros((len(a), len(b)))
    return _kernel(_padded(a, max(map(len, a)) or 1)[:, None, :], _padded(b, max(map(len, b)) or 1)[None, :, :])


def self_kernel(a: list[bytes]) -> np.ndarray:
    x = _padded(a, max(map(len, a)) or 1)
    return _kernel(x, x)


def _kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n, m = x.shape[-1], y.shape[-1]
    shape = np.broadcast_shapes(x.shape[:-1], y.shape[:-1])
    same = [[(x[..., i] == y[..., j]) & (x[..., i] != 0) for j in range(m)] for i in range(n)]
    before = [[np.ones(shape)] * (m + 1) for _ in range(n + 1)]  # K'_0
    for order in range(1, ORDER):
        now = [[None] * (m + 1) for _ in range(n + 1)]
        for j in range(m + 1):
            now[0][j] = np.zeros(shape)
        for i in range(1, n + 1):
            run = np.zeros(shape)  # K''
            now[i][0] = np.zeros(shape)
            for j in range(1, m + 1):
                run = DECAY * run + np.where(same[i - 1][j - 1], DECAY * DECAY * before[i - 1][j - 1], 0.0)
                now[i][j] = DECAY * now[i - 1][j] + run
        before = now
    out = np.zeros(shape)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            out += np.where(same[i - 1][j - 1], DECAY * DECAY * before[i - 1][j - 1], 0.0)
    return out


def _alike(strings: list[bytes], other: bytes) -> np.ndarray:
    return (kernel(strings, [other])[:, 0] / np.sqrt(np.maximum(self_kernel(strings), 1e-12))) / np.sqrt(self_kernel([other])[0])


def _stretches(word: bytes) -> list[bytes]:
    if len(word) <= STRETCH:
        return [word]
    return [word[i : i + STRETCH] for i in range(0, len(word) - STRETCH // 2, STRETCH // 2)]


def _forms(word: bytes) -> set[bytes]:
    """The word as it stands, without ASCII signs, without any signs (of Unicode), and its ASCII letters and digits alone."""
    out = {word, _JUNK.sub(b"", word)}
    if not word.isascii():
        letters = "".join(c for c in word.decode("utf-8", "ignore") if c.isalnum())
        out |= {letters.encode(), _FOREIGN.sub(b"", word)}
    return out


def _pieces(words: list[bytes]) -> tuple[list[bytes], list[int]]:
    """What the kernel takes of each word, and the word's number."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        for form in _forms(w):
            if ORDER <= len(form) <= STRETCH - 2:
                pieces.append(_EDGE + form + _EDGE)
                owner.append(i)
            elif len(form) >= ORDER:
                more = [x for x in _stretches(_EDGE + form + _EDGE) if len(x) >= ORDER + 2]
                pieces += more
                owner += [i] * len(more)
    return pieces, owner


def similarities(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised kernel values, the largest of the word's forms."""
    pieces, owner = _pieces(words)
    out = np.zeros((len(words), len(landmarks)))
    own = np.sqrt(self_kernel(landmarks)) if landmarks else np.zeros(0)
    by = np.argsort([len(p) for p in pieces], kind="stable")
    for at in range(0, len(by), 256):
        part = by[at : at + 256]
        some = [pieces[i] for i in part]
        values = kernel(some, landmarks) / (np.sqrt(self_kernel(some))[:, None] * own[None, :])
        np.maximum.at(out, np.array([owner[i] for i in part]), values)
    out[out < FLOOR] = 0
    return out


def _sentences(w: Words) -> np.ndarray:
    """Number of the sentence of each word: they end with . ! ? or at a line end or the end of a text."""
    if not len(w.start):
        return np.empty(0, np.int64)
    last = w.data[w.end - 1]
    ends = (last == 46) | (last == 33) | (last == 63)
    lines = np.concatenate([[0], np.cumsum(w.data == 10, dtype=np.int32)])
    ends[:-1] |= lines[w.start[1:]] != lines[w.end[:-1]]
    first = w.first[1:-1]
    ends[first[(first > 0) & (first <= len(ends))] - 1] = True
    return np.concatenate([[0], np.cumsum(ends[:-1])])


def _letter_runs(w: Words, sentence: np.ndarray) -> list[tuple[int, bytes]]:
    """(sentence, letters) of runs of four or more one-letter words, letters of any script."""
    lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
    single = lead[w.end] - lead[w.start] == 1
    if len(single) < 4 or not single.any():
        return []
    keep = np.flatnonzero(single[3:] & single[2:-1] & single[1:-2] & single[:-3] & (sentence[3:] == sentence[:-3]))
    out, done = [], -1
    for i in keep:
        if i < done:
            continue
        j = i
        while j < len(single) and single[j] and sentence[j] == sentence[i]:
            j += 1
        out.append((int(sentence[i]), b"".join(w.data[a:b].tobytes() for a, b in zip(w.start[i:j].tolist(), w.end[i:j].tolist(), strict=True)).lower()))
        done = j
    return out


@lru_cache(STRETCH)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Places of the subsequences of a string of n bytes, their weights, and FLOOR times its least norm (a little less)."""
    x, y, z = np.array(list(combinations(range(n), ORDER))).T
    weight = (DECAY ** (z - x + 1)).astype(np.float32)
    return x, y, z, weight, 0.999 * FLOOR * float(np.sqrt(np.square(weight).sum()))


class Filter:
    """Tells words that no landmark can have a kernel value of FLOOR with; it passes every other one.

    The kernel is summed over the word's subsequences of ORDER = 3 bytes: first with the landmark that weighs each most, then,
    for the words left, with each landmark.  A string's norm is at least that of one of its length without repeats.
    """

    def __init__(self, landmarks: list[bytes]) -> None:
        letters = sorted(set(b"".join(landmarks)))
        self.base = len(letters) + 1
        self.code = np.zeros(256, np.int32)
        self.code[letters] = np.arange(1, self.base)
        self.row, rows = np.zeros(self.base**3, np.int32), [np.zeros(len(landmarks), np.float32)]
        norms = np.sqrt(self_kernel(landmarks)) if landmarks else []
        for k, mark in enumerate(landmarks):
            c = self.code[np.frombuffer(mark, np.uint8)].tolist()
            for x, y, z in combinations(range(len(c)), ORDER):
                key = (c[x] * self.base + c[y]) * self.base + c[z]
                if not self.row[key]:
                    self.row[key] = len(rows)
                    rows.append(np.zeros(len(landmarks), np.float32))
                rows[self.row[key]][k] += DECAY ** (z - x + 1) / norms[k]
        self.each = np.array(rows)
        self.most = self.each.max(1, initial=0)[self.row]

    def __call__(self, words: list[bytes]) -> np.ndarray:
        pieces, owner = _pieces(words)
        out, by = np.zeros(len(words), bool), {}
        for piece, i in zip(pieces, owner, strict=True):
            group = by.setdefault(len(piece), ([], []))
            group[0].append(piece)
            group[1].append(i)
        for n, (group, own) in by.items():
            out[np.array(own)[self.rows(np.frombuffer(b"".join(group), np.uint8).reshape(-1, n))]] = True
        return out

    def rows(self, strings: np.ndarray) -> np.ndarray:
        """Of strings of one length, a row of bytes each: which a landmark may be like."""
        out, n = np.zeros(len(strings), bool), strings.shape[1]
        x, y, z, weight, least = _triples(n)
        step = max(1, (1 << 17) // len(x))
        for start in range(0, len(strings), step):
            part = np.ascontiguousarray(self.code[strings[start : start + step]].T)
            key = (part[x] * self.base + part[y]) * self.base + part[z]
            left = np.flatnonzero(np.einsum("i,ij->j", weight, self.most[key]) >= least)  # not by BLAS, whose threads spin
            if len(left):
                row = self.row[key[:, left]].T
                word, place = np.nonzero(row)
                values = self.each[row[word, place]] * weight[place][:, None]
                sums = np.add.reduceat(values, np.searchsorted(word, np.arange(len(left))))
                out[start + left[sums.max(1) >= least]] = True
        return out


_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_LETTERS = np.array([chr(i).isalnum() for i in range(0x1F000)])
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _letter_bytes(data: np.ndarray) -> np.ndarray:
    """The bytes of UTF-8 text that belong to letters or digits of any script."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _LETTERS[np.minimum(points, len(_LETTERS) - 1)]
    for i in np.flatnonzero(points >= len(_LETTERS)).tolist():
        letters[i] = chr(points[i]).isalnum()
    return letters[np.cumsum((data & 0xC0) != 0x80, dtype=np.int32) - 1]


class Scorer:
    """Kernel values of sentences, with the words seen before kept: those with values, and the hashes of those without."""

    def __init__(self, landmarks: list[bytes]) -> None:
        self.landmarks, self.possible = landmarks, Filter(landmarks)
        self.known: dict[int, tuple] = {}
        self.none = np.empty(0, np.uint64)

    def _candidates(self, w: Words, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[bytes]]:
        """Numbers and bytes of the words (from start to end) that a landmark may be like; :func:`_forms` over all words at once."""
        short = end - start <= STRETCH - 2
        hit = np.zeros(len(start), bool)
        kept = [None, _ALNUM[w.data] | (w.data >= 0x80)]
        if (w.data >= 0x80).any():
            kept += [_letter_bytes(w.data), _ALNUM[w.data]]
        before = None
        for mask in kept:  # each mask keeps a part of what the one before keeps, so forms of one size are one form
            if mask is None:
                bytes_, a, size = _SMALL[w.data], start, end - start
            else:
                place = np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
                bytes_, a, size = _SMALL[w.data[mask]], place[start], place[end] - place[start]
            use = short & (size >= ORDER) if before is None else short & (size >= ORDER) & (size != before)
            before = size
            for n in np.unique(size[use]).tolist():
                own = np.flatnonzero(use & (size == n))
                strings = np.full((len(own), n + 2), _EDGE[0], np.uint8)
                strings[:, 1:-1] = bytes_[a[own][:, None] + np.arange(n)]
                hit[own[self.possible.rows(strings)]] = True
        long = np.flatnonzero(~short)
        for own in np.array_split(long, len(long) // 4096 + 1) if len(long) else []:
            hit[own[self.possible([w.data[start[i] : end[i]].tobytes().lower() for i in own.tolist()])]] = True
        at = np.flatnonzero(hit).tolist()
        return at, [w.data[start[i] : end[i]].tobytes().lower() for i in at]

    def _values(self, words: list[bytes]) -> list[tuple | None]:
        rows = similarities(words, self.landmarks)
        return [(at, row[at]) if len(at := np.flatnonzero(row)) else None for row in rows]

    def _learn(self, w: Words, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[int, tuple]:
        """Values of these words, those without any left out; the words are kept if they are not too many."""
        at, words = self._candidates(w, start, end)
        out = {key: value for key, value in zip(keys[at].tolist(), self._values(words), strict=True) if value is not None}
        if len(self.known) + len(self.none) + len(keys) > KEPT:
            self.known, self.none = {}, np.empty(0, np.uint64)
        if len(keys) <= KEPT:
            self.known.update(out)
            new = keys[~np.isin(keys, np.array(list(out), np.uint64))]  # sorted, as the others are
            self.none = np.insert(self.none, np.searchsorted(self.none, new), new)
        return out

    def sentences(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text of each sentence that has similar words, its kernel values; text of each similar word, its kernel values)."""
        sentence = _sentences(w)
        at = np.flatnonzero(w.end - w.start >= ORDER)
        keys = w.hash[at]
        unique, first = np.unique(keys, return_index=True)
        # values of these texts' own words, whatever is kept or dropped meanwhile
        here = {key: self.known[key] for key in unique.tolist() if key in self.known} if self.known else {}
        place = np.minimum(np.searchsorted(self.none, unique), max(len(self.none) - 1, 0))
        fresh = ~np.isin(unique, np.array(list(here), np.uint64))
        if len(self.none):
            fresh &= self.none[place] != unique
        if fresh.any():
            own = at[first[fresh]]
            here.update(self._learn(w, unique[fresh], w.start[own], w.end[own]))
        spelt = _letter_runs(w, sentence)
        letters = sorted({x for _, x in spelt})
        possible = [x for x, p in zip(letters, self.possible(letters), strict=True) if p] if letters else []
        runs = {x: v for x, v in zip(possible, self._values(possible), strict=True) if v is not None}
        use = np.isin(keys, np.array(list(here), np.uint64))
        number = np.concatenate([sentence[at[use]], np.array([s for s, x in spelt if x in runs], np.int64)]).astype(np.int64)
        found = [here[k] for k in keys[use].tolist()] + [runs[x] for _, x in spelt if x in runs]
        each = np.zeros((len(found), len(self.landmarks)))
        for row, (marks, value) in enumerate(found):
            each[row, marks] = value
        numbers, row = np.unique(number, return_inverse=True)
        z = np.zeros((len(numbers), len(self.landmarks)))
        np.maximum.at(z, row, each)
        text = np.searchsorted(w.first, np.searchsorted(sentence, numbers), side="right") - 1
        return text, z, text[row], each


_PLAIN = bytes(94 if i in (9, 10, 11, 12, 13, 32) else i for i in range(256))
_DROP = bytes(i for i in range(128) if not (chr(i).isalnum() or i in (9, 10, 11, 12, 13, 32)))


def _windows(text: bytes, n: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Hashes and places of the n-byte substrings of marked words, and the text they are cut from."""
    plain = _EDGE + text.lower().translate(_PLAIN, _DROP) + _EDGE
    x = np.frombuffer(plain, np.uint8)
    if len(x) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), plain
    h = grams(mix(x.astype(np.uint64) + np.uint64(1)), n)
    marks = np.concatenate([[0], np.cumsum(x == _EDGE[0])])
    inner = marks[n - 1 : len(x)] - marks[1 : len(x) - n + 2]  # marks strictly inside
    keep = np.flatnonzero(inner == 0)
    return h[keep], keep, plain


def choose_landmarks(texts: list[bytes], y: np.ndarray, most: int = LANDMARKS) -> list[bytes]:
    """Substrings of words that toxic texts have and clean ones hardly have, each for texts that those before leave open.

    Greedy: the next one has the largest weight of toxic texts less that of clean ones; a toxic text that has it counts
    half from then on.  Substrings of one another, or strings very like each other, aren't both taken.
    """
    toxic, clean = [t for t, k in zip(texts, y, strict=True) if k], [t for t, k in zip(texts, y, strict=True) if not k]
    n1, n0 = max(1, len(toxic)), max(1, len(clean))
    best: list[tuple[float, int, int, float]] = []
    for n in range(SHORT, LONG + 1):
        seen = [np.unique(_windows(t, n)[0]) for t in toxic]
        keys, count = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.uint64), np.empty(0, np.int64))
        keys, count = keys[count >= 3], count[count >= 3]
        if not len(keys):
            continue
        other = np.zeros(len(keys))
        for t in clean:
            h = np.unique(_windows(t, n)[0])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            other[at[keys[at] == h]] += 1
        gain = count / n1 - 2 * other / n0
        good = np.flatnonzero(count / n1 > 4 * other / n0)
        best += [(float(gain[i]), n, int(keys[i]), float(2 * other[i] / n0)) for i in good[np.argsort(-gain[good], kind="stable")][:1000]]
    best = sorted(best, key=lambda x: (-x[0], x[1], x[2]))[:3000]
    if not best:
        return []
    strings: dict[tuple[int, int], bytes] = {}
    has = np.zeros((len(best), n1), dtype=bool)
    for n in {x[1] for x in best}:
        own = [i for i, x in enumerate(best) if x[1] == n]
        keys = np.array([best[i][2] for i in own], np.uint64)
        by = np.argsort(keys)
        keys, own = keys[by], np.array(own)[by]
        for j, t in enumerate(toxic):
            h, place, plain = _windows(t, n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == h)
            has[own[at[hit]], j] = True
            for i, k in zip(own[at[hit]].tolist(), place[hit].tolist(), strict=True):
                if i not in strings:
                    strings[i] = plain[k : k + n]
    names = [strings[i] for i in range(len(best))]
    against, length = np.array([x[3] for x in best]), np.array([x[1] for x in best])
    weight, out, free = np.ones(n1), [], np.ones(len(best), dtype=bool)
    while len(out) < most and free.any():
        value = np.where(free, has @ weight / n1 - against, -1.0)
        top = value.max()
        if top * n1 < 1.5:
            break
        k = int(max(np.flatnonzero(value >= top - 1e-9), key=lambda i: (-abs(length[i] - 7), -i)))
        out.append(names[k])
        weight[has[k]] *= 0.5
        free &= ~((_alike(names, names[k]) > 0.6) | np.array([names[k] in x or x in names[k] for x in names]))
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 50) -> np.ndarray:
    """Weights and intercept of a linear machine with squared hinge loss, by Newton steps on the violating rows."""
    x = np.column_stack([x, np.ones(len(x))])
    s, weight = np.where(y > 0, 1.0, -1.0), weight / weight.sum()
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-8
    active = None
    for _ in range(steps):
        now = s * (x @ b) < 1
        if active is not None and (now == active).all():
            break
        active = now
        xa, wa = x[now], weight[now]
        b = np.linalg.solve((xa * wa[:, None]).T @ xa + np.diag(penalty), xa.T @ (wa * s[now]))
    return b


def _text_features(n: int, text: np.ndarray, margin: np.ndarray, word_text: np.ndarray, word_margin: np.ndarray, word_best: np.ndarray, rest: float) -> np.ndarray:
    """Of n texts: the best sentence margin, toxic sentences, words that would make one alone, words much like a landmark."""
    best = np.full(n, rest)
    np.maximum.at(best, text, margin)
    sentences = np.bincount(text, margin > 0, n)
    words = np.bincount(word_text, word_margin > 0, n)
    near = np.bincount(word_text, word_best > 0.6, n)
    return np.column_stack([np.clip(best, -3, 3), np.log1p(sentences), np.log1p(words), np.log1p(near)])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> dict:
    """Landmarks, machine and calibration from whole texts of a bounded sample of labelled rows that :func:`held_out` leaves.

    A toxic text's sentences are not labelled one by one: at first those most like the landmarks stand for it, then those
    with the best margins, three times over; all sentences of clean texts are clean.  Without both classes every score is
    the share of toxic labels (0 without labels).
    """
    texts, y, fold, counts = sample(docs, labels, label, per_class)
    n = sum(counts.values())
    base = counts.get(1, 0) / n if n else 0.0
    constant = {"landmarks": [], "weights": np.zeros(0), "rest": 0.0, "calibration": [0.0, 0.0, 0.0, 0.0, float(np.log((base + 1e-6) / (1 - base + 1e-6)))]}
    keep = [i for i, v in enumerate(y) if v in (0, 1)]
    raw, y, fold = [texts[i].encode("utf-8", "surrogatepass") for i in keep], np.array([y[i] for i in keep]), np.array([fold[i] for i in keep])
    own = np.flatnonzero(fold != 4)
    if len(set(y[own].tolist())) < 2 or len(set(y[fold == 4].tolist())) < 2:
        return constant
    landmarks = choose_landmarks([raw[i] for i in own], y[own])
    if not landmarks:
        return constant
    # Nystroem: phi(s) = K_mm^(-1/2) z(s)
    gram = kernel(landmarks, landmarks)
    scale = np.sqrt(np.diag(gram))
    values, vectors = np.linalg.eigh(gram / scale[:, None] / scale[None, :])
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    scorer = Scorer(landmarks)
    parts = [(a, *scorer.sentences(w)) for a, _, w in chunks(pa.array(raw, pa.large_binary()), lower=True)]
    owner, z = np.concatenate([p[1] + p[0] for p in parts]), np.vstack([p[2] for p in parts])
    word_owner, word_z = np.concatenate([p[3] + p[0] for p in parts]), np.vstack([p[4] for p in parts])
    phi = z @ root
    train = fold[owner] != 4
    margin = z.max(1, initial=0)
    b = np.zeros(phi.shape[1] + 1)
    for _ in range(4):
        best = np.full(len(raw), -np.inf)
        np.maximum.at(best, owner, margin)
        toxic = (y[owner] == 1) & (margin >= np.maximum(best[owner] - 1e-9, 0.0))
        toxic |= (y[owner] == 1) & (margin > 0.9)
        use = train & (toxic | (y[owner] == 0))
        if not toxic[train].any():
            return constant
        n1, n0 = (use & toxic).sum(), (use & ~toxic).sum() + 1
        x = np.vstack([phi[use], np.zeros(phi.shape[1])])  # a sentence with no similar word is clean
        target = np.append(toxic[use], False)
        b = _svm(x, target, np.where(target, 0.5 / max(n1, 1), 0.5 / n0))
        margin = phi @ b[:-1] + b[-1]
    features = _text_features(len(raw), owner, margin, word_owner, word_z @ (root @ b[:-1]) + b[-1], word_z.max(1, initial=0), float(b[-1]))
    rest = np.flatnonzero(fold == 4) if (fold == 4).sum() >= 40 else np.arange(len(raw))
    weight = class_weights(y[rest].tolist(), counts)
    return {"landmarks": landmarks, "weights": root @ b[:-1], "rest": float(b[-1]), "calibration": logistic(features[rest], y[rest], weight).tolist()}


@lru_cache(1)
def _scorer(landmarks: tuple[bytes, ...]) -> Scorer:
    return Scorer(list(landmarks))


def _scores(batches, model: dict):
    scorer = _scorer(tuple(model["landmarks"]))
    *slopes, intercept = model["calibration"]
    for batch in batches:
        out = np.empty(batch.num_rows)
        for a, b, w in chunks(batch.column(1), lower=True):
            if model["landmarks"]:
                text, z, word_text, word_z = scorer.sentences(w)
                features = _text_features(b - a, text, z @ model["weights"] + model["rest"], word_text, word_z @ model["weights"] + model["rest"], word_z.max(1, initial=0), model["rest"])
            else:
                features = np.zeros((b - a, 4))
            out[a:b] = sigmoid(features @ np.array(slopes) + intercept)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for each row, repeated ones each: the probability that the text is toxic.

    Null and empty texts have no similar word.  Texts of any length are read whole; ids may be null; other columns are not
    looked at.  An empty table gives none.
    """
    return docs.select("doc_id", "text").mapInArrow(remote(f"{_HERE}:_scores", model=model), "doc_id long, score double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; see :func:`fit` and :func:`score` for nulls, empty and repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
