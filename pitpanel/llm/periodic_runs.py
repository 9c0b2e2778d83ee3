"""Periodic runs of words in whole texts: internal pattern matching over a suffix array with a wavelet tree.

A run is a stretch of consecutive words with smallest period q, at least `least` and `times` * q words long, which no
neighbouring word extends keeping the period. Output, one row per input row: doc_id, n_words, runs (start, length,
period, by start and then period) and collapsed, the words joined by one space without those that lie in a run after
its first q words.

How. The words of all texts of a slice get one suffix array, in which a text's suffixes stand together, by prefix
doubling; the names of each round are kept, so that two places are compared over any length in a logarithmic number of
look-ups. A run with period q, and m the power of two with m <= q < 2m, holds an aligned block of m words within its
first 2m words, and the block again q words later. So each aligned block looks for its occurrences in the neighbouring window
of starts from m to 2m - 1 words on: they are a range of the suffix array, and the next one from a given place is the
range successor in a wavelet tree over that array. (Blocks of FIRST words serve all smaller periods, as a run has at
least `least` words.) The occurrences are an arithmetic progression: its first two terms are candidate periods, and if it has
more, so are the distances that bring the ends of the block's own periodic stretch onto those of the progression's. Every
candidate is extended to both sides and judged by its exact length; of equal stretches the smallest period counts.

Defined cases. Null or empty text, or no word: n_words 0, no runs, collapsed is empty. Null id: passed through. Repeated
rows: one result each. Equal texts and equal words: words are compared by their bytes. Empty table: no rows. Other columns
of the input are ignored. A long text is worked through whole: its memory is some hundred bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pitpanel.llm import arrowtext as at

SLICE = 4 << 20
SAME = np.arange(256, dtype=np.uint8)
#: Words of the smallest block: a run of 24 words holds an aligned one and its next occurrence for every period up to 8.
FIRST, ROUNDS = 8, 3
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class Suffixes:
    """Suffix array of texts that follow one another, ordered by the first `width` words, and the names of each round.

    A name is the place in the array of the first suffix that begins with the same words.
    """

    def __init__(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray):
        n = len(codes)
        key = start * (int(codes.max(initial=0)) + 1) + codes
        self.start, self.end, self.width = start, end, 1
        self.order = np.argsort(key, kind="stable")
        self.name = np.empty(n, np.int64)
        self.live = np.arange(n)
        self.rename(key[self.order])
        self.names = [self.name.astype(np.int32)]

    def rename(self, key: np.ndarray) -> None:
        """Names of the live places, whose sorted keys are given; those with a name of their own are no longer live."""
        if not len(key):
            return
        new = np.append(True, key[1:] != key[:-1])
        self.name[self.order[self.live]] = self.live[np.flatnonzero(new)][np.cumsum(new) - 1]
        self.live = self.live[~(new & np.append(new[1:], True))]

    def double(self) -> None:
        p = self.order[self.live]
        other = p + self.width
        inside = other < self.end[p]
        key = self.name[p] * (len(self.order) + 1) + np.where(inside, self.name[np.where(inside, other, 0)] + 1, 0)
        by = np.argsort(key, kind="stable")
        self.order[self.live] = p[by]
        self.rename(key[by])
        self.width *= 2
        self.names.append(self.name.astype(np.int32))

    def only(self, keep: np.ndarray) -> "Suffixes":
        """The same for some of the texts; keep tells of each place whether its text stays."""
        out = object.__new__(Suffixes)
        moved = np.cumsum(keep) - 1
        stays = keep[self.order]
        out.order = moved[self.order[stays]]
        slot = np.cumsum(stays) - 1  # groups lie in one text, so they stay whole
        out.name = slot[self.name[keep]]
        out.live = slot[self.live[stays[self.live]]]
        out.start, out.end, out.width = moved[self.start[keep]], moved[self.end[keep] - 1] + 1, self.width
        out.names = [x[keep] for x in self.names]
        out.names[-1] = out.name.astype(np.int32)
        return out


class WaveletTree:
    """Range counts, range quantiles and range successors over an array of the numbers 0 .. n - 1, many at a time."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Values under x (at most 2 ** bits - 1) in [left, right)."""
        found = np.zeros(len(x), np.int64)
        for k, zero in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - k)) & 1 == 1
            a, b = zero[left], zero[right]
            found += np.where(one, b - a, 0)
            left, right = np.where(one, zero[-1] + left - a, a), np.where(one, zero[-1] + right - b, b)
        return found

    def ranked(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of the given rank, from 0, in [left, right)."""
        value = np.zeros(len(rank), np.int64)
        for zero in self.zeros:
            a, b = zero[left], zero[right]
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            value = value * 2 + one
            left, right = np.where(one, zero[-1] + left - a, a), np.where(one, zero[-1] + right - b, b)
        return value

    def successor(self, left: np.ndarray, right: np.ndarray, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value of [left, right) from x to last, or -1."""
        rank = self.below(left, right, x)
        ok = rank < right - left
        out = np.full(len(x), -1)
        out[ok] = self.ranked(left[ok], right[ok], rank[ok])
        out[out > last] = -1
        return out


def forward(s: Suffixes, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal words from i and from j > i on, in one text."""
    got, end = np.zeros(len(i), np.int64), s.end[i] if len(i) else i
    for k in range(len(s.names) - 1, -1, -1):
        while True:
            ok = np.flatnonzero(j + got + (1 << k) <= end)
            ok = ok[s.names[k][i[ok] + got[ok]] == s.names[k][j[ok] + got[ok]]]
            got[ok] += 1 << k
            if k < len(s.names) - 1 or not len(ok):
                break
    return got


def backward(s: Suffixes, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal words before i and before j > i, in one text."""
    got, start = np.zeros(len(i), np.int64), s.start[i] if len(i) else i
    for k in range(len(s.names) - 1, -1, -1):
        while True:
            ok = np.flatnonzero(i - got - (1 << k) >= start)
            back = got[ok] + (1 << k)
            ok = ok[s.names[k][i[ok] - back] == s.names[k][j[ok] - back]]
            got[ok] += 1 << k
            if k < len(s.names) - 1 or not len(ok):
                break
    return got


def candidates(s: Suffixes, tree: WaveletTree, level: int, windows: list[tuple[int, int]], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block start, candidate period) of all aligned blocks of 2 ** level words; windows are (first, last) distances.

    Only blocks that occur more than once in their text ask; `words` has the length of each place's text.
    """
    m = 1 << level
    name = s.names[level]
    size = np.bincount(name, minlength=len(name))
    at_ = np.flatnonzero(((np.arange(len(name)) - s.start) % m == 0) & (np.arange(len(name)) + m <= s.end) & (size[name] > 1) & (words >= 3 * windows[0][0]))
    left = name[at_].astype(np.int64)
    right = left + size[left]
    found = []
    for low, high in windows:
        last = np.minimum(at_ + high, s.end[at_] - 1)
        terms = []
        b, l, r, top = at_, left, right, last  # noqa: E741
        x = np.minimum(b + low, len(name))
        for _ in range(3):
            hit = tree.successor(l, r, x, top)
            ok = hit >= 0
            terms.append((b[ok], hit[ok]))
            b, l, r, top, x = b[ok], l[ok], r[ok], top[ok], hit[ok] + 1  # noqa: E741
        for b, hit in terms[:2]:
            found.append((b, hit - b))
        b = terms[2][0]
        if len(b):  # three terms or more: block and progression lie in periodic stretches, whose ends must meet
            one = terms[0][1][np.searchsorted(terms[0][0], b)]
            step = terms[1][1][np.searchsorted(terms[1][0], b)] - one
            tail = forward(s, b, b + step), forward(s, one, one + step)
            head = backward(s, b, b + step), backward(s, one, one + step)
            found += [(b, (one + tail[1]) - (b + tail[0])), (b, (one - head[1]) - (b - head[0])), (b, step)]
    start, period = (np.concatenate(x) for x in zip(*found))
    ok = (period > 0) & (start + period < s.end[start]) if len(start) else np.zeros(0, bool)
    return start[ok], period[ok]


def find_runs(codes: np.ndarray, bounds: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (text, start in the text, length, period), sorted; codes are the words of texts that begin at `bounds`."""
    if least < 2 * FIRST + FIRST or times < 3:
        raise ValueError(f"a run has at least {3 * FIRST} words and three periods")
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), size)
    keep = size[text] >= least
    none = np.zeros((0, 4), np.int64)
    if not keep.any():
        return none
    where = np.flatnonzero(keep)
    moved = np.cumsum(keep) - 1
    s = Suffixes(codes[where], moved[bounds[:-1][text[where]]], moved[bounds[1:][text[where]] - 1] + 1)
    for _ in range(ROUNDS):
        s.double()
    # A text whose blocks of FIRST words all differ has no run: each run holds such a block twice.
    twice = np.zeros(len(s.order), bool)
    twice[s.start[s.order[s.live]]] = True
    keep = twice[s.start]
    if not keep.any():
        return none
    where, s = where[keep], s.only(keep)
    words = s.end - s.start
    while 2 * s.width <= words.max() // times and len(s.live):
        s.double()
    tree = WaveletTree(s.order)
    blocks = [candidates(s, tree, ROUNDS, [(1, FIRST), (FIRST + 1, 2 * FIRST - 1)], words)]
    for level in range(ROUNDS + 1, len(s.names)):
        blocks.append(candidates(s, tree, level, [(1 << level, (2 << level) - 1)], words))
    place, period = (np.concatenate(x) for x in zip(*blocks))
    head, tail = backward(s, place, place + period), forward(s, place, place + period)
    length = head + period + tail
    ok = (length >= least) & (length >= times * period)
    first = (place - head)[ok]
    rows = np.stack([text[where[first]], where[first] - bounds[text[where[first]]], length[ok], period[ok]], axis=1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)  # of one stretch, the smallest period
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def dropped(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    edge = np.zeros(bounds[-1] + 1, np.int64)
    begin = bounds[rows[:, 0]] + rows[:, 1]
    np.add.at(edge, begin + rows[:, 3], 1)
    np.add.at(edge, begin + rows[:, 2], -1)
    return np.cumsum(edge[:-1]) > 0


def lists(n: int, rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.searchsorted(rows[:, 0], np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs and collapsed for every row; see above."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "text", SLICE):
            n = part.num_rows
            words, row = at.words(part.column("text"), SAME)
            bounds = at.bounds(row, n)
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = find_runs(codes, bounds, least, times)
            keep = ~dropped(rows, bounds)
            left = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)])[bounds]), words.filter(pa.array(keep)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(bounds)), "runs": lists(n, rows),
                "collapsed": pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string()),
            })

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, n_words long, runs array<{RUN}>, collapsed string")
