"""Packing of token pieces into as few sequences as possible by swap-based local search.

Output, one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

Defined cases. Null or empty text: one piece that holds the end id alone. Null id: passed through. Repeated
rows: each is packed. A text longer than a sequence is cut without loss. Empty table: no rows. Other columns
of the input are ignored.

Pieces are dealt at random into groups of about GROUP, so that no task holds more than that; every group is
packed on its own and wastes at most a part of one sequence. In a group the start is best-fit decreasing. Then
the emptiest sequence hands its pieces on: a piece moves where it fits, or one piece is exchanged for a shorter
one, one for two shorter ones, or two for one shorter one of a fuller sequence. Each step raises the sum of
squared fills, until the sequence is empty or no step is left. All pieces and all pairs of two sequences are weighed, by
their lengths. The search of a group ends when it uses the least number of sequences that could hold its tokens, when every
open sequence was tried, or when PATIENCE of them in a row could not be emptied.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pitpanel.llm import tokens
from pitpanel.session import materialise

GROUP = 4096
#: Sequences in a row that the search fails to empty before it stops.
PATIENCE = 24


class Bins:
    def __init__(self, lengths: list[int], capacity: int):
        self.length, self.capacity = lengths, capacity
        self.items: list[set[int]] = []
        self.fill: list[int] = []
        self.free: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0
        self.known: dict[int, tuple] = {}

    def place(self, b: int) -> None:
        slack = self.capacity - self.fill[b]
        self.free[slack].add(b)
        self.mask |= 1 << slack

    def lift(self, b: int) -> None:
        slack = self.capacity - self.fill[b]
        self.free[slack].discard(b)
        if not self.free[slack]:
            self.mask &= ~(1 << slack)

    def change(self, b: int, gone: tuple[int, ...], come: tuple[int, ...]) -> None:
        self.lift(b)
        self.known.pop(b, None)
        self.items[b].difference_update(gone)
        self.items[b].update(come)
        self.fill[b] += sum(self.length[i] for i in come) - sum(self.length[i] for i in gone)
        if self.items[b]:
            self.place(b)

    def tightest(self, need: int, but: int = -1) -> int:
        """The fullest sequence with room for `need`, or -1."""
        m = self.mask >> need
        while m:
            low = (m & -m).bit_length() - 1
            for b in self.free[need + low]:
                if b != but:
                    return b
            m &= m - 1
        return -1

    def best_fit_decreasing(self) -> None:
        for i in sorted(range(len(self.length)), key=lambda i: -self.length[i]):
            b = self.tightest(self.length[i])
            if b < 0:
                self.items.append({i}), self.fill.append(self.length[i])
                self.place(len(self.items) - 1)
            else:
                self.change(b, (), (i,))

    def emptied(self, victim: int) -> bool:
        """Hand on the pieces of one sequence; True if none is left."""
        while self.items[victim]:
            if not self.step(victim):
                return False
        return True

    def sums(self, b: int) -> tuple[dict[int, int], dict[int, tuple[int, int]], int, int]:
        """Of one sequence: a piece by length, two pieces by summed length, and both sets of lengths as bit masks.

        Pieces of one length are as good as each other, so one (or two, for a pair of them) stands for all; there are at most
        `capacity` sums, and no pair is left out.
        """
        if b not in self.known:
            by: dict[int, list[int]] = {}
            for i in self.items[b]:
                by.setdefault(self.length[i], []).append(i)
            one = {n: own[0] for n, own in by.items()}
            two = {m + n: (one[m], one[n]) for m, n in combinations(by, 2)} | {2 * n: (own[0], own[1]) for n, own in by.items() if len(own) > 1}
            self.known[b] = one, two, sum(1 << n for n in one), sum(1 << n for n in two)
        return self.known[b]

    def step(self, victim: int) -> bool:
        """A move of the victim's longest piece that fits elsewhere, or else the exchange that fills another sequence most.

        All exchanges of one for one, two for one and one for two with every fuller sequence are weighed; the search stops
        early only at one that fills a sequence to the end.
        """
        for a in sorted(self.items[victim], key=lambda i: -self.length[i]):
            b = self.tightest(self.length[a], victim)
            if b >= 0:
                self.change(victim, (a,), ()), self.change(b, (), (a,))
                return True
        one, two, ones, twos = self.sums(victim)
        best = (0, -1, 0, 0, False)  # gain, sequence, length given, length got back, whether that is a pair
        m = self.mask & ~1
        while m:
            slack = (m & -m).bit_length() - 1
            m &= m - 1
            if slack <= best[0]:
                continue
            room = (1 << slack) - 1
            for b in self.free[slack]:
                if b == victim or self.fill[b] < self.fill[victim]:
                    continue
                their_one, _, _, their_twos = self.sums(b)
                for n in their_one:  # one or two of ours for one of theirs: the largest gain up to the slack
                    gain = ((ones | twos) >> (n + 1) & room).bit_length()
                    if gain > best[0]:
                        best = (gain, b, n + gain, n, False)
                for n in one:  # one of ours for two of theirs: the smallest sum not under n - slack
                    low = max(0, n - slack)
                    back = their_twos >> low
                    if back:
                        got = low + (back & -back).bit_length() - 1
                        if n - got > best[0]:
                            best = (n - got, b, n, got, True)
                if best[0] == slack:
                    m = 0
                    break
        gain, b, give, got, pair = best
        if b < 0:
            return False
        pieces = (one[give],) if give in one else two[give]
        their_one, their_two, _, _ = self.sums(b)
        back = their_two[got] if pair else (their_one[got],)
        self.change(victim, pieces, back), self.change(b, back, pieces)
        return True

    def search(self) -> None:
        least = -(-sum(self.length) // self.capacity)
        used, failed, tried = len(self.items), 0, set()
        while used > least and failed < PATIENCE:
            open_bins = [b for b in range(len(self.items)) if self.items[b] and b not in tried and self.fill[b] < self.capacity]
            if len(open_bins) < 2:
                break
            victim = min(open_bins, key=lambda b: self.fill[b])
            if self.emptied(victim):
                used, failed = used - 1, 0
                tried.clear()
            else:
                failed += 1
                tried.add(victim)


def pack(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece; sequences are numbered from 0 without a gap, offsets start at 0 without a gap."""
    bins = Bins([int(x) for x in lengths], capacity)
    bins.best_fit_decreasing()
    bins.search()
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, items in enumerate(x for x in bins.items if x):
        at = 0
        for i in sorted(items):
            sequence[i], offset[i] = number, at
            at += bins.length[i]
    return sequence, offset


def packed(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, group: int = GROUP,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    cut = materialise(tokens.pieces(tokens.texts(docs, id_col, text_col), path, capacity, end_id), "pieces")
    full = cut.filter(F.col("length") == capacity)
    part = cut.filter(F.col("length") < capacity)
    groups = max(1, round(part.count() / group))
    kind = dict(cut.dtypes)["doc_id"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = pack(rows["length"].tolist(), capacity)
        out = rows.drop(columns="g")
        out["sequence_id"] = rows["g"].iloc[0] * (1 << 24) + sequence
        out["offset"] = offset
        return out

    # Full pieces are sequences of their own; their numbers are negative, so they meet no other.
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    dealt = part.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    ddl = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("g").applyInPandas(run, ddl).unionByName(alone)
