"""Benchmark passages in documents by Wu-Manber multi-pattern search over words.

Patterns are the windows of `width` consecutive words of every benchmark item; an item with fewer words is one
pattern. Patterns of one length are searched together. A table over blocks of two words tells how far the
search may jump; where it says zero, the hash of the last words selects a bucket of patterns, and every
pattern of the bucket is compared word by word. Many stretches of the text are scanned in step.

Output, one row per input row: doc_id, n_words, n_hit (words inside an occurrence), spans (word numbers
start, end, start, end, ... of merged occurrences), items (ids of items with an occurrence, as sorted
strings), contaminated (n_hit > 0).

Defined cases. Null or word-free text: no words, no hits. Null item text or item id: no pattern. Equal windows
of several items count for each of them. Repeated item ids are one item, repeated documents get a row each.
Empty benchmark: nothing is hit. Empty table: no rows. Other columns of either input are ignored.

The patterns are sent to the tasks in blocks of at most BLOCK_WORDS words (an item is never cut). With more
than one block the documents are scanned once per block, and the spans found so far travel with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pitpanel.llm import arrowtext as at
from pitpanel.session import materialise

BLOCK_WORDS = 1_000_000
TABLE = 1 << 20
LANE = 512
SUFFIX = 4

WORD_BYTES = at.LOWER.copy()
WORD_BYTES[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def block_hash(ids: np.ndarray) -> np.ndarray:
    """Hash of each row of word numbers."""
    h = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        h = at.mix(h + ids[:, j].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return h


class Group:
    """Tables for all patterns of one length."""

    def __init__(self, patterns: np.ndarray, numbers: np.ndarray):
        self.m = patterns.shape[1]
        self.b = min(2, self.m)
        self.suffix = min(SUFFIX, self.m)
        order = np.argsort(block_hash(patterns[:, self.m - self.suffix :]), kind="stable")
        self.patterns, self.numbers = patterns[order], numbers[order]
        self.buckets = block_hash(self.patterns[:, self.m - self.suffix :])
        self.shift = np.full(TABLE, self.m - self.b + 1, np.int64)
        for end in range(self.b - 1, self.m):
            k = block_hash(patterns[:, end - self.b + 1 : end + 1]) % np.uint64(TABLE)
            np.minimum.at(self.shift, k.astype(np.int64), self.m - 1 - end)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word of each occurrence, pattern number)."""
        n, m = len(text), self.m
        lane = np.arange(0, n, LANE)
        pos, stop = np.maximum(lane, m - 1), np.minimum(lane + LANE, n)
        # Block hashes of unknown words jump furthest; known ones are looked up once per text position.
        jump = np.full(n, m - self.b + 1, np.int64)
        known = text >= 0
        full = known.copy()
        for j in range(1, self.b):
            full[j:] &= known[:-j]
            full[:j] = False
        at_end = np.flatnonzero(full)
        if len(at_end):
            ids = np.stack([text[at_end - self.b + 1 + j] for j in range(self.b)], axis=1)
            jump[at_end] = self.shift[(block_hash(ids) % np.uint64(TABLE)).astype(np.int64)]
        ends, found = [], []
        live = pos < stop
        pos, stop = pos[live], stop[live]
        while len(pos):
            s = jump[pos]
            here = pos[s == 0]
            if len(here):
                ids = text[here[:, None] + np.arange(-self.suffix + 1, 1)[None, :]]
                ok = (ids >= 0).all(axis=1)
                here, ids = here[ok], ids[ok]
                h = block_hash(ids)
                low, high = np.searchsorted(self.buckets, h, "left"), np.searchsorted(self.buckets, h, "right")
                while (more := low < high).any():
                    here, low, high = here[more], low[more], high[more]
                    same = (text[here[:, None] + np.arange(-m + 1, 1)[None, :]] == self.patterns[low]).all(axis=1)
                    ends.append(here[same]), found.append(self.numbers[low[same]])
                    low = low + 1
            pos = pos + np.maximum(s, 1)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *ends]), np.concatenate([none, *found])


class Patterns:
    """Vocabulary, pattern groups by length, and the items of each pattern."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        w, row = at.words(pa.array([t for _, t in items], pa.string()), WORD_BYTES)
        coded = w.dictionary_encode()
        self.vocabulary = coded.dictionary
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seen: dict[int, dict[bytes, int]] = {}
        owners: list[set[int]] = []
        names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(names)}
        edge = at.bounds(row, len(items))
        for k, (item, _) in enumerate(items):
            own = ids[edge[k] : edge[k + 1]]
            m = min(width, len(own))
            for i in range(len(own) - m + 1 if m else 0):
                at_m = seen.setdefault(m, {})
                p = at_m.setdefault(own[i : i + m].tobytes(), len(owners))
                if p == len(owners):
                    owners.append(set())
                owners[p].add(number[item])
        self.names = names
        self.groups = [Group(np.stack([np.frombuffer(x, np.int64) for x in g]), np.array(list(g.values()))) for g in seen.values()]
        self.owner = np.array([x for o in owners for x in sorted(o)], np.int64)
        self.owner_at = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)


def scan_slice(texts: pa.Array, before: list, tables: Patterns) -> tuple[list, list, list, list]:
    """Words, hit words, merged spans and item ids of each text; `before` has (spans, items) of earlier blocks."""
    w, row = at.words(texts, WORD_BYTES)
    n = len(texts)
    edge = at.bounds(row, n)
    known = pc.fill_null(pc.index_in(w, tables.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    # One unknown word between texts, so that no window crosses an end.
    flat = np.full(len(known) + n, -1, np.int64)
    flat[np.arange(len(known)) + row] = known
    first = edge[:-1] + np.arange(n)
    mark = np.zeros(len(flat) + 1, np.int32)
    pairs = []
    for g in tables.groups:
        ends, patterns = g.search(flat)
        np.add.at(mark, ends - g.m + 1, 1), np.add.at(mark, ends + 1, -1)
        doc = np.searchsorted(first, ends, "right") - 1
        pairs.append(np.unique(np.stack([doc, patterns], axis=1), axis=0) if len(ends) else np.zeros((0, 2), np.int64))
    items: list[set] = [set(i) for _, i in before]
    for doc, p in np.concatenate(pairs or [np.zeros((0, 2), np.int64)]):
        items[doc].update(tables.names[k] for k in tables.owner[tables.owner_at[p] : tables.owner_at[p + 1]])
    for k, (spans, _) in enumerate(before):
        if spans:
            np.add.at(mark, np.array(spans[0::2]) + first[k], 1), np.add.at(mark, np.array(spans[1::2]) + first[k], -1)
    hit = (np.cumsum(mark[:-1]) > 0).astype(np.int8)
    step = np.diff(np.concatenate([[0], hit, [0]]))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    of = np.searchsorted(first, starts, "right") - 1
    spans: list[list] = [[] for _ in range(n)]
    for d, i, j in zip(of, starts - first[of] if len(of) else of, stops - first[of] if len(of) else of):
        spans[d] += [int(i), int(j)]
    hits = [sum(s[1::2]) - sum(s[0::2]) for s in spans]
    return np.diff(edge).tolist(), hits, spans, [sorted(x) for x in items]


SCHEMA = "doc_id {id}, {carry}n_words long, n_hit long, spans array<long>, items array<string>"


def scan(docs: DataFrame, tables, carry: bool) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    later = "spans" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "text"):
            before = list(zip(part.column("spans").to_pylist(), part.column("items").to_pylist())) if later else [((), ())] * part.num_rows
            words, hits, spans, items = scan_slice(part.column("text"), before, tables.value)
            text = {"text": part.column("text")} if carry else {}
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), **text, "n_words": pa.array(words, pa.int64()), "n_hit": pa.array(hits, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string())),
            })

    return docs.mapInArrow(run, SCHEMA.format(id=kind, carry="text string, " if carry else ""))


def pattern_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, width: int, block_words: int) -> list:
    """Broadcast tables of the benchmark's patterns, each of about block_words words at most."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).dropna()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_words)))
    out = []
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
        out.append(docs.sparkSession.sparkContext.broadcast(Patterns([(r.item, r.text) for r in rows], width)))
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = 10, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, contaminated for every row of `docs`."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = pattern_blocks(docs, benchmark, item_col, item_text_col, width, block_words)
    for k, tables in enumerate(blocks):
        last = k == len(blocks) - 1
        out = scan(out, tables, carry=not last)
        out = out if last else materialise(out.select("doc_id", "text", "spans", "items"), "hits")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean_rows(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 10, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All columns of the rows whose text has no occurrence of a benchmark window."""
    for tables in pattern_blocks(docs, benchmark, item_col, item_text_col, width, block_words):

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for part in at.slices(batches, text_col):
                _, hits, _, _ = scan_slice(part.column(text_col).cast(pa.string()), [((), ())] * part.num_rows, tables.value)
                yield part.filter(pa.array([h == 0 for h in hits], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
