"""Log-probabilities of whole texts: a smoothed word base and context-tree weighting over bytes.

Text as the model reads it: A-Z lower-cased, every word followed by one space, then a line feed as the end.
A byte is eight binary choices; the state of a choice is the bits already seen of its byte. For each state and
every depth 0..DEPTH, the preceding bytes are the context. A node holds the training counts of both outcomes; its
Krichevsky-Trofimov estimate is mixed with what the deeper contexts say, by the weights of context-tree
weighting, which come from the block probabilities below the node. A choice that training never saw has
probability one half at that node, so that every text has a proper probability.

Counts per (context, byte) are grouped over the corpus; they go up the tree level by level, and mixed probabilities
come down. What a text needs is then a look-up per distinct (context, byte). Rows common
enough, at most HOT_TOKENS words and HOT_GRAMS byte sequences, are sent to the tasks; all others are joined by key.

Output, one row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10).

Defined cases. Null or empty text: only the end. Null id: passed through. No training rows: counts are 0, base_score
is null, every bit has probability one half. Repeated rows: one result each. Empty table: no rows. Other columns of
the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pitpanel.llm import arrowtext as at
from pitpanel.session import materialise

DEPTH = 5
HOT_TOKENS = 1 << 18
HOT_GRAMS = 1 << 20
#: Distinct byte sequences that a task gathers before it hands them on.
GATHER = 1 << 20
#: Bytes of text that are worked on at once; about fifty times as much memory is in use meanwhile.
SLICE = 1 << 20
#: Rows of the tree that a task works on at once (more only where one pair of last bytes has more).
TREE_ROWS = 50_000
END = "\n"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte with the DEPTH bytes before it, text number of each)."""
    data, offsets = at.flat(texts)
    white = at.WHITE[data]
    keep = ~white
    keep[1:] |= white[1:] & ~white[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    keep[starts] = ~white[starts]
    total = np.concatenate([[0], np.cumsum(keep)])
    clean = np.where(white, np.uint8(0x20), at.LOWER[data])[keep]
    edge = total[offsets]
    head, space, end = np.full(DEPTH, 10, np.uint8), np.array([32, 10], np.uint8), np.array([10], np.uint8)
    parts = []
    for i, j in zip(edge, edge[1:]):
        parts += [head, clean[i:j], space if j > i and clean[j - 1] != 32 else end]
    stream = np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, 3).sum(axis=1) - DEPTH
    first = np.cumsum(size + DEPTH) - size
    place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    code = np.zeros(len(stream), np.uint64)
    for k in range(DEPTH + 1):
        code[DEPTH:] |= stream[DEPTH - k : len(stream) - k] << np.uint64(8 * k)
    return code[place], np.repeat(np.arange(len(size), dtype=np.int32), size)


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    at_new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[at_new], np.diff(np.append(at_new, len(ordered)))


def count_grams(docs: DataFrame) -> DataFrame:
    """gram, n: how often each byte with its context occurs in training rows; 0 for those of other rows only."""

    def merged(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        c, n = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(c, kind="stable")
        c, n = c[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        return c[new], np.add.reduceat(n, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0
        out = lambda: pa.RecordBatch.from_pydict({"gram": pa.array(codes[0].view(np.int64)), "n": pa.array(counts[0])})
        for part in at.slices(batches, "text", SLICE):
            code, row = grams(part.column("text"))
            train = part.column("train").to_numpy(zero_copy_only=False)[row]
            for own, times in ((code[train], 1), (code[~train], 0)):
                if len(own):
                    c, n = runs(np.sort(own))
                    codes.append(c), counts.append(n * times)
                    held += len(c)
            if held > GATHER:
                c, n = merged(codes, counts)
                codes, counts, held = [c], [n], len(c)
                if held > GATHER // 2:
                    yield out()
                    codes, counts, held = [], [], 0
        if codes:
            c, n = merged(codes, counts)
            codes, counts = [c], [n]
            yield out()

    return docs.select("text", "train").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c: how often each word occurs in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "text", 2 * SLICE):
            w, _ = at.words(part.column("text"))
            if len(w):
                coded = w.dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_pydict({"token": coded.dictionary.cast(pa.string()), "c": pa.array(n.astype(np.int64))})

    return docs.filter("train").select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0, by Stirling's series eight steps higher."""
    z, down = x + 8, np.log(x)
    for k in range(1, 8):
        down += np.log(x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - down


class Level:
    """Nodes of one depth: counts of both outcomes, block probability with all below (natural log), weight of the own estimate."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.n0, self.n1 = n0, n1
        own = np.where(n0 + n1 == 0, 0.0, log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi))
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)
        self.all = own if below is None else np.logaddexp(own, below) - math.log(2)
        self.weight = np.ones(len(own)) if below is None else 1 / (1 + np.exp(np.minimum(below - own, 700)))

    def down(self, p: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a one so far, share left to deeper contexts), given both of the parents."""
        return p + rest * self.weight * self.one, rest * (1 - self.weight)


def grouped(parent: np.ndarray, n: int, child: Level) -> Level:
    return Level(np.bincount(parent, child.n0, n), np.bincount(parent, child.n1, n), np.bincount(parent, child.all, n))


class Subtrees:
    """All nodes of depth 2 and more above some whole sets of contexts with the same two last bytes."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        byte = (gram & np.uint64(255)).astype(np.int64)
        j = np.arange(8)[:, None]
        node = (1 << j) | (byte[None] >> (8 - j))
        self.bit = (byte[None] >> (7 - j)) & 1
        key = (gram >> np.uint64(8) << np.uint64(8))[None] | node.astype(np.uint64)
        keys, at_choice = np.unique(key.ravel(), return_inverse=True)
        times = np.broadcast_to(n.astype(np.float64), node.shape).ravel()
        one = self.bit.ravel() == 1
        self.levels = [Level(np.bincount(at_choice, times * ~one, len(keys)), np.bincount(at_choice, times * one, len(keys)), None)]
        self.parents = [at_choice]
        for depth in range(DEPTH - 1, 1, -1):
            up = keys & np.uint64((1 << 8 * (depth + 1)) - 1)
            keys, parent = np.unique(up, return_inverse=True)
            self.levels.append(grouped(parent, len(keys), self.levels[-1]))
            self.parents.append(parent)
        #: Last byte of the context and node of each node of depth 2.
        self.top = (keys & np.uint64(0xFFFF)).astype(np.int64)

    def log10p(self, p: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Of each byte, given what depth 1 hands down for each (last byte, node)."""
        p, rest = self.levels[-1].down(p[self.top], rest[self.top])
        for k in range(len(self.levels) - 2, -1, -1):
            p, rest = self.levels[k].down(p[self.parents[k + 1]], rest[self.parents[k + 1]])
        p = p[self.parents[0]].reshape(self.bit.shape)
        return np.log10(np.where(self.bit == 1, p, 1 - p)).sum(axis=0)


def by_suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of a partition ordered by the context's last two bytes, in runs that end with such a pair."""
    gram, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in batches:
        gram = np.concatenate([gram, part.column("gram").to_numpy().view(np.uint64)])
        n = np.concatenate([n, part.column("n").to_numpy()])
        if len(gram) > TREE_ROWS:
            pair = gram >> np.uint64(8) & np.uint64(0xFFFF)
            other = np.flatnonzero(pair != pair[-1])
            if len(other):
                k = int(other[-1]) + 1
                yield gram[:k], n[:k]
                gram, n = gram[k:], n[k:]
    if len(gram):
        yield gram, n


def model(counted: DataFrame) -> DataFrame:
    """gram, n, log10p: the mixed log-probability of each byte after its context.

    Nodes of depth 2 and more are worked out where the contexts with the same two last bytes lie together; what
    they say of depth 1, which has at most 256 * 255 nodes, is summed and handed down from there.
    """
    pair = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))
    parts = max(1, -(-counted.count() // TREE_ROWS))
    dealt = counted.withColumn("pair", pair).repartition(parts, "pair").sortWithinPartitions("pair").select("gram", "n")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in by_suffix(batches):
            t = Subtrees(gram, n)
            top = t.levels[-1]
            yield pa.RecordBatch.from_pydict({"node": pa.array(t.top), "n0": pa.array(top.n0), "n1": pa.array(top.n1), "below": pa.array(top.all)})

    sums = dealt.mapInArrow(up, "node long, n0 double, n1 double, below double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow()
    node = sums["node"].to_numpy()
    first = Level(*(sums[c].to_numpy() for c in ("n0", "n1", "below")))
    root = grouped(node & 255, 256, first)
    p, rest = np.full(1 << 16, 0.5), np.zeros(1 << 16)
    p[node], rest[node] = first.down(*(x[node & 255] for x in root.down(np.zeros(256), np.ones(256))))
    handed = counted.sparkSession.sparkContext.broadcast((p, rest))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in by_suffix(batches):
            yield pa.RecordBatch.from_pydict({"gram": pa.array(gram.view(np.int64)), "n": pa.array(n), "log10p": pa.array(Subtrees(gram, n).log10p(*handed.value))})

    return dealt.mapInArrow(down, "gram long, n long, log10p double")


def common(rows: DataFrame, count: str, most: int) -> int:
    """The least power of two such that at most `most` rows have so high a count."""
    got = rows.agg(*[F.sum(F.when(F.col(count) >= (1 << i), 1).otherwise(0)).alias(f"k{i}") for i in range(48)]).first()
    return next(1 << i for i in range(48) if (got[i] or 0) <= most)


SCORED = "rid long, doc_id {id}, token string, gram long, times long, n_tokens long, n_known long, base_score double, score double"


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_from: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row; learns where `learn_from` (on doc_id) holds."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("train", F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False)))
    spark = docs.sparkSession

    tokens = materialise(count_tokens(texts), "tokens")
    ends = texts.filter("train").count()
    words, distinct = tokens.agg(F.sum("c"), F.count("*")).first()
    all_tokens = (words or 0) + ends
    under = all_tokens + 0.1 * (distinct + bool(ends) + 1)
    known = lambda c: F.log10((c + 0.1) / under)
    hot = tokens.filter(F.col("c") >= common(tokens, "c", HOT_TOKENS)).toArrow()

    table = materialise(model(materialise(count_grams(texts), "grams")), "model")
    top = table.filter(F.col("n") >= common(table, "n", HOT_GRAMS)).select("gram", "log10p").toArrow()
    grams_at = np.sort(order := top["gram"].to_numpy())
    shared = spark.sparkContext.broadcast((
        hot["token"].combine_chunks().cast(pa.large_string()), np.log10((hot["c"].to_numpy() + 0.1) / under),
        grams_at.astype(np.uint64), top["log10p"].to_numpy()[np.argsort(order, kind="stable")],
    ))
    end_score, no_score = math.log10((ends + 0.1) / under), math.log10(0.1 / under)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values, codes, logs = shared.value
        for part in at.slices(batches, "text", SLICE):
            n = part.num_rows
            rid = part.column("rid")
            w, row = at.words(part.column("text"))
            place = pc.index_in(w, names)
            found = place.is_valid().to_numpy(zero_copy_only=False)
            at_hot = place.drop_null().to_numpy()
            base = np.bincount(row[found], values[at_hot], n) + end_score
            n_known = np.bincount(row[found], minlength=n) + (ends > 0)
            coded = w.filter(pa.array(~found)).dictionary_encode()
            key, times = runs(np.sort(row[~found].astype(np.uint64) << np.uint64(32) | coded.indices.to_numpy(zero_copy_only=False).astype(np.uint64)))
            rare, rare_row = coded.dictionary.take(pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64))), (key >> np.uint64(32)).astype(np.int64)

            code, row_g = grams(part.column("text"))
            key, n_g = runs(np.sort(code << np.uint64(16) | row_g.astype(np.uint64)))
            code, row_g = key >> np.uint64(16), (key & np.uint64(0xFFFF)).astype(np.int64)
            i = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            hit = codes[i] == code if len(codes) else np.zeros(len(code), bool)
            score = np.bincount(row_g[hit], n_g[hit] * logs[i[hit]], n)

            some = lambda m, **c: pa.RecordBatch.from_arrays([c.get(f.name, pa.nulls(m, f.type)) for f in kinds], schema=kinds)
            kinds = pa.schema([("rid", pa.int64()), ("doc_id", part.column("doc_id").type), ("token", pa.string()), ("gram", pa.int64()), ("times", pa.int64()),
                               ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
            yield some(n, rid=rid, doc_id=part.column("doc_id"), n_tokens=pa.array(np.bincount(row, minlength=n) + 1), n_known=pa.array(n_known.astype(np.int64)), base_score=pa.array(base), score=pa.array(score))
            if len(rare):
                yield some(len(rare), rid=rid.take(pa.array(rare_row)), token=rare.cast(pa.string()), times=pa.array(times))
            if not hit.all():
                yield some(int((~hit).sum()), rid=rid.take(pa.array(row_g[~hit])), gram=pa.array(code[~hit].view(np.int64)), times=pa.array(n_g[~hit]))

    kind = dict(texts.dtypes)["doc_id"]
    found = materialise(texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, SCORED.format(id=kind)), "scored")
    rare_tokens = found.filter("token is not null").select("rid", "token", "times").join(tokens, "token", "left").select(
        "rid", F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * F.coalesce(known(F.col("c")), F.lit(no_score))).alias("base_score"), F.lit(0.0).alias("score"),
    )
    rare_grams = found.filter("gram is not null").select("rid", "gram", "times").join(table.select("gram", "log10p"), "gram").select(
        "rid", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), (F.col("times") * F.col("log10p")).alias("score"),
    )
    sums = rare_tokens.union(rare_grams).groupBy("rid").agg(F.sum("n_known").alias("k"), F.sum("base_score").alias("b"), F.sum("score").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.filter("n_tokens is not null").join(sums, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"),
        F.when(F.lit(all_tokens > 0), F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
