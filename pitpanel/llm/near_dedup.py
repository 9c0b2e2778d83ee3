"""Near-duplicate documents: MinHash bands, signature check, full-set check, large-star / small-star components.

Input: any frame with an id column (bigint) and a text column. Output: one row per input row with
doc_id, n_shingles, component_id, kept.

Defined cases. Null or word-free text: n_shingles 0, alone in its component, kept. Fewer words than the
width: the whole sequence is the one shingle. Null id: component_id null, linked with nothing, kept. Rows
that repeat an id are one document, whose rows share a component. Ties: the component's name is its
smallest id. Empty table: no rows. Other columns of the input are ignored.

How. Documents with equal shingle sets are one class (grouped by a digest of the set), and only the smallest
id of a class goes on, so thousands of copies cost one row. In a band's bucket every class is paired with the
bucket's smallest id, its head, only, and their full sets are compared. Pairs over the threshold are links.
After the components of these links are known, a bucket that still holds several components has the members
outside its largest component compared with the members of other components, unless what each of the two lacks of the
bucket's head and has beside it already rules the pair out; buckets that are one component, which holds for groups of copies however large,
cost nothing more. No candidate is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pitpanel.llm import arrowtext as at
from pitpanel.session import materialise

#: At least so many bands, and as many more as it takes for a pair at the threshold to miss all with probability MISS
#: at most: (1 - 0.85**5)**25 = 4e-7, and 35 bands at 0.8.
BANDS, ROWS, MISS = 25, 5, 1e-6
#: Minima in a signature.
HASHES = 256
SKETCH = tuple(f"s{i}" for i in range(8))
#: Words of the bit masks of what a set has beside another one, and of what it lacks of it.
MASK, LACK = tuple(f"m{i}" for i in range(16)), tuple(f"l{i}" for i in range(16))
#: A pair at the threshold has fewer equal signature bits than `agreeing` asks for by a deviation of so many sigmas.
SIGMAS = 5


def coefficients(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def bands_for(percent: int) -> int:
    meet = (percent / 100) ** ROWS
    return BANDS if meet >= 1 else max(BANDS, math.ceil(math.log(MISS) / math.log1p(-meet)))


def agreeing(percent: int) -> int:
    """Least number of equal bits, of two per minimum, for a pair that may pass: 437 of 512 at 0.85, 420 at 0.8.

    Equal minima agree in both bits, others in each by chance.
    """
    s = percent / 100
    deviation = 2 * math.sqrt(HASHES * (s * (1 - s) / 4 + (1 - s) / 8))
    return math.floor(HASHES * (1 + s) - SIGMAS * deviation)


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every shingle, offsets by text), repeats included."""
    w, row = at.words(texts)
    n = len(texts)
    coded = w.dictionary_encode()
    by_word = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = by_word[coded.indices.to_numpy(zero_copy_only=False)]
    start = at.bounds(row, n)
    size = np.diff(start)
    count = np.where(size >= width, size - width + 1, (size > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(start[:-1] - out[:-1], count) + np.arange(out[-1])
    last = np.repeat(start[1:], count)
    acc = np.zeros(out[-1], np.uint64)
    for i in range(width):
        at_i = first + i
        inside = at_i < last
        acc = np.where(inside, at.mix(acc + np.uint64(0x9E3779B97F4A7C15)) ^ h[np.where(inside, at_i, 0)], acc) if len(h) else acc
    return at.mix(acc), out


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    h, o = shingle_hashes(texts, width)
    return [np.unique(h[i:j]) for i, j in zip(o, o[1:])]


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(x), 1024):
        np.minimum(best, (a[:, None] * x[None, i : i + 1024] + b[:, None]).min(axis=1), out=best)
    return best


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def features(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch words, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(max(HASHES, bands * ROWS))
        band = at.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for part in at.slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            digest, keys, sketch = [], [], []
            for s in sets:
                if not len(s):
                    digest.append(None), keys.append([]), sketch.append([0] * len(SKETCH))
                    continue
                m = at.mix(minima(s, a, b))
                k = band.copy()
                for r in range(ROWS):
                    k = at.mix(k ^ m[r : bands * ROWS : ROWS])
                first = m[:HASHES]
                bits = np.packbits(np.stack([first >> np.uint64(11) & np.uint64(1), first >> np.uint64(43) & np.uint64(1)]).astype(np.uint8).ravel())
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(signed(k))
                sketch.append(bits.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())]
                + [pa.array([int(s[i]) for s in sketch], pa.int64()) for i in range(len(SKETCH))]
                + [pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", *SKETCH, "keys"],
            )

    ddl = "doc_id long, n_shingles long, digest binary, " + ", ".join(f"{s} long" for s in SKETCH) + ", keys array<long>"
    return docs.mapInArrow(run, ddl)


def set_blobs(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and its sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "text"):
            blobs = [s.tobytes() for s in shingle_sets(part.column("text"), width)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "blob"])

    return docs.mapInArrow(run, "doc_id long, blob binary")


def set_bits(words: np.ndarray, hashes: np.ndarray) -> None:
    word = (hashes >> np.uint64(6)) % np.uint64(len(words))
    np.bitwise_or.at(words, word.astype(np.int64), np.uint64(1) << (hashes & np.uint64(63)))


def shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, both: sizes of the two full sets and of their intersection; mask words: a bit for each hash of b that a lacks, and of a that b lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n_a, n_b, both = [], [], []
            mask, lack = np.zeros((2, part.num_rows, len(MASK)), np.uint64)
            for k, (x, y) in enumerate(zip(part.column("blob_a"), part.column("blob_b"))):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                extra = np.setdiff1d(v, u, assume_unique=True)
                n_a.append(len(u)), n_b.append(len(v)), both.append(len(v) - len(extra))
                set_bits(mask[k], extra), set_bits(lack[k], np.setdiff1d(u, v, assume_unique=True))
            out = {"a": part.column("a"), "b": part.column("b")} | {k: pa.array(x, pa.int64()) for k, x in (("n_a", n_a), ("n_b", n_b), ("both", both))}
            yield pa.RecordBatch.from_pydict(out | {c: pa.array(signed(np.ascontiguousarray(w[:, i]))) for names, w in ((MASK, mask), (LACK, lack)) for i, c in enumerate(names)})

    side = lambda s: sets.select(F.col("doc_id").alias(s), F.col("blob").alias(f"blob_{s}"))
    found = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "blob_a", "blob_b")
    return found.mapInArrow(run, "a long, b long, n_a long, n_b long, both long, " + ", ".join(f"{m} long" for m in (*MASK, *LACK)))


def passes(both, n_a, n_b, percent: int):
    return 100 * both >= percent * (n_a + n_b - both)


def components(links: DataFrame) -> DataFrame:
    """node, component: alternating large-star and small-star until the edges no longer change.

    Every round is written to the shared folder; only a count and a checksum reach the driver.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "edges")
        before, seen = seen, mark(edges)
        if before == seen:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def alike(a: str, b: str, percent: int):
    """What two signatures must show before the full sets are compared; never false for a pair over the threshold but by chance."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{a}.{SKETCH[0]}").bitwiseXOR(F.col(f"{b}.{SKETCH[0]}"))))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= 2 * HASHES - agreeing(percent))


def possible(a: str, b: str, percent: int):
    """False where two sets of a bucket cannot pass, as their differences from the bucket's head show; a set and the head were compared before.

    As many bits as two masks have together, so many different hashes there are at least: the head's hashes that either
    set lacks are in no intersection, and those beside the head are shared no more than their number exceeds the bits.
    """
    n, m, i, j = (F.col(f"{x}.{c}") for c in ("n_shingles", "inside") for x in (a, b))
    either = lambda words: sum((F.bit_count(F.col(f"{a}.{w}").bitwiseOR(F.col(f"{b}.{w}"))) for w in words[1:]), F.bit_count(F.col(f"{a}.{words[0]}").bitwiseOR(F.col(f"{b}.{words[0]}"))))
    inside = F.least(i, j, F.col(f"{a}.n_head") - either(LACK))
    outside = F.least(n - i, m - j, n - i + m - j - either(MASK))
    compared = (F.col(f"{a}.rep") == F.col(f"{a}.head")) | (F.col(f"{b}.rep") == F.col(f"{b}.head"))
    return ~compared & passes(inside + outside, n, m, percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links have 100 * intersection >= percent * union."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = materialise(features(texts, width, bands_for(percent)), "features")
    classes = materialise(
        feats.filter("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), *[F.first(s).alias(s) for s in SKETCH], F.first("keys").alias("keys")),
        "classes",
    )
    rows = classes.select("rep", F.explode("keys").alias("key"))
    heads = rows.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("size")).filter("size > 1").drop("size")
    met = materialise(rows.join(heads, "key").select("key", "rep", "head"), "met")

    reps = met.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialise(set_blobs(texts.join(reps, "doc_id"), width).groupBy("doc_id").agg(F.first("blob").alias("blob")), "sets")
    traits = classes.select("rep", "n_shingles", "keys", *SKETCH)
    star = materialise(shared(met.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), sets), "star")
    links = star.filter(passes(F.col("both"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")

    # Buckets that still hold several components: their minority against the other components.
    found = components(links)
    placed = met.join(found, met.rep == found.node, "left").select("key", "rep", "head", F.coalesce("component", "rep").alias("c"))
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("top"), F.count("*").alias("k")).filter("k > 1").select("key", F.col("top.c").alias("main"))
    to_head = star.select(F.col("a").alias("head"), F.col("b").alias("rep"), F.col("n_a").alias("n_head"), F.col("both").alias("inside"), *MASK, *LACK)
    none = F.lit(0).cast("long")
    mixed = placed.join(main, "key").join(traits, "rep").join(to_head, ["head", "rep"], "left").select(
        "key", "rep", "head", "c", "main", "n_shingles", F.expr("slice(keys, 1, cast(array_position(keys, key) - 1 as int))").alias("earlier"), *SKETCH,
        *[F.coalesce(x, "n_shingles").alias(x) for x in ("n_head", "inside")], *[F.coalesce(x, none).alias(x) for x in (*MASK, *LACK)],
    )
    mixed = materialise(mixed, "mixed")
    rest = (
        mixed.filter("c <> main").alias("x")
        .join(
            mixed.alias("y"),
            (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c"))
            & ((F.col("y.c") == F.col("y.main")) | (F.col("y.rep") < F.col("x.rep"))) & alike("x", "y", percent) & possible("x", "y", percent)
            & ~F.arrays_overlap("x.earlier", "y.earlier"),  # a pair comes out of the first bucket that it shares
        )
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    )
    more = shared(rest, sets).filter(passes(F.col("both"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    named = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))

    of_class = classes.join(named, classes.rep == named.node, "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return (
        feats.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
