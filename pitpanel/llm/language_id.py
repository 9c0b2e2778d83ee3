"""Language of whole texts by a bidirectional gated recurrent network over bytes, trained here in numpy.

A text is read in segments of SEGMENT bytes (A-Z lower-cased). A forward and a backward recurrent layer read
each segment, every position gets a probability per language, and a document's probabilities are the mean over
its letter positions, all segments included. Gates are piecewise linear and the candidate is softsign, so
that a step costs only additions and products.

Training: back-propagation through time on the driver, over up to two segments of each of TRAIN_DOCS documents.
They are those with the smallest products of a hash of the id and the size of their language, so that languages have
even shares; of more than MAX_LANGUAGES languages the most frequent ones are learned. Only text and language are seen.

Output, one row per input row: doc_id, lang_pred, score (probability of lang_pred, 0 to 1).

Defined cases. Null or empty text, or no letter: `und` with score 0. No labelled text: `und` for all. Null id:
passed through, hashed as null. Ties: the language first by name. Repeated rows: one result each. Empty table: no
rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pitpanel.llm import arrowtext as at

SEGMENT = 64
HIDDEN = 8
PAD = 256
LANES = 4096
TRAIN_DOCS = 4096
MAX_LANGUAGES = 200
UNKNOWN = "und"

LETTER = np.zeros(257, np.float32)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([segment, position] byte numbers, text number of each segment); the last segment of a text is padded."""
    count = -(-np.diff(offsets) // SEGMENT)
    row = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    start = offsets[row] + (np.arange(len(row)) - first[row]) * SEGMENT
    place = start[:, None] + np.arange(SEGMENT)[None, :]
    inside = place < offsets[row + 1][:, None]
    if not len(row):
        return np.zeros((0, SEGMENT), np.int64), row
    return np.where(inside, at.LOWER[data[np.minimum(place, len(data) - 1)]].astype(np.int64), PAD), row


class Network:
    """Weights by name; columns are lanes, so every product is one matrix product."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, max(1, len(languages))
        self.languages = languages
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.3, (3 * h, PAD + 1)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 0.3, (3 * h, h)).astype(np.float32)
            self.w[f"o{d}"] = rng.normal(0, 0.3, (n, h)).astype(np.float32)
        self.w["c"] = np.zeros((n, 1), np.float32)

    def layer(self, x: np.ndarray, d: str, keep: list | None = None) -> list[np.ndarray]:
        """States after each position of x[position, lane]; the backward layer runs from the end."""
        h = HIDDEN
        state = np.zeros((h, x.shape[1]), np.float32)
        out: list = [None] * len(x)
        wx, wh = self.w[f"x{d}"], self.w[f"h{d}"]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = np.take(wx, x[t], axis=1)
            a[: 2 * h] += wh[: 2 * h] @ state
            gate = a[: 2 * h]
            gate *= 0.25
            gate += 0.5
            np.clip(gate, 0, 1, out=gate)
            u, r = gate[:h], gate[h:]
            rs = r * state
            q = a[2 * h :]
            q += wh[2 * h :] @ rs
            s = np.abs(q)
            s += 1
            c = q / s
            if keep is not None:
                keep.append((t, state, u.copy(), r.copy(), rs, s, c))
            c = c - state if keep is not None else np.subtract(c, state, out=c)
            c *= u
            state = state + c
            out[t] = state
        return out

    def probabilities(self, forward: list, backward: list, t: int) -> np.ndarray:
        z = self.w["of"] @ forward[t] + self.w["ob"] @ backward[t] + self.w["c"]
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all positions, by back-propagation through time."""
        keep: dict[str, list] = {"f": [], "b": []}
        states = {d: self.layer(x, d, keep[d]) for d in "fb"}
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        lanes = np.arange(x.shape[1])
        total = weight.sum() + 1e-6
        errors = []
        for t in range(len(x)):
            p = self.probabilities(states["f"], states["b"], t)
            p[y, lanes] -= 1
            p *= weight[t] / total
            errors.append(p)
            g["c"] += p.sum(axis=1, keepdims=True)
            for d in "fb":
                g[f"o{d}"] += p @ states[d][t].T
        h = HIDDEN
        for d in "fb":
            wh = self.w[f"h{d}"]
            back = np.zeros_like(states[d][0])
            for t, before, u, r, rs, s, c in reversed(keep[d]):
                back = back + self.w[f"o{d}"].T @ errors[t]
                dq = back * u / (s * s)
                du = back * (c - before) * 0.25 * ((u > 0) & (u < 1))
                drs = wh[2 * h :].T @ dq
                dr = drs * before * 0.25 * ((r > 0) & (r < 1))
                a = np.concatenate([du, dr, dq])
                g[f"h{d}"][: 2 * h] += a[: 2 * h] @ before.T
                g[f"h{d}"][2 * h :] += dq @ rs.T
                for k in range(3 * h):
                    g[f"x{d}"][k] += np.bincount(x[t], a[k], PAD + 1)
                back = back * (1 - u) + drs * r + wh[: 2 * h].T @ a[: 2 * h]
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 512, rate: float = 0.02, seed: int = 2) -> "Network":
        """x[segment, position], y[segment]; Adam with clipped gradients, each language drawn alike."""
        rng = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        share = 1.0 / np.bincount(y, minlength=len(self.languages))[y]
        share /= share.sum()
        for i in range(1, steps + 1):
            rows = rng.choice(len(x), min(batch, len(x)), p=share)
            part = np.ascontiguousarray(x[rows].T)
            g = self.gradients(part, y[rows], LETTER[part])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in self.w.items():
                one, two = moments[k]
                step = g[k] * min(1.0, 1.0 / (norm + 1e-12))
                one += 0.1 * (step - one)
                two += 0.01 * (step * step - two)
                v -= (rate * (1 - 0.9 * i / steps)) * (one / (1 - 0.9**i)) / (np.sqrt(two / (1 - 0.99**i)) + 1e-8)
        return self

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """[text, language]: mean probability over the letter positions of each whole text; zeros without one."""
        data, offsets = at.flat(texts)
        n = len(texts)
        sums = np.zeros((n, len(self.languages)))
        weight = np.zeros(n)
        x, row = segments(data, offsets)
        for i in range(0, len(x), LANES):
            part, own = np.ascontiguousarray(x[i : i + LANES].T), row[i : i + LANES]
            forward, backward = self.layer(part, "f"), self.layer(part, "b")
            letter = LETTER[part]
            total = np.zeros((len(self.languages), part.shape[1]), np.float32)
            for t in range(SEGMENT):
                p = self.probabilities(forward, backward, t)
                p *= letter[t]
                total += p
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(own, total[k], n)
            weight += np.bincount(own, letter.sum(axis=0), n)
        return sums / np.maximum(weight, 1)[:, None]


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Network:
    """A network for `docs` (doc_id, text, lang), all of whose rows may be learned from."""
    labelled = docs.filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    languages = sorted(counts)
    net = Network(languages)
    if not languages:
        return net
    size = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(float(v)))])
    h = F.xxhash64(F.lit(3), "doc_id")
    ranked = labelled.select("text", "lang", h.alias("h"), (size[F.col("lang")] * (F.shiftrightunsigned(h, 11) / float(1 << 53))).alias("u")).filter("u is not null")
    edge = ranked.select("u").orderBy("u").limit(train_docs).agg(F.max("u")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x, row = segments(*at.flat(part.column("text")))
            bounds = at.bounds(row, part.num_rows)
            found, lang = [], []
            for k, (salt, name) in enumerate(zip(part.column("h").to_pylist(), part.column("lang").to_pylist())):
                own = np.arange(bounds[k], bounds[k + 1])
                for i in sorted({salt % len(own), (salt // 7919) % len(own)}) if len(own) else ():
                    if LETTER[x[own[i]]].any():
                        found.append(x[own[i]].astype(np.uint16).tobytes()), lang.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(lang, pa.string())], ["x", "lang"])

    rows = sorted((bytes(r.x), r.lang) for r in ranked.filter(F.col("u") <= edge).mapInArrow(run, "x binary, lang string").collect())
    if not rows:
        return Network([])
    x = np.stack([np.frombuffer(b, np.uint16) for b, _ in rows]).astype(np.int64)
    return net.train(x, np.array([languages.index(k) for _, k in rows]))


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "text"):
            lang, score = verdicts(part.column("text"), shared.value)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def verdicts(texts: pa.Array, net: Network) -> tuple[list[str], list[float]]:
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
    p = net.pooled(texts)
    best = p.argmax(axis=1) if net.languages else np.zeros(len(texts), np.int64)
    known = [bool(ok and net.languages and p[k].any()) for k, ok in enumerate(letters)]
    return (
        [net.languages[best[k]] if ok else UNKNOWN for k, ok in enumerate(known)],
        [min(1.0, float(p[k, best[k]])) if ok else 0.0 for k, ok in enumerate(known)],
    )


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_from: Column | None = None,
    train_docs: int = TRAIN_DOCS,
) -> DataFrame:
    """doc_id, lang_pred, score for every row; learns from the rows where `learn_from` (a condition on doc_id) holds."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    net = learn(texts if learn_from is None else texts.filter(learn_from), train_docs)
    return predict(texts, net)


def in_known_language(docs: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """All columns of the rows whose text has letters and a language of probability `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, text_col):
            lang, score = verdicts(part.column(text_col).cast(pa.string()), shared.value)
            yield part.filter(pa.array([k != UNKNOWN and s >= least for k, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
