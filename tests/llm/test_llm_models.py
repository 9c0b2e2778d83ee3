import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import documents
from pitpanel.llm import language_id as li, lm_score as lm
from pitpanel.llm.queries import held_out
from pyspark.sql import functions as F

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def small_network(n=3):
    net = li.Network([f"l{i}" for i in range(n)], seed=5)
    return net


def test_gradients_by_differences():
    net = small_network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 123, (7, 4)), np.array([0, 1, 2, 1])
    weight = li.LETTER[x].astype(np.float64)

    def loss():
        f, b = net.layer(x, "f"), net.layer(x, "b")
        return -sum(np.log(net.probabilities(f, b, t)[y, np.arange(4)]).sum() for t in range(7)) / (weight.sum() + 1e-6)

    g = net.gradients(x, y, weight)
    for name in net.w:
        w = net.w[name]
        for k in rng.choice(w.size, 6):
            at = np.unravel_index(k, w.shape)
            if name[0] == "x":
                at = (at[0], x[rng.integers(7), rng.integers(4)])
            old, h = w[at], 1e-4
            w[at] = old + h
            up = loss()
            w[at] = old - h
            down = loss()
            w[at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-4), name


def test_language_held_out(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in li.languages(docs, learn_from=~held_out(F.col("doc_id"), 5)).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang]
    assert np.mean([a == b for a, b in held]) > 0.9 and all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(edges, empty):
    rows = li.languages(edges, train_docs=50).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == edges.count()
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3, 4)) and by[8].lang_pred in {"en", "fr", "de"}
    assert li.languages(empty).collect() == []
    assert {r.lang_pred for r in li.languages(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_whole_text_counts():
    """The last segment weighs as much as the first."""
    net = small_network(2)
    net.w["c"][:] = 0
    long = net.pooled(pa.array(["a" * 64 + "b" * 64]))[0]
    parts = (net.pooled(pa.array(["a" * 64]))[0] + net.pooled(pa.array(["b" * 64]))[0]) / 2
    assert np.allclose(long, parts, atol=1e-5)


class Tree:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, streams, depth):
        self.depth, self.count, self.kids = depth, collections.Counter(), collections.defaultdict(set)
        for s in streams:
            for p in range(depth, len(s)):
                for j in range(8):
                    node, bit = (1 << j) | (s[p] >> (8 - j)), s[p] >> (7 - j) & 1
                    for d in range(depth + 1):
                        self.count[s[p - d : p], node, bit] += 1
                        if d:
                            self.kids[s[p - d + 1 : p], node].add(s[p - d : p])
        self.memo = {}

    def own(self, c, node):
        a, b = self.count[c, node, 0], self.count[c, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, c, node):
        return sum(self.all(k, node) for k in self.kids[c, node])

    def all(self, c, node):
        if (c, node) not in self.memo:
            o = self.own(c, node)
            self.memo[c, node] = o if len(c) == self.depth else np.logaddexp(o, self.below(c, node)) - math.log(2)
        return self.memo[c, node]

    def one(self, s, p, node, d=0):
        c = s[p - d : p]
        a, b = self.count[c, node, 0], self.count[c, node, 1]
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        w = 1 / (1 + math.exp(min(700, self.below(c, node) - self.own(c, node))))
        return w * own + (1 - w) * self.one(s, p, node, d + 1)

    def score(self, s):
        total = 0
        for p in range(self.depth, len(s)):
            for j in range(8):
                one = self.one(s, p, (1 << j) | (s[p] >> (8 - j)))
                total += math.log10(one if s[p] >> (7 - j) & 1 else 1 - one)
        return total


def test_scores_match_recursion_with_and_without_joins(spark, monkeypatch):
    texts = {1: "The cat sat.", 2: None, 3: "", 10: "the  cat\nsat on The mat", 4: "é ünd the", 5: "a the cat sat on a mat", 6: "qq zz", 7: " the\t", 8: "mat the cat"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW)) for i, t in texts.items()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    streams = {i: b"\n" * lm.DEPTH + "".join(x + " " for x in w).encode() + b"\n" for i, w in words.items()}
    tree = Tree([streams[i] for i in train], lm.DEPTH)
    c = collections.Counter(x for i in train for x in [*words[i], "\n"])
    n, v = sum(c.values()), len(c)
    for hot in (1 << 19, 2):
        monkeypatch.setattr(lm, "HOT_TOKENS", hot), monkeypatch.setattr(lm, "HOT_GRAMS", hot)
        for r in lm.scores(d, learn_from=~held_out(F.col("doc_id"), 10)).collect():
            w = [*words[r.doc_id], "\n"]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            assert r.score == pytest.approx(tree.score(streams[r.doc_id]), rel=1e-6)


def test_score_edges(edges, empty):
    rows = lm.scores(edges).collect()
    assert len(rows) == edges.count() and all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert lm.scores(empty).collect() == []
    none = lm.scores(edges, learn_from=F.lit(False)).collect()
    assert all(r.base_score is None and r.n_known == 0 for r in none)
    one = [r for r in none if r.doc_id == 2][0]
    assert one.score == pytest.approx(8 * math.log10(0.5))
