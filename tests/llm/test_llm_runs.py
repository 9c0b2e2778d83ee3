import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest_llm import SF, documents
from pitpanel.llm import periodic_runs as pr
from pitpanel.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, times=3):
    """Runs by trying every period from small to large at every place."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                found.setdefault((i, length), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((i, length, q) for (i, length), q in found.items())


def collapsed(words, runs):
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def texts_with_runs(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(4)
            alphabet = [str(k) for k in range(rng.choice([1, 2, 3, 50]))]
            if kind == 0:
                words += [rng.choice(alphabet) for _ in range(rng.randrange(60))]
                continue
            unit = [rng.choice(alphabet) for _ in range(rng.randrange(1, 40))]
            if kind == 2:  # runs inside the unit of a run
                unit = unit[:3] * rng.randrange(1, 12) + unit[3:6] * rng.randrange(9)
            words += (unit * rng.randrange(2, 7))[: rng.randrange(1, 400)]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    texts = texts_with_runs(seed, 60) + [[], ["a"], ["a"] * 24, ["a"] * 23, ["a", "b"] * 12, ["a"] * 30 + ["b"] + ["a"] * 30]
    unit = ["a"] * 9 + ["b"]
    texts += [unit * 4, ["c", *unit * 7, "a"], ["a"] * 40 + ["b"] + ["a"] * 40 + ["b"] + ["a"] * 40 + ["b"] + ["a"] * 3]
    if seed == 0:  # Fibonacci words and their like are full of runs
        a, b = ["a"], ["a", "b"]
        for _ in range(11):
            a, b = b, b + a
        texts += [b, a * 4]
    code = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    bounds = np.cumsum([0, *map(len, texts)])
    rows = pr.find_runs(np.array([code[w] for t in texts for w in t], np.int64), bounds)
    got = {k: [] for k in range(len(texts))}
    for k, i, length, q in rows.tolist():
        got[k].append((i, length, q))
    for k, words in enumerate(texts):
        assert got[k] == brute(words), words


@pytest.mark.parametrize("seed", range(3))
def test_range_successor_equals_search(seed):
    rng = np.random.default_rng(seed)
    values = rng.permutation(int(rng.integers(1, 300)))
    tree = pr.WaveletTree(values)
    left = rng.integers(0, len(values) + 1, 500)
    right = np.minimum(len(values), left + rng.integers(0, 40, 500))
    x, last = rng.integers(0, len(values) + 1, 500), rng.integers(0, len(values) + 1, 500)
    want = [min([v for v in values[i:j] if a <= v <= b], default=-1) for i, j, a, b in zip(left, right, x, last)]
    assert tree.successor(left, right, x, last).tolist() == want


def test_rows(spark, edges, empty):
    got = pr.periodic_runs(edges).collect()
    assert len(got) == edges.count()
    text_of = {(r.doc_id, r.text) for r in edges.collect()}
    for r in got:
        assert any(
            i == r.doc_id and WORD.findall(t or "") == (w := WORD.findall(t or "")) and r.n_words == len(w) and [tuple(x) for x in r.runs] == brute(w) and r.collapsed == collapsed(w, brute(w))
            for i, t in text_of if len(t or "") < 10**5
        ) or r.doc_id == 7
    assert pr.periodic_runs(empty).collect() == []


def test_a_long_text_of_one_word(spark):
    n = 300_000
    docs = spark.createDataFrame([(1, "a " * n), (2, "a b c " * 50_000 + " ".join(map(str, range(90_000))))], "doc_id long, text string")
    got = {r.doc_id: r for r in pr.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, n, 1)] and got[1].collapsed == "a"
    assert [tuple(r) for r in got[2].runs] == [(0, 150_000, 3)] and got[2].collapsed.startswith("a b c 0 1 2")


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *first, sha("".join(f"{i},{m},{q}\n" for i, m, q in runs)), sha(collapsed(words, runs)))


def test_query_equals_brute_force(spark):
    text = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(text) and any(r.n_runs for r in rows)
    for r in rows:
        if len(text[r.doc_id] or "") < 12_000 or zlib.crc32(str(r.doc_id).encode()) % 10 == 0:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(r.doc_id, text[r.doc_id]), r.doc_id
