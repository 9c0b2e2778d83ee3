import random
import re

import pytest
from conftest_llm import SF, documents
from pitpanel.llm import near_dedup as nd
from pyspark.sql import functions as F


def brute(rows, percent, width=5):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(base, edits, rng):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("percent", [80, 85])
def test_chains_of_near_copies_match_brute_force(spark, percent):
    """Near copies of one text, and copies of copies, so that many pairs are close to the threshold on both sides."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    texts = [base]
    for k in range(160):
        texts.append(edited(rng.choice(texts[: 1 + k // 2]) if k % 2 else base, rng.randrange(1, 6), rng))
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, " ".join(t)) for i, t in zip(order, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs, percent=percent).collect()}
    assert got == brute(rows, percent)


def test_given_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(documents(spark), percent=85).collect()}
    assert got == brute(rows, 85) and SF


def test_edges(edges, empty):
    got = nd.near_duplicates(edges, percent=80).collect()
    assert len(got) == edges.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[3].kept
    assert [by[i].component_id for i in (5, 6)] == [5, 5] and not by[6].kept
    assert (by[9].component_id, by[10].component_id) == (9, 9) and by[9].n_shingles == 1
    assert [r for r in got if r.doc_id is None][0].component_id is None
    assert nd.near_duplicates(empty).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {(r.node, r.component) for r in nd.components(links).collect()} == {(i, 0) for i in range(1, 60)}


def test_copies_of_one_text_that_are_no_links_are_ruled_out_before_they_are_pairs(spark, monkeypatch):
    """Copies whose base is missing meet in the bands, two by two under the threshold; few of them may become pairs."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    copies = [edited(base, 3, rng) for _ in range(80)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*copies, *[edited(copies[k], 1, rng) for k in range(8)]])]
    asked, compare = [], nd.shared

    def counted(pairs, sets):
        asked.append(pairs.count())
        return compare(pairs, sets)

    monkeypatch.setattr(nd, "shared", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert got == brute(rows, 80)
    assert asked[1] < 200, asked
