import random

import pytest
from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.operators import windows as wn
from pitpanel.operators.joins import asof, asof_nearest, micros, modal_period_within
from pitpanel.operators.ordered import Spec, fill, lookup_join, prior, quantiles, ranked
from pitpanel.plans import blocks as fb

ALL = [
    Spec("n", "count"), Spec("s", "sum", "x"), Spec("m", "mean", "x"), Spec("p", "mean_present", "x"),
    Spec("r3", "rolling", "x", 3), Spec("r8", "rolling", "x", 8), Spec("e", "mean", "x", within=("era",)),
    Spec("er", "rolling", "x", 3, ("era",)), Spec("en", "count", within=("era",)),
]


def series(spark, rows):
    return spark.createDataFrame(rows, "k string, era int, i int, x double")


def run(df, specs, hot=None):
    return {(r["k"], r["i"]): r for r in prior(df, ["k"], ["i"], F.col("i"), specs, hot).collect()}


def test_pinned_series(spark):
    df = series(spark, [("a", 0, i, float(v)) for i, v in enumerate([10, 20, 30, 40])])
    got = run(df, [Spec("r3", "rolling", "x", 3), Spec("m", "mean", "x")])
    assert [got["a", i]["r3"] for i in range(4)] == [None, 10.0, 15.0, 20.0]
    assert [got["a", i]["m"] for i in range(4)] == [None, 10.0, 15.0, 20.0]


def test_null_counts_as_zero_or_is_skipped(spark):
    df = series(spark, [("b", 0, i, v) for i, v in enumerate([None, 2.0, None, 4.0])])
    got = run(df, [Spec("m", "mean", "x"), Spec("p", "mean_present", "x"), Spec("s", "sum", "x"), Spec("n", "count")])
    assert [got["b", i]["m"] for i in range(4)] == [None, 0.0, 1.0, pytest.approx(2 / 3)]
    assert [got["b", i]["p"] for i in range(4)] == [None, None, 2.0, 2.0]
    assert [got["b", i]["s"] for i in range(4)] == [0.0, 0.0, 2.0, 2.0]
    assert [got["b", i]["n"] for i in range(4)] == [0, 1, 2, 3]


def skewed(spark, n=3000, seed=1):
    """One key holds a third of the rows; nulls, and a null key."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{rnd.randrange(40)}"
        rows.append((k, i // 700, i, None if rnd.random() < 0.2 else float(rnd.randrange(100))))
    return series(spark, rows)


@pytest.mark.parametrize("hot", [7, 60, 500])
def test_runs_agree_with_plain_windows(spark, hot):
    df = skewed(spark)
    assert run(df, ALL) == run(df, ALL, hot)


def test_hot_key_is_spread_over_runs(spark):
    from pitpanel.operators.ordered import RUN, assign_runs, find_hot

    df = skewed(spark)
    found = find_hot(df, ["k"], F.col("i"), 50)
    sizes = assign_runs(df, ["k"], F.col("i"), found).where("k = 'hot'").groupBy(RUN).count().collect()
    assert len(sizes) >= 15 and max(r["count"] for r in sizes) <= 120


def test_features_ignore_current_and_later_rows(spark):
    base = [("a", 0, i, float(i * i)) for i in range(12)]
    for cut in (0, 5, 11):
        moved = [(k, e, i, x if i < cut else None if i % 2 else 1e6) for k, e, i, x in base]
        a, b = run(series(spark, base), ALL), run(series(spark, moved), ALL)
        for i in range(cut + 1):
            for s in ALL:
                assert a["a", i][s.name] == b["a", i][s.name]


@pytest.mark.parametrize("hot", [None, 40])
def test_fill_and_rank(spark, hot):
    df = skewed(spark, 900)
    rows = sorted(df.collect(), key=lambda r: r["i"])
    for direction, out in (("next", "nx"), ("last", "la")):
        got = {r["i"]: r[out] for r in fill(df, ["k"], ["i"], F.col("i"), "x", out, direction, hot).collect()}
        seq = rows[::-1] if direction == "next" else rows
        seen = {}
        for r in seq:
            if r["x"] is not None:
                seen[r["k"]] = r["x"]
            assert got[r["i"]] == seen.get(r["k"])
    got = {r["i"]: r["rn"] for r in ranked(df, ["k"], ["i"], F.col("i"), "rn", hot).collect()}
    count = {}
    for r in rows:
        count[r["k"]] = count.get(r["k"], 0) + 1
        assert got[r["i"]] == count[r["k"]]


@pytest.mark.parametrize("hot", [None, 50])
def test_exact_quantiles(spark, hot):
    import numpy as np

    df = skewed(spark, 1200).where("k IS NOT NULL")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.995, 1.0]
    vals = {}
    for r in df.where("x IS NOT NULL").collect():
        vals.setdefault(r["k"], []).append(r["x"])
    for r in quantiles(df, ["k"], "x", probs, "q", hot).collect():
        assert r["n"] == len(vals[r["k"]])
        assert r["q"] == pytest.approx(list(np.quantile(vals[r["k"]], probs)), abs=1e-9)


@pytest.mark.parametrize("hot", [None, 30])
def test_asof_against_brute_force(spark, hot):
    rnd = random.Random(3)
    left = [(i, "hot" if i % 3 else f"g{i % 5}", rnd.randrange(400)) for i in range(300)]
    right = [(1000 + j, "hot" if j % 2 else f"g{j % 5}", rnd.randrange(400)) for j in range(120)]
    ldf = spark.createDataFrame(left, "id int, g string, t int")
    rdf = spark.createDataFrame(right, "rid int, g string, t int")
    for direction, strict in (("forward", False), ("forward", True), ("backward", False), ("backward", True)):
        got = {r["id"]: r["hit"] for r in asof(ldf, rdf, ["g"], "t", "t", {"rid": "hit"}, "rid", direction, strict, hot).collect()}
        for i, g, t in left:
            if direction == "forward":
                ok = [(rt, rid) for rid, rg, rt in right if rg == g and (rt > t if strict else rt >= t)]
                want = min(ok)[1] if ok else None
            else:
                ok = [(rt, rid) for rid, rg, rt in right if rg == g and (rt < t if strict else rt <= t)]
                want = max(ok)[1] if ok else None
            assert got[i] == want, (direction, strict, i)


def test_nearest_prefers_the_earlier_on_a_draw(spark):
    left = spark.createDataFrame([(1, "2024-01-01 12:00:00"), (2, "2024-01-09 00:00:00")], "id int, s string").selectExpr("id", "CAST(s AS TIMESTAMP_NTZ) AS t", "0 AS g")
    right = spark.createDataFrame([(7, "2024-01-01 10:00:00"), (8, "2024-01-01 14:00:00")], "rid int, s string").selectExpr("rid", "CAST(s AS TIMESTAMP_NTZ) AS t", "0 AS g")
    got = {r["id"]: r["hit"] for r in asof_nearest(left, right, ["g"], "t", "t", {"rid": "hit"}, "rid", 36 * 3600e6).collect()}
    assert got == {1: 7, 2: None}


@pytest.mark.parametrize("hot", [None, 10])
def test_modal_period_against_brute_force(spark, hot):
    rnd = random.Random(5)
    kicks = [(w, w * 7 * 86400 + rnd.randrange(4 * 86400)) for w in range(4) for _ in range(16)]
    starts = [rnd.choice(kicks)[1] + rnd.randrange(-8 * 3600, 8 * 3600) for _ in range(150)] + [kicks[0][1]] * 60 + [None]
    g = spark.createDataFrame(kicks, "week int, k long").selectExpr("week", "timestamp_seconds(k) AS kick")
    ln = spark.createDataFrame(list(enumerate(starts)), "id int, s long").selectExpr("id", "timestamp_seconds(s) AS start")
    got = {r["id"]: r["w"] for r in modal_period_within(ln, g, "start", "kick", "week", "w", hot_rows=hot).collect()}
    for i, s in enumerate(starts):
        hits = [w for w, k in kicks if s is not None and abs(k - s) < 6 * 3600]
        want = min(set(hits), key=lambda w: (-hits.count(w), w)) if hits else None
        assert got[i] == want


def test_salted_lookup_keeps_every_row(spark):
    left = skewed(spark, 600)
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    a = sorted(map(str, lookup_join(left, right, ["k"]).collect()))
    b = sorted(map(str, lookup_join(left, right, ["k"], hot_rows=20, salts=8).collect()))
    assert a == b and len(a) == 600


def test_group_history_counts_events_not_entities(spark):
    from pitpanel.roles import PLAYER_PANEL

    rows = [(1, w, f"g{w}", "X", p, float(w * 10)) for w in range(1, 4) for p in range(5)]
    df = spark.createDataFrame(rows, "season int, week int, game_id string, team string, gsis_id int, off_plays double")
    got = wn.deduped_group_history(df, PLAYER_PANEL, ["off_plays"], {"m": "off_plays"}, {})
    assert {r["game_id"]: r["m"] for r in got.collect()} == {"g1": None, "g2": 10.0, "g3": 15.0}


def test_entity_block_has_one_exchange_and_no_python(spark):
    stored = "/root/testdata/sf0.001"
    panel = td.panel(spark, stored)
    from pitpanel.session import materialise

    panel = materialise(panel, "panel")
    priors = {k: v[2] for k, v in __import__("pitpanel.operators.aggregates", fromlist=["x"]).LEAGUE_PRIORS.items()}
    block = fb.entity_block(panel, priors)
    plan = block._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan[:2000]
    assert "Python" not in plan and "ArrowEval" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    li = td.table(spark, "/root/testdata/sf0.001", "lineitem").where("l_quantity > 40").select("l_orderkey")
    plan = li._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_equal_count_bins_match_numpy_edges(spark):
    import numpy as np

    xs = [float((i * 37) % 1000) for i in range(777)]
    df = spark.createDataFrame([(0, i, x, x * 2) for i, x in enumerate(xs)], "k int, i int, x double, y double")
    got = {r["bin"]: (r["n"], r["mean_x"]) for r in wn.equal_count_bins(df, ["k"], "x", "y", ["i"]).collect()}
    s = np.sort(xs)
    n_bins = int(np.clip(len(s) // 60, 5, 50))
    edges = np.linspace(0, len(s), n_bins + 1).astype(int)
    for b in range(n_bins):
        part = s[edges[b] : edges[b + 1]]
        if len(part) >= 60:
            assert got[b] == (len(part), pytest.approx(part.mean()))


def test_more_hot_keys_than_a_broadcast_takes(spark, monkeypatch):
    """Past the broadcast bound the list of hot keys is joined, and every hot key is still cut."""
    from pitpanel.operators import ordered

    monkeypatch.setattr(ordered, "BROADCAST_KEYS", 3)
    df = spark.range(0, 600).selectExpr("id % 30 AS k", "id AS i", "CAST(id % 7 AS DOUBLE) AS v")
    specs = [ordered.Spec("m", "mean", "v"), ordered.Spec("r", "rolling", "v", 3), ordered.Spec("n", "count")]
    found = ordered.find_hot(df, ["k"], F.col("i"), 5)
    assert found[1] == 30
    cut = ordered.prior(df, ["k"], ["i"], F.col("i"), specs, 5)
    plain = ordered.prior(df, ["k"], ["i"], F.col("i"), specs, 10**9)
    shown = lambda d: sorted((r["k"], r["i"], r["n"], None if r["m"] is None else round(r["m"], 9), None if r["r"] is None else round(r["r"], 9)) for r in d.collect())
    assert shown(cut) == shown(plain)


def test_null_keys_spread_over_salts(spark):
    from pitpanel.operators.ordered import lookup_join

    left = spark.range(0, 1000).selectExpr("IF(id % 2 = 0, NULL, id % 5) AS k", "id")
    right = spark.createDataFrame([(1, "a"), (3, "b")], "k long, x string")
    j = lookup_join(left, right, ["k"], "left", hot_rows=50)
    assert j.count() == 1000 and j.where("x IS NOT NULL").count() == 200
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        parts = lookup_join(left, right, ["k"], "left", hot_rows=50).where("k IS NULL").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert parts > 1
