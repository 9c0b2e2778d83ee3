import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.functions import prob as pr
from pitpanel.operators import calibrate as cp
from pitpanel.operators.joins import bin_lookup


def scored(spark, n=1500):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        p = rnd.random() * 20
        rows.append(("t", f"g{i}", i, p, float(np.floor(max(0.0, p * rnd.choice([0, 0.4, 0.8, 1.1, 1.7]))))))
    return spark.createDataFrame(rows, "target string, game_id string, gsis_id int, pred double, actual double")


@pytest.fixture(scope="module")
def table(spark):
    from pitpanel.session import materialise

    return materialise(cp.ratio_table(scored(spark)), "ratios")


def test_interp_equals_numpy(spark):
    xs = [0.0, 0.0, 0.0, 0.5, 0.5, 1.0, 2.0, 2.0]
    ys = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
    pts = [-1.0, 0.0, 0.25, 0.5, 0.75, 1.9, 2.0, 2.1]
    df = spark.createDataFrame([(x,) for x in pts], "x double")
    arr = lambda v: F.array(*[F.lit(a) for a in v])
    got = [r[0] for r in df.select(pr.interp(F.col("x"), arr(xs), arr(ys), F.lit(0.0), F.lit(1.0))).collect()]
    assert got == pytest.approx(list(np.interp(pts, xs, ys, left=0.0, right=1.0)))


def test_probability_properties(spark, table):
    rows = [("t", p, l) for p in (0.1, 0.3, 2.0, 7.5, 19.0, 50.0) for l in (0.5, 1.5, 4.5, 9.5, 30.5)]
    df = spark.createDataFrame(rows + [("other", 5.0, 3.5)], "target string, pred double, line double")
    b = bin_lookup(df, table, "target", "pred", ["quantiles", "q_grid"])
    q = (F.col("quantiles"), F.col("q_grid"))
    got = b.select("target", "pred", "line", pr.prob_over(F.col("pred"), F.col("line"), *q).alias("p"), pr.median_projection(F.col("pred"), *q).alias("m")).collect()
    by = {}
    for r in got:
        if r["target"] == "other" or r["pred"] < 0.25:
            assert r["p"] is None
            continue
        assert 0.01 <= r["p"] <= 0.99
        by.setdefault(r["pred"], []).append((r["line"], r["p"]))
        assert (r["p"] > 0.5) == (r["m"] > r["line"]) or abs(r["p"] - 0.5) < 1e-6
    for series in by.values():
        p = [v for _, v in sorted(series)]
        assert p == sorted(p, reverse=True)


def test_ratio_quantiles_equal_numpy(spark, table):
    rows = [(r["pred"], r["actual"]) for r in scored(spark).collect() if r["pred"] >= 0.25]
    pred = np.array([p for p, _ in rows])
    edges = np.quantile(pred, np.linspace(0, 1, 11))
    got = {r["bin"]: r for r in table.collect()}
    assert len(got) == 10
    for b, r in got.items():
        inside = [y / p for p, y in rows if (edges[b] < p <= edges[b + 1]) or (b == 0 and p == edges[0])]
        assert r["n"] == len(inside)
        assert r["quantiles"] == pytest.approx(list(np.quantile(inside, cp.RATIO_PROBS)), abs=1e-9)


def test_level_map_properties(spark):
    m = cp.level_maps(scored(spark)).first()
    assert len(m["grid"]) == len(m["mapped"]) == 200
    assert m["mapped"] == sorted(m["mapped"]) and min(m["mapped"]) >= 0
    arr = lambda v: F.array(*[F.lit(float(a)) for a in v])
    df = spark.createDataFrame([(x,) for x in (-3.0, 0.0, 5.0, 19.0, 200.0)], "x double")
    got = [r[0] for r in df.select(pr.apply_level(F.col("x"), arr(m["grid"]), arr(m["mapped"]))).collect()]
    assert min(got) >= 0 and got == sorted(got)
    assert got[-1] == pytest.approx(200.0 * m["mapped"][-1] / m["grid"][-1])
    same = df.select(pr.apply_level(F.col("x"), F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>"))).collect()
    assert [r[0] for r in same] == [-3.0, 0.0, 5.0, 19.0, 200.0]


def observations(spark):
    rows = []
    for i in range(400):
        rows.append(("QB", 1, None, i % 20 != 0))
        rows.append(("QB", 2, None, i % 10 == 0))
        rows.append(("WR", 6, None, i % 4 == 0))
    rows += [("QB", 1, "Out", False)] * 30 + [("QB", 1, "Questionable", i % 4 != 0) for i in range(40)] + [("QB", 1, "Doubtful", False)] * 5
    return spark.createDataFrame(rows, "position string, rank_capped int, report_status string, appeared boolean")


def test_availability(spark):
    obs = observations(spark)
    grid, mult = cp.availability_grid(obs), cp.status_multipliers(obs)
    g = {(r["position"], r["rank_capped"]): r for r in grid.collect()}
    assert all(0 <= r["p_play"] <= 1 for r in g.values())
    assert g["QB", 1]["p_play"] > g["WR", 6]["p_play"]
    m = {r["report_status"]: (r["multiplier"], r["source"]) for r in mult.collect()}
    assert m["Out"] == (0.02, "floor") and m["Doubtful"][1].startswith("floor (too few")
    assert m["Questionable"] == (pytest.approx(0.75 / 0.95, abs=1e-3), "measured")
    df = spark.createDataFrame(
        [(1, "QB", 1.0, "KC", None), (2, "QB", 1.0, "KC", "Out"), (3, "QB", 1.0, "SF", None), (4, "WR", None, "SF", None), (5, "TE", 1.0, "SF", None)],
        "id int, position string, depth_rank double, team string, report_status string",
    )
    p = {r["id"]: r["p_play"] for r in cp.apply_availability(df, grid, mult).collect()}
    assert p[1] == pytest.approx(g["QB", 1]["p_play"]) and p[3] == pytest.approx(g["QB", 1]["p_play_any"])
    assert p[2] < 0.2 * p[1] and p[4] == pytest.approx(g["WR", 6]["p_play_any"]) and p[5] == 0.5
    assert {r["p_play"] for r in cp.apply_availability(df, None, mult).collect()} == {1.0}


def test_sum_gate(spark):
    ok = spark.createDataFrame([("a", 0.5, True), ("a", 0.5, False)], "team string, p_play double, appeared boolean")
    assert cp.sum_gate(ok, ["team"]) == 1.0
    with pytest.raises(cp.GateError):
        cp.sum_gate(ok.withColumn("p_play", F.lit(0.8)), ["team"])


def test_reliability_bins_are_left_closed(spark):
    rows = [(0.3, 1.0)] * 30 + [(0.29, 0.0)] * 30 + [(0.5, 1.0)] * 29
    c = cp.reliability_curve(spark.createDataFrame(rows, "p double, y double"), "p", "y")
    assert sorted((r["bin_lo"], r["actual"], r["n"]) for r in c.collect()) == [(0.0, 0.0, 30), (0.3, 1.0, 30)]
