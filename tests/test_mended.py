"""Plans and properties of the isotonic expression, the two-sided as-of join and period routing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import calibrate as cp, joins as jn


def pava(ys, ws):
    blocks = []
    for y, w in zip(ys, ws):
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            (a, u, m), (b, v, n) = blocks[-2:]
            blocks[-2:] = [[(a * u + b * v) / (u + v), u + v, m + n]]
    return [y for y, _, n in blocks for _ in range(n)]


def test_isotonic_equals_pool_adjacent_violators(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0.1 * i, 1) for i in range(n)], [float(rng.randrange(1, 4)) for _ in range(n)]) for k, n in enumerate([1, 2, 3, 10, 50, 50])]
    df = spark.createDataFrame(rows, "k int, y array<double>, w array<double>")
    got = {r.k: r.f for r in df.select("k", cp.isotonic(F.col("y"), F.col("w")).alias("f")).collect()}
    for k, y, w in rows:
        assert got[k] == pytest.approx(pava(y, w))


def test_a_target_with_few_bins_keeps_its_row(spark):
    rng = random.Random(3)
    rows = [(t, i, i, rng.random() * 5, rng.random() * 5) for t, n in (("many", 900), ("few", 100)) for i in range(n)]
    df = spark.createDataFrame(rows, "target string, game_id int, gsis_id int, pred double, actual double")
    got = {r.target: r for r in cp.level_maps(df).collect()}
    assert got["many"].reason is None and len(got["many"].mapped) == cp.GRID_POINTS
    assert got["many"].mapped == sorted(got["many"].mapped)
    assert got["few"].grid is None and got["few"].mapped is None and "5 needed" in got["few"].reason


def stamps(spark, n, seed):
    rng = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    mk = lambda: [(i, rng.choice("ab"), None if rng.random() < 0.05 else t0 + timedelta(seconds=rng.randrange(4000))) for i in range(n)]
    ddl = "id int, g string, ts timestamp"
    left, right = mk(), mk()
    return left, right, spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl)


@pytest.mark.parametrize("hot", [None, 40])
def test_nearest_equals_search(spark, hot):
    left, right, a, b = stamps(spark, 300, 1)
    got = {r.id: r.hit for r in jn.asof_nearest(a, b, ["g"], "ts", "ts", {"id": "hit"}, "id", 30_000_000, hot_rows=hot).collect()}
    for i, g, t in left:
        near = [(abs((u - t).total_seconds()), u > t, j) for j, h, u in right if t and u and h == g and abs((u - t).total_seconds()) <= 30]
        if not near:
            assert got[i] is None
            continue
        best = min(x[:2] for x in near)
        assert got[i] in {x[2] for x in near if x[:2] == best}


def test_nearest_has_one_exchange(spark):
    *_, a, b = stamps(spark, 50, 2)
    plan = jn.asof_nearest(a, b, ["g"], "ts", "ts", {"id": "hit"}, "id", 30_000_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_recurring_periods_meet_only_their_own_days(spark):
    """Twenty eras of eighteen weeks: a start near one week's kickoffs has one candidate, and the right one."""
    games, starts = [], []
    for era in range(20):
        for week in range(18):
            kick = datetime(2000 + era, 9, 3, 18) + timedelta(days=7 * week)
            games += [(week + 1, kick), (week + 1, kick + timedelta(hours=3))]
            starts.append((len(starts), week + 1, kick + timedelta(hours=1)))
    g = spark.createDataFrame(games, "period int, kick timestamp")
    s = spark.createDataFrame(starts, "id int, want int, start timestamp")
    out = jn.modal_period_within(s, g, "start", "kick", "period", "got")
    assert [r.id for r in out.collect() if r.got != r.want] == []


def chain_rows(spark, shift=0.0):
    rng = random.Random(6)
    rows = []
    for era in (2001, 2002, 2003):
        for i in range(700):
            p = rng.uniform(0.5, 6)
            rows.append((era, "t", i, i, p, p * rng.uniform(0.5, 1.5) + (shift if era == 2002 else 0.0)))
    return spark.createDataFrame(rows, "era int, target string, game_id int, gsis_id int, pred double, actual double")


def test_calibration_of_an_era_sees_earlier_ones_only(spark):
    both = []
    for shift in (0.0, 3.0):
        maps, ratios = cp.cross_fitted(chain_rows(spark, shift))
        m = {r.era: (r.n, r.mapped) for r in maps.collect()}
        q = {}
        for r in ratios.collect():
            q.setdefault(r.era, []).append((r.bin, r.n, tuple(r.quantiles)))
        both.append((m, {e: sorted(v) for e, v in q.items()}))
    (m, q), (m2, q2) = both
    assert set(m) == {2002, 2003} and m[2002][0] == 700 and m[2003][0] == 1400
    close = lambda a, b: all(x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b))
    assert close(m[2002][1], m2[2002][1]) and all(x[:2] == y[:2] and close(x[2], y[2]) for x, y in zip(q[2002], q2[2002]))
    assert not close(m[2003][1], m2[2003][1]) and not all(close(x[2], y[2]) for x, y in zip(q[2003], q2[2003]))
    # The maps took the level out: ratios to levelled predictions lie around one.
    assert all(0.8 < quantiles[99] < 1.2 for _, _, quantiles in q2[2002])
