"""Nested folds from one sort: bins, ends and ratio quantiles of every fold against numpy on the fold's own rows."""

import numpy as np
import pytest

from pitpanel.operators import calibrate as cp, ranked as rk


def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for era in (2001, 2002, 2003, 2005):
        for t, n in (("a", 900), ("b", 130)):
            for i in range(n):
                # A third of the values ties, among them one that many rows share.
                x = float(rng.choice([1.5, 2.0, 2.25])) if rng.random() < 0.35 else float(rng.gamma(2.0, 2.0))
                out.append((t, era, x, float(rng.poisson(x)) - (2.0 if t == "b" else 0.0), f"g{rng.integers(40)}", i))
    return out


@pytest.fixture(scope="module")
def runs(spark):
    data = rows(spark)
    old, rk.RUN_ROWS = rk.RUN_ROWS, 100
    yield data, rk.in_runs(spark.createDataFrame(data, "target string, era long, x double, y double, t0 string, t1 long").repartition(5), ["t0", "t1"])
    rk.RUN_ROWS = old


def fold(data, target, era):
    return sorted((r[2], r[4], r[5], r[3]) for r in data if r[0] == target and r[1] < era)


def test_equal_bins_of_every_fold(runs):
    data, r = runs
    full, ends = r.equal_bins([0.0, 0.99], 60, (5, 50))
    found = {}
    for b in full.collect():
        found.setdefault((b.target, b.era), []).append((b.mean_x, b.mean_y))
    got = {(e.target, e.era): e for e in ends.collect()}
    assert set(got) == {(t, e) for t in "ab" for e in (2002, 2003, 2005)}
    for (t, era), e in got.items():
        mine = fold(data, t, era)
        n, x = len(mine), np.array([v[0] for v in mine])
        assert e.n == n and e.q == pytest.approx(list(np.quantile(x, [0.0, 0.99])), rel=1e-12)
        bins = max(5, min(50, n // 60))
        edges = [i * n // bins for i in range(bins + 1)]
        want = [(x[a:b].mean(), np.mean([v[3] for v in mine[a:b]])) for a, b in zip(edges, edges[1:]) if b - a >= 60]
        assert np.allclose(sorted(found.get((t, era), [])), sorted(want), rtol=1e-12) if want else (t, era) not in found


def test_ratio_quantiles_of_every_fold(runs):
    data, r = runs
    grid = np.linspace(0.1, 8.0, 200)
    maps = {("a", 2003): (grid, np.maximum.accumulate(np.where(grid < 2, 0.2 * grid, np.floor(grid))))}
    got = {k[:3]: k[3:] for k in r.ratio_quantiles(maps, 0.25, 10, cp.RATIO_PROBS)}
    seen = 0
    for t in "ab":
        for era in (2002, 2003, 2005):
            mine = fold(data, t, era)
            x, y = np.array([v[0] for v in mine]), np.array([v[3] for v in mine])
            if (t, era) in maps:
                x = np.maximum(cp._on_map(x, *maps[t, era]), 0.0)
            x, y = x[x >= 0.25], y[x >= 0.25]
            edges = np.unique(np.quantile(x, np.linspace(0, 1, 11)))
            at = np.maximum(np.searchsorted(edges, x - 1e-12, "left") - 1, 0)
            for b in range(len(edges) - 1):
                inside = at == b
                lo, hi, n, mean_x, mean_y, q = got[t, era, b]
                assert (lo, hi, n) == (pytest.approx(edges[b]), pytest.approx(edges[b + 1]), int(inside.sum()))
                assert (mean_x, mean_y) == (pytest.approx(x[inside].mean()), pytest.approx(y[inside].mean()))
                assert q == pytest.approx(list(np.quantile(y[inside] / x[inside], cp.RATIO_PROBS)), rel=1e-9, abs=1e-12)
                seen += 1
    assert seen == len(got) > 40


def test_leading_bits_grow_with_the_values():
    v = np.array([-np.inf, -3.5, -1e-300, -0.0, 0.0, 1e-300, 0.5, 1.0, 1.0000000001, 7e9, np.inf])
    for bits in (12, 20, 25, 40):
        assert (np.diff(rk.leading(v, bits)) >= 0).all()
    assert rk.leading(v, 20)[3] == rk.leading(v, 20)[4] and (rk.leading(v, 25) >> 5 == rk.leading(v, 20)).all()


def test_maps_never_fall():
    grid = np.linspace(0.1, 0.7, 50)
    mapped = np.maximum.accumulate(np.round(np.sqrt(grid), 2))
    x = np.sort(np.concatenate([grid, np.nextafter(grid, 1), np.nextafter(grid, 0), np.linspace(0, 1, 5000)]))
    assert (np.diff(rk.rising(x, grid, mapped)) >= 0).all()
    assert np.allclose(rk.rising(x, grid, mapped), cp._on_map(x, grid, mapped), rtol=1e-12)
