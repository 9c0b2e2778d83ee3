"""Packs say what the window operators and the long history say, however the rows are batched."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.operators import additive as ad, aggregates as ag, packs as pk
from pitpanel.operators.shape import rank_cap
from pitpanel.plans import blocks as fb, serving as sv

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small_batches(spark):
    """Batches of a few rows, so that every entity goes on in the next batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, old)


def test_packed_windows_equal_the_window_operators(spark, small_batches):
    cfg = fb.Config(windows=(3, 8, 16))
    panel = rank_cap(td.panel(spark, SF)).where("gsis_id <= 4").withColumn("targets", F.expr("IF(gsis_id % 3 = 0, NULL, targets)"))
    plan, packs, kept = fb.history_packs(panel.repartition(2, "gsis_id"), cfg, ("game_id", "gsis_id"))
    p = ag.with_era_priors(panel)
    h = fb.entity_block(p, {name: F.col(f"__prior_{name}") for name in ag.LEAGUE_PRIORS}, cfg)
    assert plan == ad.plan_for(h) and [f.name for f in kept] == ["game_id", "gsis_id"]
    vec = {(r.game_id, r.gsis_id): r for r in ad.vectors(h, plan, ["game_id", "gsis_id"]).collect()}
    seen = 0
    for part in packs.df.drop("own").toArrow().to_batches():
        for q in pk.opened(part, pk.reader(packs), rest=True):
            for i, (g, e) in enumerate(zip(q.rest.column("game_id").to_pylist(), q.rest.column("gsis_id").to_pylist())):
                r = vec[g, e]
                assert (q.era, q.cohort) == (r.era, r.cohort)
                assert np.allclose(q.x[i], np.frombuffer(bytes(r.x)), rtol=1e-12, equal_nan=True)
                assert np.array_equal(q.y[i], np.frombuffer(bytes(r.y)), equal_nan=True)
                seen += 1
    assert seen == len(vec) > 500


def test_summed_errors_equal_the_long_history(spark):
    """No row per (row, target) is written; forms, reasons, errors and verdicts are those of the history."""
    plan, packs, kept = fb.history_packs(rank_cap(td.panel(spark, SF)))
    models = ad.train(packs, plan, passes=1)
    history = sv.accuracy(sv.after_first(packs), models, plan, kept)
    errors = sv.fold_errors(packs, models, plan)
    for got, want in ((sv.scored_folds(errors), sv.fold_scores(history)), (sv.gate_of(errors), sv.gate(history))):
        keys = [c for c in ("variant", "era", "target") if c in want.columns]
        assert set(got.columns) <= set(want.columns)
        rows = {tuple(r[k] for k in keys): r for r in want.collect()}
        found = got.collect()
        assert len(found) == len(rows) > 0
        for r in found:
            for c in got.columns:
                w = rows[tuple(r[k] for k in keys)][c]
                assert r[c] == (pytest.approx(w, rel=1e-9) if isinstance(w, float) else w), (c, keys)


def test_flags_that_agree_are_one_column():
    x = np.array([[1.0, np.nan, np.nan, 2.0], [np.nan, 1.0, 3.0, 4.0], [np.nan, np.nan, np.nan, 5.0]])
    r, w = pk.Reduced(x), np.random.default_rng(0).normal(size=(9, 2))
    whole = np.hstack([np.ones((3, 1)), np.nan_to_num(x), np.isnan(x)])
    assert r.z.shape == (3, 1 + 4 + 2)
    assert np.allclose(r.z @ r.fold(w), whole @ w)
    at, own = r.places()
    full = np.zeros((9, 9))
    full[np.ix_(at, at)] = (r.z.T @ r.z)[np.ix_(own, own)]
    assert np.allclose(full, whole.T @ whole)


def test_features_in_order_cross_the_exchange_as_packs(spark, monkeypatch):
    """Rows in order equal the wide rows put in order, and what is shuffled last is one packed value for many rows."""
    from pitpanel.queries.blocks import _LITERAL, _league, _team
    from pitpanel.session import materialise

    t = _team(spark, SF)
    panel = materialise(rank_cap(td.panel(spark, SF)), "panel")
    round5 = lambda c: F.round(c, 5)
    out = fb.build_in_order(panel, t, _league(t), _LITERAL, fb.Config(zone=True), finish=round5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    dealt = next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    assert "RepartitionByExpression" in dealt and plan.index("Join LeftOuter") < plan.index(dealt)  # the sides are joined after it
    got = [tuple(r) for r in out.collect()]
    assert [r[:4] for r in got] == sorted(r[:4] for r in got) and len(got) == panel.count()
    monkeypatch.setattr(fb, "SIDE_ROWS", 0)
    other = fb.build_in_order(panel, t, _league(t), _LITERAL, fb.Config(zone=True), finish=round5)
    assert [(c, k) for c, k in other.dtypes if c.startswith("f_")] and set(other.columns) == set(out.columns)
    assert [tuple(r) for r in other.select(*out.columns).collect()] == got
