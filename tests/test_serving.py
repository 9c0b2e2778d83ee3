import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import additive as ad
from pitpanel.operators.calibrate import GateError
from pitpanel.operators.models import MissingFeature
from pitpanel.plans import serving as sv
from pitpanel.sources import sinks


def rows(seed=1, eras=4, n=120):
    rng = np.random.default_rng(seed)
    out = []
    for era in range(2000, 2000 + eras):
        for i in range(n):
            cohort = ["WR", "TE", "QB", "K"][i % 4]
            a, b = float(rng.normal()), None if rng.random() < 0.2 else float(rng.normal())
            level = float(np.exp(0.5 + 0.4 * a))
            targets = float(rng.poisson(level)) if rng.random() > 0.05 else None
            yards = 8.0 * a + (3.0 if b is None else b) + float(rng.normal())
            out.append((era, i % 7, f"{era}_{i % 7}", f"p{i}", cohort, a, b, 1.0, level, 0.5 * level + 0.7, 8.0, targets, yards))
    return out


DDL = (
    "season int, week int, game_id string, gsis_id string, position string, f_a double, f_b double, f_same double, f_std_targets double, f_career_targets double, "
    "f_shrunk_ypt double, targets double, receiving_yards double"
)


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(rows(), DDL)


@pytest.fixture(scope="module")
def fitted(panel):
    plan = ad.plan_for(panel)
    models, history = sv.walk_forward(panel, plan)
    return plan, models.collect(), models, history.collect(), history


def test_sums_give_the_ridge_fit_of_each_fold(panel, fitted):
    plan, found, *_ = fitted
    assert plan.targets == ("targets", "receiving_yards") and "f_same" in plan.features
    r = next(r for r in found if r.target == "receiving_yards" and r.fold == 2002 and r.cohort == "WR")
    train = [x for x in rows() if x[0] < 2002 and x[4] in ("WR", "TE")]
    assert r.n_train == len(train) and r.train_mean == pytest.approx(np.mean([x[12] for x in train]))
    features = np.array([[np.nan if v is None else v for v in x[5:11]] for x in train], float)
    z = np.hstack([np.nan_to_num(features), np.isnan(features)])
    keep = [k for k in range(z.shape[1]) if z[:, k].std() > 0 and k != 4]  # f_career is a line in f_std
    mean, spread = z[:, keep].mean(axis=0), z[:, keep].std(axis=0)
    c = ((z[:, keep] - mean) / spread).T @ ((z[:, keep] - mean) / spread) / len(z)
    y = np.array([x[12] for x in train])
    slopes = np.linalg.solve(c + ad.RIDGE * np.eye(len(c)), ((z[:, keep] - mean) / spread).T @ (y - y.mean()) / len(z)) / spread
    want = np.zeros(plan.width)
    where = {k: 1 + plan.features.index(f"{c}") if k < 6 else 1 + len(plan.features) + plan.features.index(c) for k, c in ((k, ["f_a", "f_b", "f_same", "f_std_targets", "f_career_targets", "f_shrunk_ypt"][k % 6]) for k in keep)}
    for k, s in zip(keep, slopes):
        want[where[k]] = s
    want[0] = y.mean() - slopes @ mean
    assert np.allclose(r.coef, want, atol=1e-6)


def test_count_models_near_the_maximum(panel, fitted):
    plan, found, *_ = fitted
    r = next(r for r in found if r.target == "targets" and r.fold == 2004 and r.cohort == "WR")
    train = [x for x in rows() if x[4] in ("WR", "TE") and x[11] is not None]
    mean_of = lambda x: float(np.exp(np.clip(np.dot(r.coef, vector(plan, x)), -30, np.log(r.train_mean) + ad.SPAN)))
    mu, y = np.array([mean_of(x) for x in train]), np.array([x[11] for x in train])
    assert mu.mean() == pytest.approx(y.mean(), rel=0.02)
    start = next(m for m in ad.train(ad.vectors(panel, plan, []), plan, passes=0).collect() if (m.target, m.fold, m.cohort) == ("targets", 2004, "WR"))
    first = np.exp(np.clip([np.dot(start.coef, vector(plan, x)) for x in train], -30, np.log(r.train_mean) + ad.SPAN))
    loss = lambda m: float((m - y * np.log(m)).mean())
    assert loss(mu) < loss(first)


def vector(plan, x):
    named = dict(zip([c.split(" ")[0] for c in DDL.split(", ")], x))
    values = [named[c] for c in plan.features]
    return [1.0, *[0.0 if v is None else v for v in values], *[float(v is None) for v in values]]


def test_predictions_by_the_jvm_equal_the_coefficients(fitted):
    plan, found, _, history, _ = fitted
    by = {(r.fold, r.cohort, r.target): r for r in found}
    data = {(x[0], x[3]): x for x in rows()}
    checked = 0
    for h in history:
        if h.reason is None and h.target == "receiving_yards" and h.form == "direct":
            m = by[h.era, h.cohort, h.target]
            assert h.pred == pytest.approx(max(0.0, float(np.dot(m.coef, vector(plan, data[h.era, h.gsis_id])))), abs=1e-9)
            checked += 1
    assert all(h.pred is None and "rows" in h.reason for h in history if h.n_train < 500) and {h.era for h in history} == {2001, 2002, 2003}
    assert checked >= 0


def test_a_fold_does_not_see_its_era(spark, panel, fitted):
    plan, found, *_ = fitted
    changed = panel.withColumn("targets", F.when(F.col("season") == 2002, 9.0).otherwise(F.col("targets"))).withColumn(
        "receiving_yards", F.when(F.col("season") == 2002, -5.0).otherwise(F.col("receiving_yards"))
    )
    again = ad.train(ad.vectors(changed, plan, []), plan).collect()
    old = {(r.fold, r.cohort, r.target): r.coef for r in found}
    for r in again:
        same = old[r.fold, r.cohort, r.target] == r.coef
        assert same == (r.fold <= 2002), (r.fold, r.target)


def test_variants(panel):
    plan = ad.plan_for(panel)
    some = [ad.Variant(), ad.Variant("recency", recency=True), ad.Variant("per_cohort", per_cohort=True), ad.Variant("few", leave_out="f_a")]
    found = {(r.variant, r.fold, r.cohort, r.target): r for r in ad.train(ad.vectors(panel, plan, []), plan, some, passes=1).collect()}
    assert {v for v, *_ in found} == {"base", "recency", "per_cohort", "few"}
    at = 1 + plan.features.index("f_a")
    assert found["few", 2003, "WR", "receiving_yards"].coef[at] == 0 and found["base", 2003, "WR", "receiving_yards"].coef[at] > 1
    assert found["recency", 2003, "WR", "receiving_yards"].coef != found["base", 2003, "WR", "receiving_yards"].coef
    # No cohort has MIN_COHORT rows here: all are served by the pooled model.
    assert found["per_cohort", 2003, "WR", "receiving_yards"].coef == found["base", 2003, "WR", "receiving_yards"].coef


def verdict(spark, passing):
    cols = "variant string, target string, n_test long, pred_mae double, b1_mae double, b2_mae double, b3_mae double, passes_gate boolean, present_as string"
    return spark.createDataFrame([("base", t, 100, 1.0, 2.0, 2.0, 2.0, t in passing, "model") for t in ("targets", "receiving_yards")], cols)


def test_publish_load_and_serve(spark, panel, fitted, tmp_path):
    plan, _, models, *_ = fitted
    store = str(tmp_path / "models")
    with pytest.raises(GateError):
        sv.publish(models, verdict(spark, ()), store)
    assert sinks.versions(spark, store) == []
    with pytest.raises(FileNotFoundError):
        sv.load(spark, store)
    assert sv.publish(models, verdict(spark, ("receiving_yards",)), store) == 1
    future = panel.where("season = 2003").withColumn("season", F.lit(2007)).withColumn("p_play", F.lit(0.5))
    keep = ["season", "gsis_id", "position"]
    got = {r.gsis_id: r for r in sv.serve(future, sv.load(spark, store), plan, keep, "p_play").collect()}
    other = spark.newSession()
    again = {r.gsis_id: r for r in sv.serve(future, sv.load(other, store), plan, keep, "p_play").collect()}
    assert got == again and len(got) == 120
    newest = {(r.cohort, r.target): r for r in models.where("fold = 2004").collect()}
    data = {x[3]: x for x in rows() if x[0] == 2003}
    for g, r in got.items():
        if r.position in ("QB", "K"):
            assert r.targets is None and r.targets_source is None and r.receiving_yards_expected is None
            continue
        assert r.targets_source == "baseline" and r.targets == data[g][8]
        value = max(0.0, float(np.dot(newest[r.position, "receiving_yards"].coef, vector(plan, data[g]))))
        assert r.receiving_yards_source == "model" and r.receiving_yards == pytest.approx(value, abs=1e-9)
        assert r.receiving_yards_expected == pytest.approx(value / 2, abs=1e-9)
    with pytest.raises(MissingFeature):
        sv.serve(future.drop("f_a"), sv.load(spark, store), plan, keep)


def test_empty_and_null(spark, panel, fitted):
    plan, _, models, *_ = fitted
    assert ad.train(ad.vectors(panel.limit(0), plan, []), plan).collect() == []
    odd = panel.limit(3).withColumn("position", F.lit(None).cast("string")).withColumn("f_b", F.lit(float("nan")))
    served = sv.serve(odd, models, plan, ["gsis_id", "position"]).collect()
    assert len(served) == 3 and all(r.targets is None and r.targets_source is None for r in served)


def test_vectors_are_two_packed_values_a_row(panel, fitted):
    """A pass over the vectors reads two binary values a row; baselines are read out of them."""
    plan, _, _, history, _ = fitted
    vec = ad.vectors(panel, plan, ["gsis_id"])
    assert dict(vec.dtypes)["x"] == dict(vec.dtypes)["y"] == "binary"
    data = {(x[0], x[3]): x for x in rows()}
    for r in vec.collect():
        x = np.frombuffer(bytes(r.x))
        want = [np.nan if v is None else v for v in (vector(plan, data[r.era, r.gsis_id])[1 : 1 + len(plan.features)])]
        gone = vector(plan, data[r.era, r.gsis_id])[1 + len(plan.features) :]
        assert np.array_equal(np.isnan(x), np.array(gone) > 0) and np.array_equal(np.nan_to_num(x), np.array(want))
    for h in history:
        if h.reason is None and h.target == "targets":
            assert h.b2 == data[h.era, h.gsis_id][8]
