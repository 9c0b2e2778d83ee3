"""Per-target models, baselines, gates and ablation verdicts.

Spark ML has no learner that routes missing values, so features are median-imputed and every
nullable feature brings a missing indicator. Folds and targets are driver loops over short
stated lists; each fit runs on the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from pitpanel.functions.prob import apply_level, recency_weight
from pitpanel.operators.aggregates import ratio
from pitpanel.operators.shape import eligible, enough_rows

# Target -> cohorts, kind, and for yards the opportunity and rate behind them.
RECEIVERS = ["WR", "TE", "RB"]
RUSHERS = ["RB", "QB", "FB"]
TARGETS = {
    "targets": (RECEIVERS, "count", None, None),
    "receptions": (RECEIVERS, "count", None, None),
    "receiving_yards": (RECEIVERS, "yards", "targets", "f_shrunk_ypt"),
    "receiving_tds": (RECEIVERS, "count", None, None),
    "carries": (RUSHERS, "count", None, None),
    "rushing_yards": (RUSHERS, "yards", "carries", "f_shrunk_ypc"),
    "rushing_tds": (RUSHERS, "count", None, None),
    "attempts": (["QB"], "count", None, None),
    "completions": (["QB"], "count", None, None),
    "passing_yards": (["QB"], "yards", "attempts", "f_shrunk_ypa"),
    "passing_tds": (["QB"], "count", None, None),
    "passing_interceptions": (["QB"], "count", None, None),
    "sacks_suffered": (["QB"], "count", None, None),
    "fg_att": (["K"], "count", None, None),
    "fg_made": (["K"], "count", None, None),
    "pat_att": (["K"], "count", None, None),
}
MIN_TRAIN, MIN_TEST, MIN_COHORT = 500, 200, 300


class MissingFeature(RuntimeError):
    """A trained column is absent when serving."""


@dataclass(frozen=True)
class Params:
    """Learner settings; depth 5 stands for about 31 leaves."""

    rounds: int = 50
    step: float = 0.06
    depth: int = 5
    min_leaf: int = 40
    seed: int = 0
    reg: float = 0.1
    count_learner: str = "poisson"


DEEPER = Params(rounds=100, step=0.03, depth=6, min_leaf=25)


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles with NaN read as null, plus one missing indicator per feature."""
    cols = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    out = df.withColumns(cols)
    return out.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in features})


def learner(kind: str, label: str, p: Params, weight: str | None):
    if kind == "count" and p.count_learner == "poisson":
        est = GeneralizedLinearRegression(
            family="poisson", link="log", labelCol=label, regParam=p.reg, maxIter=15
        )
    else:
        est = GBTRegressor(
            labelCol=label, maxIter=p.rounds, stepSize=p.step, maxDepth=p.depth,
            minInstancesPerNode=p.min_leaf, seed=p.seed, lossType="squared",
        )
    return est.setWeightCol(weight) if weight else est


def fit(df: DataFrame, label: str, features: list[str], kind: str, p: Params = Params(), weight: str | None = None) -> PipelineModel:
    """One target's model: impute, indicate, assemble, scale, learn."""
    imputed = [f"{c}__filled" for c in features]
    flags = [f"{c}__missing" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=imputed),
        VectorAssembler(inputCols=imputed + flags, outputCol="__raw_features"),
        StandardScaler(inputCol="__raw_features", outputCol="features", withMean=True),
        learner(kind, "__label", p, weight),
    ]
    data = prepared(df.withColumn("__label", F.col(label).cast("double")), features)
    if kind == "count":
        data = data.where(F.col("__label") >= 0)
    usable = [c for c in ("__label", weight) if c] + features + flags
    return Pipeline(stages=stages).fit(data.select(*dict.fromkeys(usable)))


def predict(model: PipelineModel, df: DataFrame, features: list[str], out: str, cohorts: list[str] | None = None, cohort: str = "position") -> DataFrame:
    """Add a clipped prediction, null outside the cohorts; a missing trained column raises."""
    gone = [c for c in features if c not in df.columns]
    if gone:
        raise MissingFeature(f"{len(gone)} trained column(s) missing when serving: {gone[:8]}")
    scored = model.transform(prepared(df, features))
    value = F.greatest(F.col("prediction"), F.lit(0.0))
    if cohorts is not None:
        value = F.when(F.col(cohort).isin(cohorts), value)
    return scored.withColumn(out, value).select(*df.columns, out)


def baseline_serving(df: DataFrame, history: DataFrame, target: str, cohorts: list[str], cohort: str = "position") -> DataFrame:
    """Era-to-date mean, else career mean, else the training mean; null outside the cohorts."""
    fill = history.where(F.col(cohort).isin(cohorts)).agg(F.avg(target)).first()[0]
    chain = [F.col(c) for c in (f"f_std_{target}", f"f_career_{target}") if c in df.columns]
    served = F.coalesce(*chain, F.lit(float(fill or 0.0)))
    return df.withColumn(target, F.when(F.col(cohort).isin(cohorts), served))


def estimands(df: DataFrame, target: str, raw: str, p_play: str = "p_play", grid: Column | None = None, mapped: Column | None = None) -> DataFrame:
    """Conditional value (level-mapped) and expected value from the unmapped mean.

    Both carry their estimand in column metadata, so a check can refuse to sum the wrong one.
    """
    level = apply_level(F.col(raw), grid, mapped) if grid is not None else F.col(raw)
    return df.withColumn(target, level.alias(target, metadata={"estimand": "conditional"})).withColumn(
        f"{target}_expected", (F.col(raw) * F.col(p_play))
    ).withMetadata(f"{target}_expected", {"estimand": "expected"})


def with_baselines(test: DataFrame, target: str, train_mean: float, opp: str | None = None, rate: str | None = None) -> DataFrame:
    """b1 a constant, b2 the era-to-date mean, b3 shrunk rate times opportunity or the career mean."""
    const = F.lit(float(train_mean))
    std = F.col(f"f_std_{target}") if f"f_std_{target}" in test.columns else F.lit(None).cast("double")
    if rate and opp:
        o = f"f_std_{opp}" if f"f_std_{opp}" in test.columns else f"f_career_{opp}"
        mean_o = test.agg(F.avg(o)).first()[0]
        b3 = F.coalesce(F.col(o), F.lit(mean_o)) * F.col(rate)
    else:
        b3 = F.coalesce(F.col(f"f_career_{target}"), const) if f"f_career_{target}" in test.columns else const
    return test.withColumn("b1", const).withColumn("b2", F.coalesce(std, const)).withColumn("b3", b3)


def scores(df: DataFrame, by: list[str], actual: str, preds: list[str]) -> DataFrame:
    """MAE and RMSE of each prediction column."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(actual).alias("mean")]
    for p in preds:
        e = F.col(actual) - F.col(p)
        aggs += [F.avg(F.abs(e)).alias(f"{p}_mae"), F.sqrt(F.avg(e * e)).alias(f"{p}_rmse")]
    return df.groupBy(*by).agg(*aggs)


def ship_gate(s: DataFrame, model: str = "pred") -> DataFrame:
    """A model ships only when it beats both player baselines; weak when it loses to the constant."""
    m = F.col(f"{model}_mae")
    out = s
    for b in ("b1", "b2", "b3"):
        out = out.withColumn(f"skill_vs_{b}", 100 * (1 - ratio(m, F.col(f"{b}_mae"))))
    passes = (m < F.col("b2_mae")) & (m < F.col("b3_mae"))
    return out.withColumn("passes_gate", passes).withColumn(
        "present_as",
        F.when(~passes, "baseline").when(m >= F.col("b1_mae"), "model_low_confidence").otherwise("model"),
    )


def walk_forward(
    features_of, target: str, folds: list[int], features: list[str], era: str = "season",
    cohort: str = "position", p: Params = Params(), min_train: int = MIN_TRAIN, min_test: int = MIN_TEST,
) -> DataFrame | None:
    """Score each fold era with a model trained on strictly earlier eras.

    ``features_of(era)`` gives the panel up to that era with its features. For yards the compound
    form (opportunity model times shrunk rate) competes with the direct one on the last training
    era, and the winner scores the fold.
    """
    cohorts, kind, opp, rate = TARGETS[target]
    out = None
    for fold in folds:
        panel = eligible(features_of(fold), target, cohort, cohorts)
        train, test = panel.where(F.col(era) < fold), panel.where(F.col(era) == fold)
        if not (enough_rows(train, min_train) and enough_rows(test, min_test)):
            continue
        cols = [c for c in features if c in panel.columns]
        form = kind
        if kind == "yards" and rate in panel.columns and opp in panel.columns:
            form = _choose_form(train, target, opp, rate, cols, era, fold - 1, p)
        if form == "compound":
            m = fit(train, opp, cols, "count", p)
            scored = predict(m, test, cols, "__opp").withColumn("pred", F.col("__opp") * F.col(rate)).drop("__opp")
        else:
            m = fit(train, target, cols, "count" if kind == "count" else "yards", p)
            scored = predict(m, test, cols, "pred")
        mean = train.agg(F.avg(target)).first()[0]
        rows = with_baselines(scored, target, mean, opp, rate if rate in panel.columns else None)
        rows = accuracy_rows(rows, target, form if kind == "yards" else kind, fold - 1, era)
        out = rows if out is None else out.unionByName(rows)
    return out


def _choose_form(train, target, opp, rate, cols, era, valid, p) -> str:
    """Compound or direct, decided on the last training era, never on the scored fold."""
    fit_rows, check = train.where(F.col(era) < valid), train.where(F.col(era) == valid)
    if not (enough_rows(fit_rows, 50) and enough_rows(check, 50)):
        return "direct"
    a = predict(fit(fit_rows, opp, cols, "count", p), check, cols, "__c").withColumn("__c", F.col("__c") * F.col(rate))
    b = predict(fit(fit_rows, target, cols, "yards", p), a, cols, "__d")
    r = b.agg(
        F.avg(F.abs(F.col(target) - F.col("__c"))).alias("c"), F.avg(F.abs(F.col(target) - F.col("__d"))).alias("d")
    ).first()
    return "compound" if r["c"] <= r["d"] else "direct"


def accuracy_rows(scored: DataFrame, target: str, form: str, trained_through: int, era: str) -> DataFrame:
    """The long accuracy history: one row per (entity-event, target)."""
    ids = [c for c in ("season", "week", "game_id", "gsis_id", "player_display_name", "position", "team", "opponent_team") if c in scored.columns]
    a = F.col(target).cast("double")
    return scored.select(
        *ids, F.lit(target).alias("target"), F.lit(form).alias("form"), F.lit(trained_through).cast("bigint").alias("trained_through"),
        "pred", a.alias("actual"), F.abs(F.col("pred") - a).alias("abs_err_model"),
        F.abs(F.col("b1") - a).alias("abs_err_b1"), F.abs(F.col("b2") - a).alias("abs_err_b2"), F.abs(F.col("b3") - a).alias("abs_err_b3"),
    )


def per_cohort_predictions(train: DataFrame, test: DataFrame, target: str, features: list[str], kind: str, cohorts: list[str], cohort="position", p: Params = Params()) -> DataFrame:
    """A model per cohort, the pooled one where a cohort is thin."""
    pooled = None
    out = None
    for c in cohorts:
        mine = train.where(F.col(cohort) == c)
        if enough_rows(mine, MIN_COHORT):
            m = fit(mine, target, features, kind, p)
        else:
            pooled = pooled or fit(train, target, features, kind, p)
            m = pooled
        part = predict(m, test.where(F.col(cohort) == c), features, "pred")
        out = part if out is None else out.unionByName(part)
    return out


def with_recency(train: DataFrame, era: str, latest: int) -> DataFrame:
    return train.withColumn("__w", recency_weight(F.lit(latest) - F.col(era)))


def strata_errors(df: DataFrame, by: list[str], actual: str, base: str, arm: str, rank="depth_rank_capped", games="f_games_prior", min_rank=50, min_cold=30) -> DataFrame:
    """MAE of both arms pooled and on the starter and no-history strata, with the gain in percent."""
    tags = F.filter(
        F.array(
            F.lit("pooled"),
            F.when(F.col(rank) == 1, "rank1"),
            F.when(F.coalesce(F.col(games), F.lit(0)) < 3, "cold"),
        ),
        lambda s: s.isNotNull(),
    )
    e = df.select(
        *by, F.explode(tags).alias("stratum"), F.abs(F.col(actual) - F.col(base)).alias("b"), F.abs(F.col(actual) - F.col(arm)).alias("a")
    )
    g = e.groupBy(*by, "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("base"), F.avg("a").alias("arm"))
    floor = F.when(F.col("stratum") == "rank1", min_rank).when(F.col("stratum") == "cold", min_cold).otherwise(1)
    return g.where(F.col("n") >= floor).withColumn("delta_pct", 100 * (1 - ratio(F.col("arm"), F.col("base"))))


def two_stage_verdict(deltas: DataFrame, block: str, metric: str, fold: str, first: str, second: str) -> DataFrame:
    """Verdict per block over the metrics it moved: SHIP needs both folds and three repeated wins."""
    piv = deltas.groupBy(block, metric).pivot(fold, [first, second]).agg(F.avg("delta_pct"))
    f1, f2 = F.col(first), F.col(second)
    moved = piv.where(f1.isNotNull() & f2.isNotNull() & ((F.abs(f1) > 1e-9) | (F.abs(f2) > 1e-9)))
    v = moved.groupBy(block).agg(
        F.avg(f1).alias("mean_1"), F.avg(f2).alias("mean_2"), F.count(F.lit(1)).alias("moved"),
        F.count_if((f1 > 0) & (f2 > 0)).alias("repeated_wins"), F.count_if((f1 < 0) & (f2 < 0)).alias("repeated_losses"),
    )
    ship = (F.col("mean_1") > 0) & (F.col("mean_2") > 0) & (F.col("repeated_wins") >= 3)
    return v.withColumn("verdict", F.when(ship, "SHIP").when(F.col("mean_1") > 0, "MIRAGE").otherwise("REJECT"))
