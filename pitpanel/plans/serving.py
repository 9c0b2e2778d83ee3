"""Walk-forward accuracy of all targets, the gate, the versioned store of models and the serving table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pitpanel.operators import additive as ad
from pitpanel.operators.aggregates import ratio
from pitpanel.operators.models import MIN_TEST, MIN_TRAIN, TARGETS
from pitpanel.operators.packs import Pack, Packs, Reduced, opened, packed_rows, reader
from pitpanel.session import materialise
from pitpanel.sources import sinks

IDS = ("week", "game_id", "gsis_id", "team", "opponent_team", "depth_rank_capped", "f_games_prior")
#: Rows behind either error that decides on the form of a yards model.
MIN_FORM = 50


def baseline_columns(columns: list[str], plan: ad.Plan) -> list[str]:
    """Columns of the panel that baselines and compound forms read."""
    wanted = [f"f_{k}_{t}" for t in plan.targets for k in ("std", "career")] + [r for *_, r in TARGETS.values() if r]
    return [c for c in dict.fromkeys(wanted) if c in columns]


LONG = "target string, kind string, actual double, direct double, compound double, train_mean double, n_train long, std double, career double, opportunity double, rate double"


def long_rows(packs: Packs, models: DataFrame, plan: ad.Plan, kept: list) -> DataFrame:
    """Packs as one row per (row, variant, target) with an actual value: predictions of both forms, by the models of the row's own era, and what baselines need.

    ``kept``: the fields that the packs carry besides."""
    keep = [f for f in kept if f.name in (*IDS, "era", "cohort")]
    known_columns = {*[f.name for f in kept], *plan.features}
    shared = packs.df.sparkSession.sparkContext.broadcast(ad.scorers(models, plan))
    fields = [f.split(" ")[0] for f in LONG.split(", ")]
    schema = T.StructType([T.StructField("era", T.LongType()), T.StructField("cohort", T.StringType()), *keep, T.StructField("variant", T.StringType()), *T.StructType.fromDDL(LONG).fields])
    read = reader(packs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in batches:
            for q in opened(part, read, rest=True):
                for variant, s in _scorers_of(known, q, plan):
                    p, mean, n = s.predicted(q.cohort, Reduced(q.x)), s.trait(q.cohort, "train_mean"), s.trait(q.cohort, "n_train")
                    some = [_of_target(q, k, plan, p, mean[k], n[k], known_columns) for k in range(len(plan.targets)) if q.cohort is not None and not np.isnan(q.y[:, k]).all()]
                    if some:
                        at = pa.array(np.concatenate([r for r, _ in some]))
                        columns = [pa.concat_arrays([d[f] for _, d in some]) for f in fields]
                        m = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(pa.scalar(q.era, pa.int64()), m), pa.repeat(pa.scalar(q.cohort, pa.string()), m), *[q.rest.column(f.name).take(at) for f in keep], pa.repeat(pa.scalar(variant, pa.string()), m), *columns],
                            schema.names,
                        )

    return packs.df.drop("own").mapInArrow(run, schema)


def _scorers_of(known: dict, q: Pack, plan: ad.Plan) -> list[tuple]:
    """(variant, scorer) of all variants with models of the pack's era and cohort; a scorer without models if there are none."""
    return [(v, folds[q.era]) for v, folds in known.items() if q.era in folds and q.cohort in folds[q.era].by] or [(None, ad.Scorer({}, plan))]


def _of_target(q: Pack, k: int, plan: ad.Plan, p: np.ndarray, train_mean, n_train, names) -> tuple[np.ndarray, dict]:
    """Places in the pack, and columns, of one target's rows with an actual value."""
    t = plan.targets[k]
    _, kind, opp, rate = TARGETS[t]
    there = ~np.isnan(q.y[:, k])
    at = np.flatnonzero(there)
    n = len(at)

    def first(*wanted):
        return pa.array(_first(q, plan, names, wanted)[at], pa.float64(), from_pandas=True)

    said = lambda i: pa.array(p[there, i], pa.float64(), from_pandas=True)
    by_rate = first(rate) if rate else pa.nulls(n, pa.float64())
    compound = pc.multiply(said(plan.targets.index(opp)), by_rate) if kind == "yards" and opp in plan.targets and rate in names else pa.nulls(n, pa.float64())
    return at, {
        "target": pa.repeat(t, n), "kind": pa.repeat(kind, n), "actual": pa.array(q.y[at, k]), "direct": said(k), "compound": compound,
        "train_mean": pa.repeat(pa.scalar(train_mean, pa.float64()), n), "n_train": pa.repeat(pa.scalar(n_train, pa.int64()), n), "std": first(f"f_std_{t}"),
        "career": first(f"f_career_{t}"), "opportunity": first(f"f_std_{opp}", f"f_career_{opp}") if opp else pa.nulls(n, pa.float64()), "rate": by_rate,
    }


def _first(q: Pack, plan: ad.Plan, names, wanted) -> np.ndarray:
    """The first of some columns that is known, NaN where it is missing or none is."""
    found = next((c for c in wanted if c in names), None)
    if found in plan.features:
        return q.x[:, plan.features.index(found)]
    return q.rest.column(found).cast(pa.float64()).to_numpy(zero_copy_only=False) if found else np.full(len(q.x), np.nan)


def accuracy(packs: Packs, models: DataFrame, plan: ad.Plan, kept: list) -> DataFrame:
    """The long accuracy history: one row per (row, target, variant) with form, pred, b1, b2, b3 and the errors.

    A yards target takes the form, compound or direct, that had the smaller error in the era before. Rows of folds
    below the floors keep their place with a reason and no prediction.
    """
    long = materialise(long_rows(packs, models, plan, kept), "accuracy")
    by = ["variant", "era", "target"]
    error = lambda p: F.avg(F.abs(F.col("actual") - F.col(p)))
    per = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg("opportunity").alias("mean_opportunity"), error("direct").alias("e_direct"), error("compound").alias("e_compound"),
        F.count("direct").alias("n_direct"),
    )
    chosen = (F.col("e_compound") <= F.col("e_direct")) & (F.col("n_direct") >= MIN_FORM)
    form = per.select("variant", (F.col("era") + 1).alias("era"), "target", F.when(chosen, "compound").alias("form"))
    # A row per (variant, era, target): bounded by the plan, whatever the rows.
    per = per.join(form, by, "left").select(*by, "n_test", "mean_opportunity", "form")
    found = long.join(F.broadcast(per), by)
    n = F.coalesce("n_train", F.lit(0))
    reason = F.when(n < MIN_TRAIN, f"under {MIN_TRAIN} training rows").when(F.col("n_test") < MIN_TEST, f"under {MIN_TEST} rows to test on")
    form = F.when(F.col("kind") == "count", "count").otherwise(F.coalesce(F.when(F.col("compound").isNotNull(), F.col("form")), F.lit("direct")))
    pred = F.when(form == "compound", F.col("compound")).otherwise(F.col("direct"))
    b1 = F.col("train_mean")
    with_rate = F.coalesce("opportunity", "mean_opportunity") * F.col("rate")
    out = found.withColumns({"reason": reason, "form": form}).withColumns({
        "pred": F.when(F.col("reason").isNull(), pred), "b1": F.when(F.col("reason").isNull(), b1), "b2": F.when(F.col("reason").isNull(), F.coalesce("std", b1)),
        "b3": F.when(F.col("reason").isNull(), F.when(F.col("rate").isNotNull() | (F.col("kind") == "yards"), F.coalesce(with_rate, "career", b1)).otherwise(F.coalesce("career", b1))),
    })
    drop = ("direct", "compound", "std", "career", "opportunity", "mean_opportunity", "rate", "train_mean", "kind")
    return out.withColumn("trained_through", F.col("era") - 1).drop(*drop)


def fold_scores(history: DataFrame, by: tuple[str, ...] = ("variant", "era", "target")) -> DataFrame:
    """n, form and errors per fold, with the reason of those left out, and the ship gate of each."""
    e = {p: F.avg(F.abs(F.col("actual") - F.col(p))).alias(f"{p}_mae") for p in ("pred", "b1", "b2", "b3")}
    s = history.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_test"), F.coalesce(F.max("n_train"), F.lit(0)).cast("long").alias("n_train"), F.max("reason").alias("reason"), F.max("form").alias("form"), *e.values()
    )
    return _graded(s)


def _graded(s: DataFrame) -> DataFrame:
    m = F.col("pred_mae")
    passes = (m < F.col("b2_mae")) & (m < F.col("b3_mae"))
    shown = F.when(m.isNull(), F.lit(None).cast("string")).when(~passes, "baseline").when(m >= F.col("b1_mae"), "model_low_confidence").otherwise("model")
    out = s.withColumns({f"skill_vs_{b}": 100 * (1 - ratio(m, F.col(f"{b}_mae"))) for b in ("b1", "b2", "b3")})
    return out.withColumns({"passes_gate": passes, "present_as": shown})


ERRORS = ("n_test", "direct", "n_direct", "compound", "n_compound", "mixed", "n_mixed", "b1", "n_b1", "b2", "n_b2", "b3", "n_b3")


def fold_errors(packs: Packs, models: DataFrame, plan: ad.Plan) -> DataFrame:
    """variant, era, target, form, reason, n_test, n_train, and sums and counts of the errors of pred, b1, b2, b3: what ``accuracy`` says, summed in the tasks.

    No row per (row, target) leaves a task. The error of either form of a yards model is summed, and that of the era before decides which one counts.
    """
    packs = after_first(packs)
    read, names = reader(packs), {*plan.features}
    yards = [t for t in plan.targets if TARGETS[t][2]]

    def openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for part in batches:
            for q in opened(part, read):
                for t in yards if q.cohort is not None else []:
                    v = _first(q, plan, names, (f"f_std_{TARGETS[t][2]}", f"f_career_{TARGETS[t][2]}"))
                    v = v[~np.isnan(q.y[:, plan.targets.index(t)]) & ~np.isnan(v)]
                    key = (q.era, t)
                    sums[key] = sums.get(key, 0) + np.array([v.sum(), len(v)])
        yield pa.RecordBatch.from_pylist([{"era": e, "target": t, "s": float(s), "n": float(n)} for (e, t), (s, n) in sums.items()], pa.schema([("era", pa.int64()), ("target", pa.string()), ("s", pa.float64()), ("n", pa.float64())]))

    found = packs.df.drop("rest", "own").mapInArrow(openings, "era long, target string, s double, n double").groupBy("era", "target").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    opportunity = {(r.era, r.target): r.s / r.n for r in found.where("n > 0").collect()}  # a row per (era, target)
    shared = packs.df.sparkSession.sparkContext.broadcast((ad.scorers(models, plan), opportunity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, opportunity = shared.value
        sums: dict[tuple, np.ndarray] = {}
        n_train: dict[tuple, int] = {}
        off = lambda y, v: (float(np.nansum(np.abs(y - v))), int((~np.isnan(v)).sum()))
        for part in batches:
            for q in opened(part, read):
                if q.cohort is None or np.isnan(q.y).all():
                    continue
                r = Reduced(q.x)
                for variant, s in _scorers_of(known, q, plan):
                    p, mean, n = s.predicted(q.cohort, r), s.trait(q.cohort, "train_mean"), s.trait(q.cohort, "n_train")
                    for k, t in enumerate(plan.targets):
                        there = ~np.isnan(q.y[:, k])
                        if not there.any():
                            continue
                        _, kind, opp, rate = TARGETS[t]
                        column = lambda *wanted: _first(q, plan, names, wanted)[there]  # noqa: B023, E731
                        y, direct, b1 = q.y[there, k], p[there, k], np.full(int(there.sum()), np.nan if mean[k] is None else mean[k])
                        by_rate = column(rate) if rate else np.full(len(y), np.nan)
                        compound = p[there, plan.targets.index(opp)] * by_rate if kind == "yards" and opp in plan.targets and rate in names else np.full(len(y), np.nan)
                        std, career = column(f"f_std_{t}"), column(f"f_career_{t}")
                        b3 = np.where(np.isnan(career), b1, career)
                        if opp:
                            chance = column(f"f_std_{opp}", f"f_career_{opp}")
                            with_rate = np.where(np.isnan(chance), opportunity.get((q.era, t), np.nan), chance) * by_rate
                            b3 = np.where(np.isnan(with_rate), b3, with_rate)
                        own = [len(y), *off(y, direct), *off(y, compound), *off(y, np.where(np.isnan(compound), direct, compound)), *off(y, b1), *off(y, np.where(np.isnan(std), b1, std)), *off(y, b3)]
                        key = (variant, q.era, t)
                        sums[key] = sums.get(key, 0) + np.array(own, float)
                        n_train[key] = max(n_train.get(key, 0), n[k] or 0)
        part = TaskContext.get().partitionId()
        rows = [{"variant": v, "era": e, "target": t, "part": part, "n_train": int(n_train[v, e, t]), "sums": s.tolist()} for (v, e, t), s in sums.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("variant", pa.string()), ("era", pa.int64()), ("target", pa.string()), ("part", pa.int32()), ("n_train", pa.int64()), ("sums", pa.list_(pa.float64()))]))

    by = ["variant", "era", "target"]
    parts = materialise(packs.df.drop("rest", "own").mapInArrow(run, "variant string, era long, target string, part int, n_train long, sums array<double>"), "errors")
    per = ad.summed(parts, by).alias("s").join(parts.groupBy(*by).agg(F.max("n_train").alias("n_train")).alias("n"), [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by])
    per = per.select(*[F.col(f"s.{c}").alias(c) for c in by], "n_train", *[F.col("sums")[i].alias(f"__{c}") for i, c in enumerate(ERRORS)])
    per = per.withColumn("n_test", F.col("__n_test").cast("long")).drop("__n_test")
    # A row per (variant, era, target): bounded by the plan, whatever the rows.
    per = materialise(per, "errors")
    mean = lambda c: F.when(F.col(f"__n_{c}") > 0, F.col(f"__{c}") / F.col(f"__n_{c}"))
    chosen = (mean("compound") <= mean("direct")) & (F.col("__n_direct") >= MIN_FORM)
    form = per.select("variant", (F.col("era") + 1).alias("era"), "target", chosen.alias("__chosen"))
    kind = F.col("target").isin([t for t in plan.targets if TARGETS[t][1] == "count"])
    n = F.col("n_train")
    reason = F.when(n < MIN_TRAIN, f"under {MIN_TRAIN} training rows").when(F.col("n_test") < MIN_TEST, f"under {MIN_TEST} rows to test on")
    out = per.join(form, by, "left").withColumn("__mixed_form", ~kind & F.coalesce("__chosen", F.lit(False)))
    out = out.withColumns({"reason": reason, "form": F.when(kind, "count").when(F.col("__mixed_form") & (F.col("__n_compound") >= F.col("n_test")), "compound").otherwise("direct")})
    error = F.when(F.col("__mixed_form"), F.col("__mixed")).otherwise(F.col("__direct"))
    count = F.when(F.col("__mixed_form"), F.col("__n_mixed")).otherwise(F.col("__n_direct"))
    ok = F.col("reason").isNull()
    pairs = {"pred": (error, count)} | {b: (F.col(f"__{b}"), F.col(f"__n_{b}")) for b in ("b1", "b2", "b3")}
    sums = [x for p, (e, c) in pairs.items() for x in (F.when(ok, e).alias(f"{p}_error"), F.when(ok, c).alias(f"{p}_n"))]
    return out.select(*by, "form", "reason", "n_test", "n_train", F.col("__mixed_form").alias("compound_first"), *sums)


def predictions(packs: Packs, models: DataFrame, plan: ad.Plan, errors: DataFrame, kept: list, variant: str = "base") -> DataFrame:
    """target, era, the fields the packs carry, pred, actual: the predictions of one variant in ``accuracy``, and no more of a row than that."""
    packs = after_first(packs)
    read, names = reader(packs), {*[f.name for f in kept], *plan.features}
    forms = {(r.era, r.target): r.compound_first for r in errors.where((F.col("variant") == variant) & F.col("reason").isNull()).collect()}  # a row per fold
    shared = packs.df.sparkSession.sparkContext.broadcast((ad.scorers(models, plan).get(variant, {}), forms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, forms = shared.value
        for part in batches:
            for q in opened(part, read, rest=True):
                if q.era not in folds or q.cohort not in folds[q.era].by:
                    continue
                p = folds[q.era].predicted(q.cohort, Reduced(q.x))
                for k, t in enumerate(plan.targets):
                    if (q.era, t) in forms:
                        _, _, opp, rate = TARGETS[t]
                        pred = p[:, k]
                        if forms[q.era, t]:
                            compound = p[:, plan.targets.index(opp)] * _first(q, plan, names, (rate,))
                            pred = np.where(np.isnan(compound), pred, compound)
                        at = np.flatnonzero(~np.isnan(q.y[:, k]) & ~np.isnan(pred))
                        if len(at):
                            yield pa.RecordBatch.from_arrays(
                                [pa.repeat(pa.scalar(t), len(at)), pa.repeat(pa.scalar(q.era, pa.int64()), len(at)), *[q.rest.column(f.name).take(pa.array(at)) for f in kept], pa.array(pred[at]), pa.array(q.y[at, k])],
                                ["target", "era", *[f.name for f in kept], "pred", "actual"],
                            )

    schema = T.StructType([T.StructField("target", T.StringType()), T.StructField("era", T.LongType()), *kept, T.StructField("pred", T.DoubleType()), T.StructField("actual", T.DoubleType())])
    return packs.df.drop("own").mapInArrow(run, schema)


def scored_folds(errors: DataFrame) -> DataFrame:
    """``fold_scores`` from summed errors."""
    return _graded(errors.groupBy("variant", "era", "target").agg(
        F.sum("n_test").alias("n_test"), F.max("n_train").alias("n_train"), F.max("reason").alias("reason"), F.max("form").alias("form"), *_means()
    ))


def gate_of(errors: DataFrame) -> DataFrame:
    """``gate`` from summed errors."""
    return _graded(errors.where("reason IS NULL").groupBy("variant", "target").agg(F.sum("n_test").alias("n_test"), *_means()))


def _means() -> list[Column]:
    return [F.when(F.sum(f"{p}_n") > 0, F.sum(f"{p}_error") / F.sum(f"{p}_n")).alias(f"{p}_mae") for p in ("pred", "b1", "b2", "b3")]


def gate(history: DataFrame) -> DataFrame:
    """One verdict per (variant, target) over all scored folds together."""
    return fold_scores(history.where("reason IS NULL"), ("variant", "target")).drop("n_train", "form", "reason")


def walk_forward(
    panel: DataFrame, plan: ad.Plan, variants: list[ad.Variant] = [ad.Variant()], passes: int = ad.PASSES, ids: tuple[str, ...] = IDS
) -> tuple[DataFrame, DataFrame]:
    """(models, accuracy history) of all targets, folds and variants from one vector table; `ids` are the columns that name a row of the history."""
    keep = [c for c in ids if c in panel.columns]
    keep += [c for c in baseline_columns(panel.columns, plan) if c not in keep and c not in plan.features]  # features are in the vectors
    vec = ad.vectors(panel, plan, keep)
    kept = [f for f in vec.schema.fields if f.name not in ("era", "cohort", "x", "y")]
    packs = ad.packed_once(vec, plan, [f.name for f in kept])
    models = materialise(ad.train(packs, plan, variants, passes), "models")
    return models, accuracy(after_first(packs), models, plan, kept)


def after_first(packs: Packs) -> Packs:
    """The packs of all eras but the first, which no model scores."""
    first = packs.df.agg(F.min("era")).first()[0]
    return replace(packs, df=packs.df.where(F.col("era") > F.lit(first)))


def publish(models: DataFrame, verdicts: DataFrame, path: str, variant: str = "base") -> int:
    """A version of the store: each model of the variant with its verdict; those that fail the gate are kept without coefficients.

    Nothing is written, and no version is claimed, when no target passes.
    """
    v = verdicts.where(F.col("variant") == variant).select("target", "n_test", "pred_mae", "b1_mae", "b2_mae", "b3_mae", "passes_gate", "present_as")
    passed = v.where("passes_gate").count()
    refused = F.when(~F.coalesce("passes_gate", F.lit(False)), "refused by the gate")
    rows = models.where(F.col("variant") == variant).join(F.broadcast(v), "target", "left")
    rows = rows.withColumn("reason", F.coalesce("reason", refused)).withColumn("coef", F.when(F.col("reason").isNull(), F.col("coef")))
    return sinks.gate_then_write(rows, path, passed > 0, "no target beats its baselines")


def load(spark: SparkSession, path: str) -> DataFrame:
    found = sinks.read_latest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no committed version of models in {path}")
    return found


def serve(rows: DataFrame, models: DataFrame, plan: ad.Plan, keep: list[str], p_play: str | None = None) -> DataFrame:
    """keep and, for every target, <t> (model, else the era-to-date mean, the career mean or the training mean), <t>_source
    and <t>_expected (times the chance to appear). Null outside a target's cohorts. Models are those of the row's era, or the newest before."""
    base = [c for c in baseline_columns(rows.columns, plan) if c not in keep and c not in plan.features]
    chance = [p_play] if p_play and p_play not in keep else []
    vec = ad.vectors(rows, plan, [*keep, *base, *chance])
    kept = [f for f in vec.schema.fields if f.name not in ("era", "cohort", "x", "y")]
    return serve_packs(Packs(packed_rows(vec, plan, [f.name for f in kept]), plan.features, plan.targets), models, plan, kept, keep, p_play)


def serve_packs(packs: Packs, models: DataFrame, plan: ad.Plan, kept: list, keep: list[str], p_play: str | None = None) -> DataFrame:
    """``serve`` for rows in packs that carry the fields ``kept``."""
    read, names = reader(packs), {*[f.name for f in kept], *plan.features}
    shared = packs.df.sparkSession.sparkContext.broadcast({f: s for folds in ad.scorers(models, plan).values() for f, s in folds.items()})
    passed = [f for f in kept if f.name in keep or f.name == p_play]
    listed = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), from_pandas=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, nt = shared.value, len(plan.targets)
        for part in batches:
            for q in opened(part, read, rest=True):
                n = len(q.x)
                p, instead = np.full((n, nt), np.nan), np.full((n, nt), np.nan)
                s = ad.newest_before(folds, q.era)
                if s is not None:
                    p, instead = s.predicted(q.cohort, Reduced(q.x)), np.tile(np.array(s.trait(q.cohort, "train_mean"), float), (n, 1))
                for k, t in enumerate(plan.targets):
                    for c in (f"f_career_{t}", f"f_std_{t}"):
                        known = _first(q, plan, names, (c,))
                        instead[:, k] = np.where(np.isnan(known), instead[:, k], known)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(q.era, pa.int64()), n), pa.repeat(pa.scalar(q.cohort, pa.string()), n), *[q.rest.column(f.name) for f in passed], listed(p), listed(instead)],
                    ["era", "cohort", *[f.name for f in passed], "p", "instead"],
                )

    numbers = T.ArrayType(T.DoubleType())
    found = packs.df.drop("own").mapInArrow(run, T.StructType([T.StructField("era", T.LongType()), T.StructField("cohort", T.StringType()), *passed, T.StructField("p", numbers), T.StructField("instead", numbers)]))
    out = []
    for k, t in enumerate(plan.targets):
        cohorts, _, _, _ = TARGETS[t]
        mine = F.col("cohort").isin(cohorts)
        value = F.when(mine, F.coalesce(F.col("p")[k], F.col("instead")[k]))
        source = F.when(mine & F.col("p")[k].isNotNull(), "model").when(mine & F.col("instead")[k].isNotNull(), "baseline")
        out += [value.alias(t, metadata={"estimand": "conditional"}), source.alias(f"{t}_source")]
        if p_play:
            out.append((value * F.col(p_play)).alias(f"{t}_expected", metadata={"estimand": "expected"}))
    named = {plan.era: F.col("era").alias(plan.era), plan.cohort: F.col("cohort").alias(plan.cohort)}
    return found.select(*[named.get(c, F.col(c)) for c in keep], *([p_play] if p_play and p_play not in keep else []), *out)
