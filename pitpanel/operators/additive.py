"""Models of every target, fold and variant from one pass of additive statistics, kept and served as data.

A row of the panel becomes one vector: a constant, the features with 0 for a missing one, and a flag for each missing one.
(In a model that is linear in its columns, the flag absorbs whatever else a missing value is filled with.) The cross-products of
these vectors with themselves and with all targets are summed per (era, cohort, which targets are present). Everything
that a fit needs is a sum of such matrices: a fold adds up the eras before it, recency weighs them, a cohort is a
subset, another feature set is a choice of rows and columns. Their size depends on the number of columns, eras and
cohorts, never on the number of rows.

Yards are fitted by ridge regression. Counts have a log link: they start from the same matrices and are refined by a few passes
over the vectors, each of which sums the gradients of all (variant, fold, cohort, target) models at once; a model's step is
preconditioned by its own matrix, and halved where its likelihood fell.

A model is a row: version, variant, fold, cohort, target, coefficients, its training rows and mean, or the reason why
there is none. Rows are scored by one matrix product per pack, that is by era and cohort, all targets together. All passes read packs (``packs``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pitpanel.functions.prob import RECENCY_HALF_LIFE
from pitpanel.operators.models import MIN_COHORT, MIN_TEST, MIN_TRAIN, TARGETS, MissingFeature
from pitpanel.operators.packs import Packs, Reduced, opened, packed_rows, reader
from pitpanel.session import constant_table, materialise

#: Rows that a model has at least, so that it can decide on the form of the next fold.
MIN_FIT = 50
RIDGE = 0.05
PASSES = 6
#: A prediction of a log-link model is at most e ** SPAN times the training mean.
SPAN = 1.5
STATS = "era long, cohort string, present long, place int, part int, sums array<double>"
MODELS = "variant string, fold long, cohort string, target string, link string, coef array<double>, n_train long, train_mean double, reason string"


@dataclass(frozen=True)
class Variant:
    """A way to train: which features, how eras are weighed, one model or one per cohort."""

    name: str = "base"
    leave_out: str | None = None  # features with this prefix
    recency: bool = False
    per_cohort: bool = False


@dataclass(frozen=True)
class Plan:
    """Columns of a panel: features and targets in the order of the vectors."""

    features: tuple[str, ...]
    targets: tuple[str, ...]
    era: str = "season"
    cohort: str = "position"

    @property
    def width(self) -> int:
        return 1 + 2 * len(self.features)

    def link(self, target: str) -> str:
        return "log" if TARGETS[target][1] == "count" else "identity"


def plan_for(df: DataFrame, era: str = "season", cohort: str = "position", extra: tuple[str, ...] = ("depth_rank_capped",)) -> Plan:
    """Every numeric feature column (f_*), `extra`, and the targets that the panel has."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
    features = [c for c, t in df.dtypes if c.startswith("f_") and (t in kinds or t.startswith("decimal"))]
    return Plan((*features, *[c for c in extra if c in df.columns]), tuple(t for t in TARGETS if t in df.columns), era, cohort)


def vectors(df: DataFrame, plan: Plan, keep: list[str]) -> DataFrame:
    """keep, era, cohort, x (features, NaN where missing), y (targets, NaN where the row is not eligible).

    x and y are 64-bit floats packed into one binary value each, so that a pass over the vectors moves two values a row, not some hundred.
    """
    gone = [c for c in plan.features if c not in df.columns]
    if gone:
        raise MissingFeature(f"{len(gone)} trained column(s) missing: {gone[:8]}")
    kept = [c for c in dict.fromkeys(keep) if c not in (plan.era, plan.cohort)]
    there = [t for t in plan.targets if t in df.columns]
    wide = df.where(F.col(plan.era).isNotNull()).select(
        *kept, F.col(plan.era).cast("long").alias("era"), F.col(plan.cohort).alias("cohort"),
        *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(plan.features)], *[F.col(t).cast("double").alias(f"__y_{t}") for t in there],
    )
    kept = [*kept, "era", "cohort"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n = part.num_rows
            x, y = np.empty((n, len(plan.features))), np.full((n, len(plan.targets)), np.nan)
            for i in range(len(plan.features)):
                x[:, i] = part.column(f"__x{i}").to_numpy(zero_copy_only=False)
            cohort = np.array(part.column("cohort").to_pylist(), dtype=object)
            for k, t in enumerate(plan.targets):
                if t in there:
                    v = part.column(f"__y_{t}").to_numpy(zero_copy_only=False).astype(float)
                    ok = np.isin(cohort, TARGETS[t][0]) if n else np.zeros(0, bool)
                    y[:, k] = np.where(ok & (v >= 0) if plan.link(t) == "log" else ok, v, np.nan)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], packed(x), packed(y)], [*kept, "x", "y"])

    schema = T.StructType([*[wide.schema[c] for c in kept], T.StructField("x", T.BinaryType()), T.StructField("y", T.BinaryType())])
    return wide.mapInArrow(run, schema)


def packed(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    at = np.arange(len(m) + 1, dtype=np.int32) * np.int32(8 * m.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(m, np.float64).tobytes())])


def unpacked(column: pa.Array, k: int) -> np.ndarray:
    n = len(column)
    if not n or not k:
        return np.zeros((n, k))
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    return np.frombuffer(column.buffers()[2], np.float64, n * k, at[0]).reshape(n, k)


def grouped(part: pa.RecordBatch, *more: np.ndarray) -> Iterator[tuple]:
    """(era, cohort, *values of `more`, their rows) of a batch; rows without a cohort are in none."""
    coded = part.column("cohort").dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.stack([part.column("era").to_numpy(zero_copy_only=False).astype(np.int64), code, *more], axis=1)
    names = coded.dictionary.to_pylist()
    found, of = np.unique(keys, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(found)))
    for (era, c, *rest), begin, end in zip(found.tolist(), [0, *ends[:-1]], ends):
        if c >= 0:
            yield (era, names[c], *rest, order[begin:end])


def packed_once(vec: DataFrame | Packs, plan: Plan, keep: list[str] = []) -> Packs:
    """The rows as a written table of packs, which all passes read."""
    if isinstance(vec, Packs):
        return vec
    return Packs(materialise(packed_rows(vec, plan, keep), "packs"), plan.features, plan.targets)


def statistics(packs: Packs, plan: Plan) -> DataFrame:
    """era, cohort, present (bit mask of targets), place (row of the matrix), sums: [columns' | targets'] cross-products."""
    read = reader(packs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[tuple, np.ndarray] = {}
        bit = 1 << np.arange(len(plan.targets), dtype=np.int64)
        for part in batches:
            for p in opened(part, read):
                there = ~np.isnan(p.y)
                mask = there @ bit
                y = np.where(there, p.y, 0)
                for present in np.unique(mask).tolist() if p.cohort is not None else []:
                    if present:
                        mine = mask == present
                        r = Reduced(p.x[mine])
                        m = sums.setdefault((p.era, p.cohort, present), np.zeros((plan.width, plan.width + len(plan.targets))))
                        whole, own = r.places()
                        m[np.ix_(whole, whole)] += (r.z.T @ r.z)[np.ix_(own, own)]
                        m[whole, plan.width :] += (r.z.T @ y[mine])[own]
        task = TaskContext.get().partitionId()
        for (era, cohort, present), m in sums.items():
            n = len(m)
            yield pa.RecordBatch.from_pydict({
                "era": pa.array([era] * n, pa.int64()), "cohort": pa.array([cohort] * n), "present": pa.array([present] * n, pa.int64()),
                "place": pa.array(range(n), pa.int32()), "part": pa.array([task] * n, pa.int32()), "sums": pa.array(list(m), pa.list_(pa.float64())),
            })

    parts = packs.df.select("era", "cohort", "n", "x", "y").mapInArrow(run, STATS)
    return summed(parts, ["era", "cohort", "present", "place"])


def summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sums of arrays per key, in the order of the partitions they come from, so that a retry repeats them."""
    inside = F.transform(F.sort_array(F.collect_list(F.struct("part", "sums"))), lambda s: s["sums"])
    zeros = F.transform(inside[0], lambda _: F.lit(0.0))
    return parts.groupBy(*keys).agg(F.aggregate(inside, zeros, lambda a, b: F.zip_with(a, b, lambda u, v: u + v)).alias("sums"))


def columns_of(plan: Plan, v: Variant) -> np.ndarray:
    f = [k for k, c in enumerate(plan.features) if not (v.leave_out and c.startswith(v.leave_out))]
    return np.array([0, *[1 + k for k in f], *[1 + len(plan.features) + k for k in f]])


class Scaled:
    """A cross-product matrix reduced to columns that vary and differ, centred and scaled."""

    def __init__(self, g: np.ndarray, use: np.ndarray):
        self.n = g[0, 0]
        mean, square = g[0] / self.n, np.diag(g) / self.n
        spread = np.sqrt(np.maximum(square - mean**2, 0))
        use = use[1:][spread[use[1:]] > 1e-7 * (1e-9 + np.sqrt(square[use[1:]]))]
        c = (g[np.ix_(use, use)] / self.n - np.outer(mean[use], mean[use])) / np.outer(spread[use], spread[use])
        twin = (np.abs(np.tril(c, -1)) > 1 - 1e-9).any(axis=1)  # the same column again, such as a flag that two features share
        self.use, self.mean, self.spread = use[~twin], mean[use[~twin]], spread[use[~twin]]
        self.c = c[np.ix_(~twin, ~twin)]

    def inverse(self) -> np.ndarray:
        return np.linalg.inv(self.c + RIDGE * np.eye(len(self.c)))

    def raw(self, intercept: float, slopes: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width)
        out[self.use] = slopes / self.spread
        out[0] = intercept - out[self.use] @ self.mean
        return out


def solve(stats: dict, plan: Plan, target: str, variants: list[Variant]) -> list[dict]:
    """Models of one target from {(era, cohort): matrix}, all folds and variants; log-link ones are a first step."""
    t, width = plan.width + plan.targets.index(target), plan.width
    cohorts = TARGETS[target][0]
    eras = sorted({e for e, _ in stats})
    out = []
    for v in variants:
        use = columns_of(plan, v)
        for fold in [*eras[1:], eras[-1] + 1] if eras else []:
            def total(some):
                past = [(e, m) for (e, c), m in stats.items() if e < fold and c in some]
                return sum((0.5 ** ((fold - 1 - e) / RECENCY_HALF_LIFE) if v.recency else 1.0) * m for e, m in past), sum(m[0, 0] for _, m in past)

            pooled = total(cohorts)
            for cohort in cohorts:
                g, n = total([cohort]) if v.per_cohort else pooled
                if v.per_cohort and n < MIN_COHORT:
                    g, n = pooled  # a thin cohort is served by all
                row = {"variant": v.name, "fold": fold, "cohort": cohort, "target": target, "link": plan.link(target), "n_train": int(n)}
                if n < MIN_FIT:
                    out.append(row | {"reason": f"under {MIN_FIT} training rows"})
                    continue
                mean = g[0, t] / g[0, 0]
                s = Scaled(g[:width, :width], use)
                slopes = s.inverse() @ ((g[s.use, t] / s.n - mean * s.mean) / s.spread)
                if row["link"] == "log":
                    coef = s.raw(np.log(max(mean, 1e-9)), slopes / max(mean, 1e-9), width)
                else:
                    coef = s.raw(mean, slopes, width)
                out.append(row | {"coef": coef, "train_mean": mean})
    return out


def by_pair(pdf: pd.DataFrame, width: int) -> dict:
    out: dict[tuple, np.ndarray] = {}
    for (era, cohort), own in pdf.groupby(["era", "cohort"], sort=False):
        m = np.zeros((width, len(own["sums"].iloc[0])))
        np.add.at(m, own["place"].to_numpy(), np.stack(own["sums"].to_numpy()))
        out[int(era), cohort] = m
    return out


def of_targets(stats: DataFrame, plan: Plan) -> DataFrame:
    """Statistics once per target that their rows are eligible for."""
    rows = [{"target": t, "bit": 1 << k, "among": TARGETS[t][0]} for k, t in enumerate(plan.targets)]
    names = constant_table(stats.sparkSession, rows, "target:string,bit:bigint,among:array<string>")
    return stats.join(F.broadcast(names), F.array_contains("among", F.col("cohort")) & (F.col("present").bitwiseAND(F.col("bit")) != 0))


def first_models(stats: DataFrame, plan: Plan, variants: list[Variant]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = solve(by_pair(pdf, plan.width), plan, pdf["target"].iloc[0], variants)
        names = [f.split(" ")[0] for f in MODELS.split(", ")]
        return pd.DataFrame([[r.get(c) if c != "coef" else (r["coef"].tolist() if "coef" in r else None) for c in names] for r in found], columns=names)

    return of_targets(stats, plan).groupBy("target").applyInPandas(run, MODELS)


def gradients(packs: Packs, plan: Plan, rows: list, variants: dict[str, Variant]) -> DataFrame:
    """model (place in rows), sums: [negative log-likelihood, gradient of it]; one pass for all models.

    `rows` are the models' coefficients, some hundred numbers each for (variant, fold, cohort, target); they travel with the job.
    """
    fold = np.array([r["fold"] for r in rows])
    w = np.array([r["coef"] for r in rows]).T
    t = np.array([plan.targets.index(r["target"]) for r in rows])
    cap = np.log(np.maximum([r["train_mean"] for r in rows], 1e-9)) + SPAN
    half = np.array([variants[r["variant"]].recency for r in rows])
    own = [frozenset([r["cohort"]]) if r["alone"] else frozenset(TARGETS[r["target"]][0]) for r in rows]
    shared = packs.df.sparkSession.sparkContext.broadcast((fold, w, t, cap, half, own))

    read = reader(packs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fold, w, t, cap, half, own = shared.value
        sums = np.zeros((len(fold), 1 + plan.width))
        asks: dict[tuple, tuple] = {}
        for part in batches:
            for p in opened(part, read):
                if (p.era, p.cohort) not in asks:  # the models that learn from this era and cohort, and its weight in each
                    m = np.flatnonzero((fold > p.era) & np.array([p.cohort in c for c in own], bool))
                    asks[p.era, p.cohort] = m, np.where(half[m], 0.5 ** (np.maximum(fold[m] - 1 - p.era, 0) / RECENCY_HALF_LIFE), 1.0)
                m, weight = asks[p.era, p.cohort]
                if not len(m):
                    continue
                r = Reduced(p.x)
                there = ~np.isnan(p.y)
                yt = np.where(there, p.y, 0)[:, t[m]]
                eta = np.clip(r.z @ r.fold(w[:, m]), -30, cap[m])
                mu = np.exp(eta)
                a = weight * there[:, t[m]]
                sums[m, 0] += (a * (mu - yt * eta)).sum(axis=0)
                whole, place = r.places()
                sums[np.ix_(m, 1 + whole)] += ((a * (mu - yt)).T @ r.z)[:, place]
        n = len(sums)
        yield pa.RecordBatch.from_pydict({
            "model": pa.array(range(n), pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * n, pa.int32()), "sums": pa.array(list(sums), pa.list_(pa.float64())),
        })

    return summed(packs.df.select("era", "cohort", "n", "x", "y").mapInArrow(run, "model int, part int, sums array<double>"), ["model"])


def train(vec: DataFrame | Packs, plan: Plan, variants: list[Variant] = [Variant()], passes: int = PASSES) -> DataFrame:
    """A row for each (variant, fold, cohort, target), see MODELS: every era after the first and the one to come.

    The models of one fit are a bounded table (targets, folds, cohorts and variants), and so are their matrices.
    """
    packs = packed_once(vec, plan)
    stats = materialise(statistics(packs, plan), "statistics")
    models = materialise(first_models(stats, plan, variants), "models")
    named = {v.name: v for v in variants}
    pooled = ["variant", "fold", "target"]
    log = models.where("link = 'log' AND coef IS NOT NULL")
    if passes and not log.isEmpty():
        log = refined(packs, stats, plan, log, named, passes)
        models = models.where("link <> 'log' OR coef IS NULL").unionByName(log)
    return models.select(*[f.split(" ")[0] for f in MODELS.split(", ")]).orderBy(*pooled, "cohort")


def refined(packs: Packs, stats: DataFrame, plan: Plan, log: DataFrame, variants: dict[str, Variant], passes: int) -> DataFrame:
    """Log-link models after some preconditioned steps; the best of all steps by penalised likelihood stays."""
    # Pooled models are the same for all cohorts of a target: one of them is refined.
    rows, place = [], {}
    for r in log.collect():
        alone = variants[r["variant"]].per_cohort
        key = (r["variant"], r["fold"], r["target"], r["cohort"] if alone else None)
        if key not in place:
            place[key] = len(rows)
            rows.append(r.asDict() | {"alone": alone})
    todo = pd.DataFrame({"model": range(len(rows)), "target": [r["target"] for r in rows]})
    state = [{"best": np.array(r["coef"]), "trial": np.array(r["coef"]), "value": np.inf, "move": None, "rate": 1.0} for r in rows]
    spark = packs.df.sparkSession
    for _ in range(passes):
        trial = [r | {"coef": s["trial"]} for r, s in zip(rows, state)]
        g = materialise(gradients(packs, plan, trial, variants), "gradients")
        ask = spark.createDataFrame(todo, "model int, target string").join(g, "model")
        for r in steps(ask, stats, plan, rows, [s["trial"] for s in state], variants).collect():
            s, value = state[r["model"]], r["value"]
            if value < s["value"]:
                s["best"], s["value"], s["rate"], s["move"] = s["trial"], value, min(1.0, 1.5 * s["rate"]), np.array(r["move"])
            else:
                s["rate"] /= 2
            s["trial"] = s["best"] - s["rate"] * s["move"]
    best = [(i, [float(x) for x in s["best"]]) for i, s in enumerate(state)]
    keys = [(*key, i) for key, i in place.items()]
    table = spark.createDataFrame(keys, "variant string, fold long, target string, own string, model int").join(
        spark.createDataFrame(best, "model int, refined array<double>"), "model"
    )
    joined = log.alias("a").join(table.alias("b"), (F.col("a.variant") == F.col("b.variant")) & (F.col("a.fold") == F.col("b.fold")) & (F.col("a.target") == F.col("b.target")) & F.coalesce(F.col("b.own") == F.col("a.cohort"), F.lit(True)))
    return joined.select(*[f"a.{c}" if c != "coef" else F.col("b.refined").alias("coef") for c in log.columns])


def steps(ask: DataFrame, stats: DataFrame, plan: Plan, rows: list, trial: list, variants: dict[str, Variant]) -> DataFrame:
    """model, value, move: the penalised likelihood and the gradient of each model, preconditioned by its own matrix; a task has one target's matrices."""
    what = ask.sparkSession.sparkContext.broadcast((rows, trial))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"model": [], "value": [], "move": pd.Series([], dtype=object)})
        rows, trial = what.value
        pairs = by_pair(right, plan.width)
        kept: dict[tuple, tuple] = {}
        out = []
        for model, sums in zip(left["model"], left["sums"]):
            r = rows[model]
            v = variants[r["variant"]]
            own = [r["cohort"]] if r["alone"] else TARGETS[r["target"]][0]
            key = (r["variant"], r["fold"], r["cohort"] if r["alone"] else None)
            if key not in kept:
                past = [(e, c, m) for (e, c), m in pairs.items() if e < r["fold"]]
                mine = [(e, m) for e, c, m in past if c in own]
                if r["alone"] and sum(m[0, 0] for _, m in mine) < MIN_COHORT:
                    mine = [(e, m) for e, c, m in past]
                g = sum((0.5 ** ((r["fold"] - 1 - e) / RECENCY_HALF_LIFE) if v.recency else 1.0) * m for e, m in mine)
                s = Scaled(g[: plan.width, : plan.width], columns_of(plan, v))
                kept[key] = s, s.inverse()
            s, inverse = kept[key]
            scale = s.n * max(r["train_mean"], 1e-9)
            g = np.array(sums[1:])
            slopes = (g[s.use] - g[0] * s.mean) / s.spread + RIDGE * scale * trial[model][s.use] * s.spread
            value = float(sums[0] + 0.5 * RIDGE * scale * ((trial[model][s.use] * s.spread) ** 2).sum())
            out.append((model, value, s.raw(g[0] / scale, inverse @ slopes / scale, plan.width).tolist()))
        return pd.DataFrame(out, columns=["model", "value", "move"])

    return ask.groupBy("target").cogroup(of_targets(stats, plan).groupBy("target")).applyInPandas(run, "model int, value double, move array<double>")


def lookup(models: DataFrame, plan: Plan) -> DataFrame:
    """variant, fold, cohort, models: an array with a model (coef, link, train_mean, n_train) or null for each target of the plan."""
    m = F.map_from_entries(F.collect_list(F.struct("target", F.struct("coef", "link", "train_mean", "n_train"))))
    return models.groupBy("variant", "fold", "cohort").agg(m.alias("m")).select(
        "variant", "fold", "cohort", F.array(*[F.col("m")[t] for t in plan.targets]).alias("models")
    )


class Scorer:
    """Models of one variant and fold by cohort: predictions, training means and counts of a block of rows."""

    def __init__(self, by_cohort: dict, plan: Plan):
        self.plan, self.by = plan, {}
        for cohort, models in by_cohort.items():
            use = [k for k, m in enumerate(models) if m is not None and m["coef"] is not None]
            w = np.array([models[k]["coef"] for k in use]).T
            link = np.array([models[k]["link"] == "log" for k in use], bool)
            top = np.log(np.maximum([models[k]["train_mean"] for k in use], 1e-9)) + SPAN
            self.by[cohort] = use, w, link, top, models

    def predicted(self, cohort: str | None, r: Reduced) -> np.ndarray:
        """Non-negative predictions of all targets, a column each; NaN without a model."""
        p = np.full((len(r.z), len(self.plan.targets)), np.nan)
        use, w, link, top, _ = self.by.get(cohort, ([], None, None, None, None))
        if use:
            eta = r.z @ r.fold(w)
            with np.errstate(over="ignore"):
                p[:, use] = np.where(link, np.exp(np.maximum(-30.0, np.fmin(eta, top))), np.maximum(eta, 0.0))
        return p

    def trait(self, cohort: str | None, name: str) -> list:
        """Of each target's model: train_mean or n_train, None without a model."""
        models = self.by[cohort][-1] if cohort in self.by else [None] * len(self.plan.targets)
        return [m[name] if m is not None else None for m in models]


def scorers(models: DataFrame, plan: Plan) -> dict:
    """{variant: {fold: Scorer}}: targets x folds x cohorts x variants models reach the driver and travel with the job."""
    found: dict = {}
    for r in lookup(models, plan).collect():
        found.setdefault(r["variant"], {}).setdefault(r["fold"], {})[r["cohort"]] = r["models"]
    plain = lambda ms: [m.asDict() if m is not None else None for m in ms]
    return {v: {f: Scorer({c: plain(m) for c, m in by.items()}, plan) for f, by in folds.items()} for v, folds in found.items()}


def newest_before(folds: dict, era: int):
    """The scorer of the era's own fold, or the newest before it."""
    known = [f for f in folds if f <= era]
    return folds[max(known)] if known else None
