"""Availability, level and probability calibration, and the checks on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pitpanel.functions.prob import posterior
from pitpanel.operators.aggregates import ratio
from pitpanel.operators.ordered import quantiles_of_counts, sized
from pitpanel.operators.windows import equal_count_bins, in_bins, value_cells
from pitpanel.session import constant_table, materialise

# Fixed values of the calibration layer.
CELL_K = 25.0
MAX_RANK = 6
STATUS_FLOOR = {"Out": 0.02, "Doubtful": 0.10, "Questionable": 0.0}
DEFAULT_MULTIPLIER = {"Out": 0.02, "Doubtful": 0.10, "Questionable": 0.78}
MIN_STATUS_ROWS = 20
GRID_POINTS = 200
MIN_LEVEL_BINS = 5
LEVEL_ROWS = 60
LEVEL_BINS = (5, 50)
RATIO_BINS = 10
MIN_BIN_ROWS = 50
RATIO_PROBS = [round(0.005 * i, 3) for i in range(1, 200)]
RELIABILITY_EDGES = [0.0, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 1.0]
MIN_RELIABILITY_ROWS = 30


class GateError(ValueError):
    """A quality gate refused the artifact; nothing was written."""


def _cells(obs: DataFrame, out: str) -> DataFrame:
    """Cell rates shrunk to their cohort's rate."""
    hit = F.col("appeared").cast("double")
    cohort = obs.groupBy("position").agg(F.avg(hit).alias("prior"))
    cells = obs.groupBy("position", "rank_capped").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("raw")
    )
    return cells.join(cohort, "position").withColumn(
        out, posterior(F.col("hits"), F.col("n").cast("double"), F.col("prior"), CELL_K)
    )


def availability_grid(obs: DataFrame) -> DataFrame:
    """obs: position, rank_capped, report_status, appeared. Healthy and marginal rates per cell."""
    healthy = _cells(obs.where(F.col("report_status").isNull()), "p_play")
    every = _cells(obs, "p_play_any").select("position", "rank_capped", "p_play_any")
    return healthy.join(every, ["position", "rank_capped"], "left").select(
        "position", "rank_capped", "n", "raw", "prior", "p_play",
        F.coalesce("p_play_any", "p_play").alias("p_play_any"),
    )


def status_multipliers(obs: DataFrame) -> DataFrame:
    """Appearance rate of each status over the mean healthy rate of the same cells.

    Too few rows, or no healthy rate, gives the floor.
    """
    base = obs.where(F.col("report_status").isNull()).groupBy("position", "rank_capped").agg(
        F.avg(F.col("appeared").cast("double")).alias("base")
    )
    spark = obs.sparkSession
    floors = constant_table(
        spark, [{"report_status": k, "floor": v} for k, v in STATUS_FLOOR.items()], "report_status:string,floor:double"
    )
    seen = obs.join(F.broadcast(base), ["position", "rank_capped"]).where(F.col("report_status").isin(list(STATUS_FLOOR)))
    m = seen.groupBy("report_status").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("appeared").cast("double")).alias("rate"), F.avg("base").alias("base")
    )
    j = F.broadcast(floors).join(m, "report_status", "left")
    n = F.coalesce("n", F.lit(0))
    measured = F.when((n >= MIN_STATUS_ROWS) & (F.col("base") > 0), F.col("rate") / F.col("base"))
    return j.select(
        "report_status", n.alias("n"), F.round(measured, 4).alias("measured"),
        F.round(F.greatest(F.coalesce(measured, F.col("floor")), F.col("floor")), 4).alias("multiplier"),
        F.when(measured.isNull(), "floor (too few observations)").when(measured > F.col("floor"), "measured").otherwise("floor").alias("source"),
    )


def apply_availability(df: DataFrame, grid: DataFrame | None, multipliers: DataFrame, filed: DataFrame | None = None) -> DataFrame:
    """Probability of appearing: the healthy rate times the status factor once a group has filed
    its report, the marginal rate before that; 1.0 without a grid.

    ``filed``: groups (team) whose report is in hand; by default those with a designated row.
    """
    if grid is None:
        return df.withColumn("p_play", F.lit(1.0))
    cohort = "chart_position" if "chart_position" in df.columns else "position"
    status = F.col("report_status")
    teams = (filed or df.where(status.isNotNull())).select("team").where("team IS NOT NULL").distinct().withColumn("__f", F.lit(True))
    rank = F.least(F.coalesce(F.col("depth_rank").cast("double"), F.lit(float(MAX_RANK))), F.lit(float(MAX_RANK)))
    cells = grid.select(
        F.col("position").alias("__pos"), F.col("rank_capped").cast("int").alias("__rank"),
        F.col("p_play").alias("__h"), F.col("p_play_any").alias("__a"),
    )
    mult = multipliers.select("report_status", F.col("multiplier").alias("__m"))
    # Cells are cohorts by ranks and statuses are named above; the groups are counted.
    teams = materialise(teams, "filed")
    j = (
        df.withColumn("__pos", F.col(cohort))
        .withColumn("__rank", rank.cast("int"))
        .join(F.broadcast(cells), ["__pos", "__rank"], "left")
        .join(sized(teams, teams.count()), "team", "left")
        .join(F.broadcast(mult), "report_status", "left")
    )
    in_hand = F.coalesce("__f", F.lit(False)) | status.isNotNull()
    p = F.when(in_hand, F.coalesce("__h", F.lit(0.5)) * F.coalesce("__m", F.lit(1.0))).otherwise(
        F.coalesce("__a", F.lit(0.5))
    )
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    return j.select(*df.columns, clipped.alias("p_play"))


def sum_gate(scored: DataFrame, keys: list[str], p="p_play", appeared="appeared", tolerance=0.05) -> float:
    """Expected over observed appearances per (group, period); raises outside the tolerance."""
    per = scored.groupBy(*keys).agg(F.sum(p).alias("p"), F.sum(F.col(appeared).cast("double")).alias("a"))
    r = per.agg(ratio(F.avg("p"), F.avg("a")).alias("r")).first()["r"]
    if r is None or abs(r - 1.0) > tolerance:
        raise GateError(f"expected over observed appearances is {r}, outside {tolerance:.0%}")
    return r


def _linspace(lo: Column, hi: Column, n: int) -> Column:
    step = (hi - lo) / F.lit(float(n - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.when(i == n - 1, hi).otherwise(lo + i.cast("double") * step),
    )


def isotonic(ys: Column, ws: Column) -> Column:
    """Weighted least-squares non-decreasing fit of an array, by the max-min formula.

    Value i is the largest over j <= i of the smallest over k >= i of the weighted mean of j .. k. The work grows with the
    cube of the length, so this is for a bounded number of bins.
    """
    total = lambda i, j, f: F.aggregate(F.slice(f, i, j - i + 1), F.lit(0.0), lambda a, b: a + b)
    wy = F.zip_with(ys, ws, lambda y, w: y * w)
    n = F.size(ys)
    # One row of means per start j; each is turned into running minima from the right, then the rows' maxima are taken.
    def minima(j):
        means = F.transform(F.sequence(j, n), lambda k: total(j, k, wy) / total(j, k, ws))
        back = F.aggregate(
            F.reverse(means), F.expr("cast(array() as array<double>)"),
            lambda acc, m: F.concat(F.array(F.least(m, F.coalesce(F.try_element_at(acc, F.lit(1)), m))), acc),
        )
        return F.concat(F.array_repeat(F.lit(float("-inf")), j - 1), back)

    rows = F.transform(F.sequence(F.lit(1), n), minima)
    return F.aggregate(rows, F.array_repeat(F.lit(float("-inf")), n), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))


def level_maps(scored: DataFrame, target="target", pred="pred", actual="actual", tie=("game_id", "gsis_id"), hot_rows=None) -> DataFrame:
    """Monotone map per target on a 200-point grid from the smallest prediction to the 99th percentile.

    Binning and fit run as grouped expressions, with at most 50 bins per target in a row. Bins of one mean prediction are one
    point with their rows as weight. A target with fewer than five full bins keeps its row, with the reason and no map.
    """
    cells = value_cells(scored, [target], pred, actual)
    bins = equal_count_bins(scored, [target], pred, actual, list(tie), hot_rows=hot_rows, cells=cells)
    values = cells.where("__x IS NOT NULL").select(target, F.col("__x").cast("double").alias("__v"), "__m")
    return _fitted(bins, quantiles_of_counts(values, [target], [0.0, 0.99], "__q", hot_rows), target)


def _fitted(bins: DataFrame, ends: DataFrame, target: str) -> DataFrame:
    """Maps from the means of full bins (mean_x, mean_y) and from n and __q, the smallest prediction and the 99th percentile."""
    from pitpanel.functions.prob import interp

    points = bins.groupBy(target, "mean_x").agg(F.count(F.lit(1)).alias("__k"), F.avg("mean_y").alias("__y"))
    fits = points.groupBy(target).agg(
        F.sort_array(F.collect_list(F.struct(F.col("mean_x").alias("x"), F.col("__y").alias("y"), F.col("__k").cast("double").alias("w")))).alias("__p"),
        F.sum("__k").alias("__bins"),
    )
    rows = ends.select(target, F.col("n"), "__q").join(fits, target, "left")
    enough = F.coalesce(F.col("__bins") >= MIN_LEVEL_BINS, F.lit(False))
    part = lambda c: F.transform("__p", lambda s: s[c])
    knots = rows.select(
        target, "n", F.when(~enough, F.concat(F.coalesce("__bins", F.lit(0)).cast("string"), F.lit(f" full bins, {MIN_LEVEL_BINS} needed"))).alias("reason"),
        F.when(enough, _linspace(F.col("__q")[0], F.col("__q")[1], GRID_POINTS)).alias("grid"), F.when(enough, part("x")).alias("__xs"), F.when(enough, isotonic(part("y"), part("w"))).alias("__ys"),
    )
    # The fit is read twice for each of the grid's points, so it must not be copied into that expression.
    known = knots.select(target, "n", "reason", F.inline(F.array(F.struct("grid", "__xs", "__ys"))))
    return known.select(
        target, "n", "grid",
        F.when(F.col("grid").isNotNull(), F.transform(
            "grid",
            lambda g: F.greatest(
                F.lit(0.0),
                interp(g, F.col("__xs"), F.col("__ys"), F.element_at("__ys", 1), F.element_at("__ys", -1)),
            ),
        )).alias("mapped"),
        "reason",
    )


def ratio_table(scored: DataFrame, target="target", pred="pred", actual="actual", bins=RATIO_BINS, probs=None, min_pred=0.25, min_rows=MIN_BIN_ROWS, hot_rows=None) -> DataFrame:
    """Quantiles of actual / predicted per prediction bin: target, bin, lo, hi, n, means, quantiles, q_grid."""
    probs = probs or RATIO_PROBS
    kept = scored.where(F.col(pred) >= min_pred).where(F.col(actual).isNotNull())
    # Pairs of values with how often each occurs: all that follows reads them, so the rows are read once.
    pairs = kept.groupBy(target, F.col(pred).cast("double").alias("__p"), F.col(actual).alias("__y")).agg(F.count(F.lit(1)).cast("double").alias("__m"))
    pairs = materialise(pairs, "pairs")
    values = pairs.groupBy(target, F.col("__p").alias("__v")).agg(F.sum("__m").alias("__m"))
    edges = quantiles_of_counts(values, [target], [i / bins for i in range(bins + 1)], "__edges", hot_rows)
    edges = materialise(edges.select(target, F.array_distinct("__edges").alias("__edges")), "edges")
    b = in_bins(pairs.join(sized(edges, edges.count()), target), "__p").withColumn("__v", F.col("__y") / F.col("__p"))
    ratios = b.groupBy(target, "bin", "__v").agg(
        F.sum("__m").alias("__m"), F.min("lo").alias("__low"), F.max("hi").alias("__high"), F.sum(F.col("__p") * F.col("__m")).alias("__sp"),
        F.sum(F.col("__y") * F.col("__m")).alias("__sy"),
    )
    ratios = materialise(ratios, "ratios")
    q = quantiles_of_counts(ratios.select(target, "bin", "__v", "__m"), [target, "bin"], probs, "quantiles", hot_rows)
    m = ratios.groupBy(target, "bin").agg(
        F.min("__low").alias("lo"), F.max("__high").alias("hi"), (F.sum("__sp") / F.sum("__m")).alias("mean_pred"), (F.sum("__sy") / F.sum("__m")).alias("mean_actual")
    )
    return m.join(q, [target, "bin"]).where(F.col("n") >= min_rows).select(
        target, "bin", "lo", "hi", "n", "mean_pred", "mean_actual", "quantiles",
        F.array(*[F.lit(p) for p in probs]).alias("q_grid"),
    )


def reliability_curve(df: DataFrame, p: str, hit: str, keys: tuple[str, ...] = (), edges=None, min_rows=MIN_RELIABILITY_ROWS) -> DataFrame:
    """Claimed against observed rate per left-closed probability bin; thin bins are skipped."""
    edges = edges or RELIABILITY_EDGES
    n_at_or_below = sum(((F.col(p) >= e).cast("int") for e in edges[1:]), (F.col(p) >= edges[0]).cast("int"))
    arr = F.array(*[F.lit(e) for e in edges])
    b = df.where(F.col(p).isNotNull() & (F.col(p) >= edges[0]) & (F.col(p) < edges[-1])).withColumn("__b", n_at_or_below)
    return b.groupBy(*keys, "__b").agg(
        F.avg(p).alias("claimed"), F.avg(hit).alias("actual"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= min_rows).select(
        *keys, F.element_at(arr, F.col("__b")).alias("bin_lo"), F.element_at(arr, F.col("__b") + 1).alias("bin_hi"),
        "claimed", "actual", "n",
    )


def calibration_error(curve: DataFrame, total: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weighted gap between claim and outcome; ``total`` holds keys and all scored rows as rows_all."""
    g = curve.groupBy(*keys).agg(F.sum(F.col("n") * F.abs(F.col("claimed") - F.col("actual"))).alias("gap"))
    if keys:
        return g.join(total, list(keys)).select(*keys, (F.col("gap") / F.col("rows_all")).alias("ece"))
    one = F.lit(1).alias("__k")
    return g.select("gap", one).join(total.select("rows_all", one), "__k").select(
        (F.col("gap") / F.col("rows_all")).alias("ece")
    )


def side_picking(df: DataFrame, keys: list[str], lean_over: Column, actual_over: Column) -> DataFrame:
    """Accuracy of the lean minus that of always taking the more common side."""
    hit = (lean_over == actual_over).cast("double")
    over = F.avg(actual_over.cast("double"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.greatest(over, 1.0 - over).alias("common_side")
    ).withColumn("edge_pts", 100 * (F.col("accuracy") - F.col("common_side")))


def levelled(df: DataFrame, maps: DataFrame, key: str, pred: str) -> DataFrame:
    """df with pred through the level map of its key, as apply_level does it; rows of other keys go.

    A map is read by its knots: the last one at or below the value is found by bisection, for a batch of rows at once.
    """
    known = {r[key]: (r.grid, r.mapped) for r in maps.select(key, "grid", "mapped").collect()}  # one row per (target, era)
    shared = df.sparkSession.sparkContext.broadcast({k: (np.array(g), np.array(m)) if g else None for k, (g, m) in known.items()})
    at, typed = df.columns.index(pred), df.withColumn(pred, F.col(pred).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names = part.column(key).dictionary_encode()
            which = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
            value = part.column(pred).to_numpy(zero_copy_only=False).astype(float)
            there = part.column(pred).is_valid().to_numpy(zero_copy_only=False)
            out, kept = value.copy(), np.zeros(len(value), bool)
            for i, name in enumerate(names.dictionary.to_pylist()):
                if name not in shared.value:
                    continue
                mine = which == i
                kept |= mine
                if shared.value[name] is not None:
                    out[mine] = np.maximum(_on_map(value[mine], *shared.value[name]), 0.0)
            columns = part.columns
            columns[at] = pa.array(out, pa.float64(), mask=~there)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array(kept))

    return typed.mapInArrow(run, typed.schema)


def _on_map(x: np.ndarray, grid: np.ndarray, mapped: np.ndarray) -> np.ndarray:
    k = np.searchsorted(grid, x, "right")  # knots at or below x
    low, high = np.clip(k - 1, 0, len(grid) - 1), np.clip(k, 0, len(grid) - 1)
    x0, y0, x1, y1 = grid[low], mapped[low], grid[high], mapped[high]
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.where((x == x0) | (high == low), y0, y0 + (y1 - y0) / (x1 - x0) * (x - x0))
    out = np.where(k == 0, mapped[0], np.where(k == len(grid), mapped[-1], inside))
    return np.where(x > grid[-1], x * (mapped[-1] / grid[-1]), out) if grid[-1] > 0 else out


def cross_fitted(history: DataFrame, era="era", target="target", pred="pred", actual="actual", tie=("game_id", "gsis_id")) -> tuple[DataFrame, DataFrame]:
    """(level maps, ratio tables) per (target, era), each from the predictions of earlier eras alone.

    history: out-of-sample predictions with era, target, pred, actual. The table of an era is made of ratios to predictions
    that went through that era's own map, so nothing of the era or after it is in either. An era without rows before it has none.
    """
    from pitpanel.operators import ranked as rk

    kinds, spark = dict(history.dtypes), history.sparkSession
    rows = history.where(F.col(pred).isNotNull() & F.col(actual).isNotNull()).select(
        F.col(target).alias("target"), F.col(era).alias("era"), F.col(pred).cast("double").alias("x"), F.col(actual).cast("double").alias("y"), *[F.col(t).alias(f"__t{i}") for i, t in enumerate(tie)]
    )
    runs = rk.in_runs(rows, [f"__t{i}" for i in range(len(tie))])
    key = F.to_json(F.struct(F.col("target").alias("t"), F.col("era").alias("e"))).alias("__fold")
    bins, ends = runs.equal_bins([0.0, 0.99], LEVEL_ROWS, LEVEL_BINS)
    # One row per (target, era): a bounded table, worked out once and broadcast.
    maps = materialise(_fitted(bins.select(key, "mean_x", "mean_y"), ends.select(key, "n", F.col("q").alias("__q")), "__fold"), "maps")
    maps = maps.withColumn("__n", F.from_json("__fold", f"t string, e {kinds[era]}")).select(F.col("__n.t").alias("target"), F.col("__n.e").alias("era"), "n", "grid", "mapped", "reason")
    known = {(r.target, r.era): (r.grid, r.mapped) for r in maps.collect()}
    found = runs.ratio_quantiles({k: (np.array(g), np.maximum.accumulate(m)) for k, (g, m) in known.items() if g}, 0.25, RATIO_BINS, RATIO_PROBS)
    kept = [(*r, RATIO_PROBS) for r in found if r[5] >= MIN_BIN_ROWS]
    ratios = spark.createDataFrame(kept, f"target string, era {kinds[era]}, bin long, lo double, hi double, n long, mean_pred double, mean_actual double, quantiles array<double>, q_grid array<double>")
    name = lambda df: df.withColumnsRenamed({"target": target, "era": era})
    return name(maps), name(ratios)
