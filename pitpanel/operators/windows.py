"""Strictly-prior windows and 'latest' resolution (the current row never contributes)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitpanel.operators.ordered import Spec, prior, quantiles, sized
from pitpanel.roles import Roles
from pitpanel.session import materialise, small_side


def history(df: DataFrame, roles: Roles, specs: list[Spec], keys=None, hot_rows=None) -> DataFrame:
    """Any mix of prior windows over one key, in a single pass."""
    return prior(df, keys or [roles.entity], roles.order, roles.clock, specs, hot_rows)


def prior_mean(df, roles, column, out, keys=None, hot_rows=None):
    """Mean over all earlier rows; a null value counts as 0; null on the first row."""
    return history(df, roles, [Spec(out, "mean", column)], keys, hot_rows)


def prior_mean_present(df, roles, column, out, keys=None, hot_rows=None):
    """Mean over earlier rows that carry a value."""
    return history(df, roles, [Spec(out, "mean_present", column)], keys, hot_rows)


def prior_sum_and_count(df, roles, column, out_sum, out_count, keys=None, hot_rows=None):
    """Sum and row count over earlier rows; 0.0 and 0 on the first row."""
    specs = [Spec(out_sum, "sum", column), Spec(out_count, "count")]
    return history(df, roles, specs, keys, hot_rows)


def prior_rolling_mean(df, roles, column, width, out, keys=None, hot_rows=None):
    """Mean over the last ``width`` earlier rows (rows, not calendar periods)."""
    return history(df, roles, [Spec(out, "rolling", column, width)], keys, hot_rows)


def era_to_date_mean(df, roles, column, out, hot_rows=None):
    """Prior mean inside the current era."""
    return history(df, roles, [Spec(out, "mean", column, within=(roles.era,))], None, hot_rows)


def prior_ordinals(df, roles, out="games_prior", out_era="games_prior_era", hot_rows=None):
    """Earlier rows in the career and in the current era."""
    specs = [Spec(out, "count"), Spec(out_era, "count", within=(roles.era,))]
    return history(df, roles, specs, None, hot_rows)


def era_means(df: DataFrame, by: list[str], era: str, columns: list[str]) -> DataFrame:
    """Mean per (by, era); nulls skipped."""
    return df.groupBy(*by, era).agg(*[F.avg(c).alias(c) for c in columns])


def expanding_era_prior(df, by, era, columns, prefix="prior_") -> DataFrame:
    """Per (by, era): mean of the era means of strictly earlier eras, unweighted by rows.

    Aggregates to (by, era) first, so the window sees one row per era however many rows a
    cohort holds.
    """
    w = Window.partitionBy(*by).orderBy(era).rowsBetween(Window.unboundedPreceding, -1)
    means = era_means(df, by, era, columns)
    return means.select(*by, era, *[F.avg(c).over(w).alias(prefix + c) for c in columns])


def with_partition_mean(df, by, column, out) -> DataFrame:
    """Whole-partition mean as aggregate plus join: no task ever holds a partition."""
    means = df.groupBy(*by).agg(F.avg(column).alias(out))
    return df.join(small_side(means), by, "left")


def deduped_group_history(df, roles, measures, means, rolling, hot_rows=None) -> DataFrame:
    """History of a group over its own periods, independent of how many entities it fields.

    Rows are reduced to one per (event, group) before the windows run.
    ``means`` and ``rolling`` map output name to (column[, width]).
    """
    one = df.groupBy(roles.event, roles.group).agg(
        *[F.first(c).alias(c) for c in [roles.era, roles.period]],
        *[F.max(c).alias(c) for c in measures],
    )
    specs = [Spec(o, "mean", c) for o, c in means.items()]
    specs += [Spec(o, "rolling", c, w) for o, (c, w) in rolling.items()]
    return prior(one, [roles.group], roles.order, roles.clock, specs, hot_rows)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order``; an aggregate, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    )
    return best.select(*keys, "__best.*").select(*df.columns)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Earliest row per key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__best")
    )
    return best.select(*keys, "__best.*").select(*df.columns)


def rows_at_latest(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Every row carrying the newest stamp of its key."""
    newest = df.groupBy(*keys).agg(F.max(stamp).alias(stamp))
    return df.join(small_side(newest), [*keys, stamp], "left_semi")


def latest_before(df, keys, stamp, deadline, tie) -> DataFrame:
    """Newest row taken strictly before the deadline, per key."""
    return latest(df.where(F.col(stamp) < F.col(deadline)), keys, [stamp, *tie])


def collapse_ladder(df, keys, alternate: Column, arrival: list[str]) -> DataFrame:
    """One row per key: the standard one before alternates, the newest arrival among equals."""
    tagged = df.withColumn("__std", (~alternate).cast("int"))
    return latest(tagged, keys, ["__std", *arrival]).drop("__std")


def current_era(games: DataFrame, era: str, kickoff: str, now: Column, lead_days: int = 45) -> DataFrame:
    """Latest era whose first kickoff is at most ``lead_days`` ahead, else the earliest era."""
    firsts = games.groupBy(era).agg(F.min(kickoff).alias("__first"))
    near = F.col("__first") <= now + F.make_interval(days=F.lit(lead_days))
    return firsts.agg(
        F.coalesce(F.max(F.when(near, F.col(era))), F.min(era)).alias("current_era")
    )


def current_period(games: DataFrame, period: str, kickoff: str, now: Column) -> DataFrame:
    """First period with a kickoff still to come, else the last one."""
    ahead = F.when(F.col(kickoff) >= now, F.col(period))
    return games.agg(F.coalesce(F.min(ahead), F.max(period)).alias("current_period"))


def value_cells(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, __x, how many rows (__m), how many with y (__ny) and their sum of y (__sy): one row per distinct x, as a written table."""
    cells = df.groupBy(*keys, F.col(x).alias("__x")).agg(*_cell(F.col(y)))
    return materialise(cells, "cells")


def _cell(y: Column) -> list[Column]:
    return [F.count(F.lit(1)).cast("double").alias("__m"), F.count(y).alias("__ny"), F.sum(y.cast("double")).alias("__sy")]


def _among(df: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """Rows of df that agree with a row of `few` (nulls agree), with its other columns; `few` is bounded and broadcast."""
    side = F.broadcast(few.withColumnsRenamed({c: f"__f_{c}" for c in by}))
    same = [F.col(c).eqNullSafe(F.col(f"__f_{c}")) for c in by]
    return df.join(side, reduce(Column.__and__, same)).drop(*[f"__f_{c}" for c in by])


def equal_count_bins(
    df, keys, x, y, tie, min_rows=60, max_bins=50, min_bins=5, hot_rows=None, cells=None
) -> DataFrame:
    """Order by x, cut into equal-count bins, keep mean x and mean y of each full bin.

    n_bins = n // min_rows held in [min_bins, max_bins]; edge i is floor(i * n / n_bins).
    Rows are counted by distinct x, and the counts accumulated: a value between two edges goes to its bin as a whole. Only
    the rows of a value that an edge cuts, fewer than max_bins values a key, are counted by the first tie column as well, those
    of a tie that is cut by the next one. ``cells``: value_cells of df, where they are known.
    """
    cells = value_cells(df, keys, x, y) if cells is None else cells
    totals = cells.groupBy(*keys).agg(F.sum("__m").cast("long").alias("__n"))
    bins = F.greatest(F.lit(min_bins), F.least(F.lit(max_bins), F.floor(F.col("__n") / min_rows))).cast("bigint")
    # Largest b with floor(b * n / bins) <= r; integer arithmetic gives ((r + 1) * bins - 1) // n.
    tagged = {"__first": F.expr("(CAST(__lo + 1 AS BIGINT) * __bins - 1) DIV __n"), "bin": F.expr("(CAST(__lo + __m AS BIGINT) * __bins - 1) DIV __n")}
    found = prior(cells, keys, ["__x"], F.col("__x"), [Spec("__lo", "sum", "__m")], hot_rows)
    found = found.join(small_side(totals), keys).withColumn("__bins", bins).withColumns(tagged)
    whole = [*keys, "bin", "__x", "__m", "__ny", "__sy"]
    parts, level = [found.where("__first = bin").select(*whole)], [*keys, "__x"]
    state = ["__lo", "__n", "__bins"]
    cut = materialise(found.where("__first < bin").select(*level, *state), "cut")
    if not cut.isEmpty():
        ties = [f"__t{i}" for i in range(len(tie))]
        rows = df.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"), *[F.col(t).alias(n) for t, n in zip(tie, ties)])
        rows = materialise(_among(rows, cut.select(*level), level), "cut-rows")
        for t in ties:
            inner = _among(rows, cut.withColumnRenamed("__lo", "__base"), level).groupBy(*level, t, "__base", "__n", "__bins").agg(*_cell(F.col("__y")))
            clock = F.lit(0.0) if dict(rows.dtypes)[t] in ("string", "binary") else F.col(t)
            inner = prior(materialise(inner, "cells"), level, [t], clock, [Spec("__lo", "sum", "__m")], hot_rows)
            inner = inner.withColumn("__lo", F.col("__lo") + F.col("__base")).withColumns(tagged)
            parts.append(inner.where("__first = bin").select(*whole))
            level = [*level, t]
            cut = materialise(inner.where("__first < bin").select(*level, *state), "cut")
            if cut.isEmpty():
                break
        else:  # rows that tie on everything: any order is as good as another
            w = Window.partitionBy(*level).orderBy(F.monotonically_increasing_id())
            one = _among(rows, cut, level).withColumn("__m", F.lit(1.0)).withColumn("__lo", F.col("__lo") + F.row_number().over(w) - 1).withColumns(tagged)
            parts.append(one.select(*keys, "bin", "__x", "__m", F.col("__y").isNotNull().cast("long").alias("__ny"), F.col("__y").cast("double").alias("__sy")))
    weight = F.sum(F.when(F.col("__x").isNotNull(), F.col("__m")))
    mean = F.when(F.min("__x") == F.max("__x"), F.min("__x").cast("double")).otherwise(F.sum(F.col("__x") * F.col("__m")) / weight)
    return (
        reduce(DataFrame.union, parts)
        .groupBy(*keys, "bin")
        .agg(F.sum("__m").cast("long").alias("n"), mean.alias("mean_x"), (F.sum("__sy") / F.nullif(F.sum("__ny"), F.lit(0))).alias("mean_y"))
        .where(F.col("n") >= min_rows)
    )


def quantile_bins(df, keys, x, bins=10, hot_rows=None) -> DataFrame:
    """Assign right-closed quantile bins with duplicate edges dropped; lowest value included.

    Returns df plus bin (0-based), lo and hi.
    """
    if not keys:
        one = df.withColumn("__all", F.lit(1))
        return quantile_bins(one, ["__all"], x, bins, hot_rows).drop("__all")
    probs = [i / bins for i in range(bins + 1)]
    edges = quantiles(df, keys, x, probs, "__edges", hot_rows).select(
        *keys, F.array_distinct("__edges").alias("__edges")
    )
    edges = materialise(edges, "edges")
    return in_bins(df.join(sized(edges, edges.count()), keys), x)


def in_bins(tagged: DataFrame, x: str) -> DataFrame:
    """Rows with sorted distinct __edges instead with bin (0-based), lo and hi of the right-closed bin of x."""
    pos = f"greatest(size(filter(__edges, e -> e < {x})), 1)"
    return (
        tagged.where(F.size("__edges") > 1)
        .withColumn("bin", F.expr(f"CAST({pos} - 1 AS BIGINT)"))
        .withColumn("lo", F.expr(f"element_at(__edges, {pos})"))
        .withColumn("hi", F.expr(f"element_at(__edges, {pos} + 1)"))
        .drop("__edges")
    )
