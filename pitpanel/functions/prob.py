"""Interpolation, level maps, tail probabilities and intervals. Row-local expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the probability layer.
MIN_PRED = 0.25
FLOOR, CEIL = 0.01, 0.99
SHRINK = 0.10
MAX_COUNT_THRESHOLD = 100
WILSON_Z = 1.96
RECENCY_HALF_LIFE = 3.0


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False))


def finite_number(text: Column) -> Column:
    """Text to a finite double, null otherwise."""
    x = text.try_cast("double")
    return F.when(finite(x), x)


def knots_below(x: Column, xs: Column) -> Column:
    """How many knots lie at or below x."""
    return F.size(F.filter(xs, lambda v: v <= x))


def interp(x: Column, xs: Column, ys: Column, left: Column, right: Column, k: Column | None = None) -> Column:
    """Piecewise linear value at x over sorted knots; repeated knots use the last one at or below x.

    ``k``: knots_below(x, xs), where it is known; else every use of it walks over the knots again.
    """
    n = F.size(xs)
    k = knots_below(x, xs) if k is None else k
    x0, y0 = F.try_element_at(xs, k), F.try_element_at(ys, k)
    x1, y1 = F.try_element_at(xs, k + 1), F.try_element_at(ys, k + 1)
    inside = y0 + (y1 - y0) / (x1 - x0) * (x - x0)
    return (
        F.when(x.isNull() | (n == 0) | (n != F.size(ys)), F.lit(None).cast("double"))
        .when(k == 0, left)
        .when(k < n, F.when(x == x0, y0).otherwise(inside))
        .when(x > F.element_at(xs, -1), right)
        .otherwise(F.element_at(ys, -1))
    )


def apply_level(pred: Column, grid: Column, mapped: Column) -> Column:
    """Level map: interpolate, carry the top ratio beyond the grid, never below 0; no map, no change."""
    lo, hi = F.try_element_at(mapped, F.lit(1)), F.try_element_at(mapped, F.lit(-1))
    top = F.try_element_at(grid, F.lit(-1))
    on_grid = interp(pred, grid, mapped, lo, hi)
    out = F.when((top > 0) & (pred > top), pred * (hi / top)).otherwise(on_grid)
    usable = F.coalesce((F.size(grid) > 0) & (F.size(grid) == F.size(mapped)), F.lit(False))
    return F.when(usable, F.when(pred.isNotNull(), F.greatest(out, F.lit(0.0)))).otherwise(pred)


def prob_over(pred: Column, line: Column, quantiles: Column, q_grid: Column, k: Column | None = None) -> Column:
    """P(actual > line) from the ratio distribution, shrunk towards .5 and clamped; ``k`` as in interp, of line / pred."""
    cdf = interp(line / pred, quantiles, q_grid, F.lit(0.0), F.lit(1.0), k)
    p = F.lit(0.5) + ((F.lit(1.0) - cdf) - F.lit(0.5)) * F.lit(1.0 - SHRINK)
    ok = finite(pred) & finite(line) & (pred >= MIN_PRED)
    return F.when(ok & cdf.isNotNull(), F.least(F.lit(CEIL), F.greatest(F.lit(FLOOR), p)))


def median_ratio(quantiles: Column, q_grid: Column) -> Column:
    return interp(
        F.lit(0.5), q_grid, quantiles, F.element_at(quantiles, 1), F.element_at(quantiles, -1)
    )


def median_projection(pred: Column, quantiles: Column, q_grid: Column) -> Column:
    """Projection times the median ratio."""
    return times_ratio(pred, median_ratio(quantiles, q_grid))


def times_ratio(pred: Column, ratio: Column) -> Column:
    ok = finite(pred) & (pred >= MIN_PRED)
    return F.when(ok & ratio.isNotNull(), F.greatest(F.lit(0.0), pred * ratio))


def threshold_for_line(line: Column) -> Column:
    """Smallest count above the line."""
    return F.floor(line) + 1


def poisson_at_least(lam: Column, k: Column) -> Column:
    """P(X >= k) for a Poisson count; k is bounded so the series length is."""
    start = F.exp(-lam)
    upto = F.greatest(F.least(k, F.lit(MAX_COUNT_THRESHOLD)) - 1, F.lit(1)).cast("int")
    series = F.aggregate(
        F.sequence(F.lit(1), upto),
        F.struct(start.alias("term"), start.alias("cum")),
        lambda acc, i: F.struct(
            (acc["term"] * (lam / i)).alias("term"), (acc["cum"] + acc["term"] * (lam / i)).alias("cum")
        ),
        lambda acc: acc["cum"],
    )
    below = F.when(k == 1, start).otherwise(series)
    tail = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - below))
    return (
        F.when(~finite(lam) | (lam < 0) | k.isNull(), F.lit(None).cast("double"))
        .when(k <= 0, F.lit(1.0))
        .when(k > MAX_COUNT_THRESHOLD, F.lit(0.0))
        .otherwise(tail)
    )


def wilson(hits: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper bound of a hit rate; null without trials."""
    p = hits / F.nullif(n, F.lit(0))
    d = F.lit(1.0) + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / d
    some = n > 0
    return (
        F.when(some, F.greatest(F.lit(0.0), centre - half)),
        F.when(some, F.least(F.lit(1.0), centre + half)),
    )


def posterior(num: Column, den: Column, prior: Column, k: float) -> Column:
    """(num + k * prior) / (den + k), missing evidence counting as none."""
    zero = F.lit(0.0)
    return (F.coalesce(num, zero) + F.lit(k) * prior) / (F.coalesce(den, zero) + F.lit(k))


def recency_weight(age: Column, half_life: float = RECENCY_HALF_LIFE) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(half_life))


def proxy_line(mean: Column, pred: Column, min_gap: float = 0.05) -> Column:
    """Half-point line from a running mean; null unless positive and far enough from the projection."""
    line = F.floor(mean) + F.lit(0.5)
    return F.when((line > 0) & (F.abs(pred - line) >= min_gap * line), line)


def break_even(payout: Column, legs: Column) -> Column:
    """Hit rate per leg at which a slip pays for itself."""
    return F.pow(F.lit(1.0) / payout, F.lit(1.0) / legs)
