"""Calibration queries on the scored panel."""

from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.functions import prob as pr
from pitpanel.operators import calibrate as cp, models as ml
from pitpanel.queries import query
from pitpanel.queries.aggregates import SCORED, scored, scored_sql
from pitpanel.session import materialise

_PROBS = "[" + ", ".join(repr(p) for p in cp.RATIO_PROBS) + "]"

# Quantile bins of the prediction, then quantiles of actual / predicted per bin.
BINS = f""",
ck AS (SELECT target, pred, actual FROM scored WHERE pred >= 0.25),
ce AS (SELECT target, quantile_cont(pred, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS e0 FROM ck GROUP BY target),
cd AS (SELECT target, list_sort(list_distinct(e0)) AS e FROM ce),
cb AS (SELECT ck.*, CAST(greatest(len(list_filter(e, lambda v: v < pred)), 1) AS BIGINT) AS b, e FROM ck JOIN cd USING (target)),
cal AS (SELECT target, b - 1 AS bin, any_value(e[b]) AS lo, any_value(e[b + 1]) AS hi, count(*) AS n, avg(pred) AS mean_pred, avg(actual) AS mean_actual,
  quantile_cont(actual / pred, {_PROBS}) AS quantiles, {_PROBS} AS q_grid FROM cb GROUP BY target, b HAVING count(*) >= 50)"""
CALIBRATION = SCORED + BINS

#: Every modelled target that the panel has.
HELD = [t for t in ml.TARGETS if t in td.BOX]


def calibration(spark, sf, hot_rows=None):
    return cp.ratio_table(scored(spark, sf), hot_rows=hot_rows)


def calibration_of(spark, sf, targets):
    """Ratio quantiles of some modelled targets that the panel has."""
    return cp.ratio_table(scored(spark, sf, targets or HELD[:1]))


_CP5 = f"""WITH {CALIBRATION}
SELECT target, bin, n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean_pred, 5) AS mean_pred, round(mean_actual, 5) AS mean_actual, i, round(quantiles[i], 5) AS q
FROM cal, generate_series(1, 199) g(i)"""


def _ratio_rows(spark, sf, hot_rows=None):
    c = calibration(spark, sf, hot_rows)
    return c.select(
        "target", "bin", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("mean_pred", 5).alias("mean_pred"),
        F.round("mean_actual", 5).alias("mean_actual"), F.posexplode("quantiles").alias("j", "v"),
    ).select("target", "bin", "n", "lo", "hi", "mean_pred", "mean_actual", (F.col("j") + 1).cast("bigint").alias("i"), F.round("v", 5).alias("q"))


@query("ratio_quantile_table", "CP5", _CP5)
def _(spark, sf):
    return _ratio_rows(spark, sf)


@query("ratio_quantile_table_split_runs", "CP5", _CP5)
def _(spark, sf):
    """Edges and ratio quantiles from accumulated counts in runs of at most 1500 rows."""
    return _ratio_rows(spark, sf, 1500)


_STATUS = "CASE (week + gsis_id) % 5 WHEN 0 THEN 'Out' WHEN 1 THEN 'Questionable' WHEN 2 THEN 'Doubtful' END"
OBS = td.PANEL + f""",
obs AS (SELECT season, week, team, game_id, gsis_id, position, CAST(least(depth_rank, 6) AS INTEGER) AS rank_capped, depth_rank, {_STATUS} AS report_status, carries > 0 AS appeared
  FROM panel WHERE depth_rank IS NOT NULL)"""


def observed(spark, sf):
    return td.panel(spark, sf).where("depth_rank IS NOT NULL").select(
        "season", "week", "team", "game_id", "gsis_id", "position", F.least("depth_rank", F.lit(6.0)).cast("int").alias("rank_capped"),
        "depth_rank", F.expr(_STATUS).alias("report_status"), (F.col("carries") > 0).alias("appeared"),
    )


GRID = OBS + """,
hl AS (SELECT * FROM obs WHERE report_status IS NULL),
hp AS (SELECT position, avg(CASE WHEN appeared THEN 1.0E0 ELSE 0.0E0 END) AS prior FROM hl GROUP BY position),
ap AS (SELECT position, avg(CASE WHEN appeared THEN 1.0E0 ELSE 0.0E0 END) AS prior FROM obs GROUP BY position),
hc AS (SELECT position, rank_capped, count(*) AS n, sum(CASE WHEN appeared THEN 1.0E0 ELSE 0.0E0 END) AS h FROM hl GROUP BY 1, 2),
ac AS (SELECT position, rank_capped, count(*) AS n, sum(CASE WHEN appeared THEN 1.0E0 ELSE 0.0E0 END) AS h FROM obs GROUP BY 1, 2),
grid AS (SELECT hc.position, hc.rank_capped, hc.n, hc.h / hc.n AS raw, hp.prior, (hc.h + 25.0E0 * hp.prior) / (hc.n + 25.0E0) AS p_play,
  coalesce((ac.h + 25.0E0 * ap.prior) / (ac.n + 25.0E0), (hc.h + 25.0E0 * hp.prior) / (hc.n + 25.0E0)) AS p_play_any
 FROM hc JOIN hp USING (position) LEFT JOIN ac ON ac.position = hc.position AND ac.rank_capped = hc.rank_capped LEFT JOIN ap ON ap.position = hc.position),
mb AS (SELECT position, rank_capped, h / n AS base FROM hc),
ms AS (SELECT report_status, count(*) AS n, avg(CASE WHEN appeared THEN 1.0E0 ELSE 0.0E0 END) / avg(base) AS measured FROM obs JOIN mb USING (position, rank_capped) WHERE report_status IS NOT NULL GROUP BY report_status),
mult AS (SELECT report_status, n, round(measured, 4) AS measured, round(greatest(measured, f), 4) AS multiplier, CASE WHEN measured > f THEN 'measured' ELSE 'floor' END AS source
 FROM ms JOIN (VALUES ('Out', 0.02E0), ('Doubtful', 0.10E0), ('Questionable', 0.0E0)) v(report_status, f) USING (report_status))"""


@query("availability_grid", "CP1 SF14", f"WITH {GRID} SELECT position, rank_capped, n, raw, prior, p_play, p_play_any FROM grid")
def _(spark, sf):
    return cp.availability_grid(observed(spark, sf))


@query("status_multipliers", "CP2", f"WITH {GRID} SELECT * FROM mult")
def _(spark, sf):
    return cp.status_multipliers(observed(spark, sf))


_APPLY = GRID + """,
filed AS (SELECT DISTINCT team FROM obs WHERE report_status IS NOT NULL AND season = 1996),
ap2 AS (SELECT o.*, least(1, greatest(0, CASE WHEN f.team IS NOT NULL OR o.report_status IS NOT NULL THEN coalesce(g.p_play, 0.5) * coalesce(m.multiplier, 1.0) ELSE coalesce(g.p_play_any, 0.5) END)) AS p_play
 FROM obs o LEFT JOIN grid g ON g.position = o.position AND g.rank_capped = o.rank_capped LEFT JOIN filed f ON f.team = o.team LEFT JOIN mult m ON m.report_status = o.report_status)"""


def with_availability(spark, sf):
    """The observations are stored: the cells, the multipliers, the filed groups and the result all read them."""
    o = materialise(observed(spark, sf), "observed")
    filed = o.where("report_status IS NOT NULL AND season = 1996")
    grid = materialise(cp.availability_grid(o), "grid")
    return cp.apply_availability(o, grid, cp.status_multipliers(o), filed)


@query("apply_availability", "ML5 JN18", f"WITH {_APPLY} SELECT game_id, gsis_id, round(p_play, 8) AS p_play FROM ap2")
def _(spark, sf):
    return with_availability(spark, sf).select("game_id", "gsis_id", F.round("p_play", 8).alias("p_play"))


@query("availability_sum_gate", "CP3", f"""WITH {_APPLY}, per AS (SELECT season, week, team, sum(p_play) AS p, sum(CASE WHEN appeared THEN 1.0E0 ELSE 0.0E0 END) AS a FROM ap2 GROUP BY 1, 2, 3)
SELECT round(avg(p) / avg(a), 6) AS ratio, abs(avg(p) / avg(a) - 1) <= 0.05 AS passes FROM per""")
def _(spark, sf):
    per = with_availability(spark, sf).groupBy("season", "week", "team").agg(
        F.sum("p_play").alias("p"), F.sum(F.col("appeared").cast("double")).alias("a")
    )
    r = F.avg("p") / F.avg("a")
    return per.agg(F.round(r, 6).alias("ratio"), (F.abs(r - 1) <= 0.05).alias("passes"))


#: Bins as in equal_count_bins, the max-min formula over all pairs of bins, then the grid between its ends.
_LEVELS = scored_sql(HELD) + """,
lr AS (SELECT target, pred, actual, row_number() OVER (PARTITION BY target ORDER BY pred, game_id, gsis_id) AS rn, count(*) OVER (PARTITION BY target) AS n FROM scored WHERE pred IS NOT NULL),
lb AS (SELECT *, greatest(5, least(50, n // 60)) AS nb FROM lr),
li AS (SELECT target, (rn * nb - 1) // n AS bin, count(*) AS k, avg(pred) AS x, avg(actual) AS y FROM lb GROUP BY 1, 2 HAVING count(*) >= 60),
lx AS (SELECT target, x, avg(y) AS y, count(*) + 0.0E0 AS w FROM li GROUP BY 1, 2),
lp AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY x) AS i, sum(w) OVER (PARTITION BY target ORDER BY x) AS sw, sum(w * y) OVER (PARTITION BY target ORDER BY x) AS sy FROM lx),
lm AS (SELECT a.target, a.i AS j, b.i AS k, (b.sy - a.sy + a.w * a.y) / (b.sw - a.sw + a.w) AS m FROM lp a JOIN lp b ON a.target = b.target AND a.i <= b.i),
ln AS (SELECT target, j, k AS i, min(m) OVER (PARTITION BY target, j ORDER BY k DESC) AS m FROM lm),
lf AS (SELECT ln.target, ln.i, any_value(lp.x) AS x, max(ln.m) AS f FROM ln JOIN lp ON lp.target = ln.target AND lp.i = ln.i GROUP BY 1, 2),
la AS (SELECT target, list(x ORDER BY i) AS xs, list(f ORDER BY i) AS fs FROM lf GROUP BY target),
le AS (SELECT target, count(*) AS n, min(pred) AS lo, quantile_cont(pred, 0.99) AS hi FROM scored WHERE pred IS NOT NULL GROUP BY target),
lg AS (SELECT le.target, n, i, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199.0E0) END AS g, xs, fs FROM le JOIN la USING (target), generate_series(0, 199) q(i)
 WHERE (SELECT sum(w) FROM lx WHERE lx.target = le.target) >= 5),
lk AS (SELECT *, len(list_filter(xs, lambda v: v <= g)) AS k FROM lg)"""


@query("isotonic_level_maps", "CP4 SF16", f"""WITH {_LEVELS}
SELECT target, n, i, round(g, 6) AS grid, round(greatest(0, CASE WHEN k = 0 THEN fs[1] WHEN k = len(xs) THEN fs[k] ELSE fs[k] + (fs[k + 1] - fs[k]) / (xs[k + 1] - xs[k]) * (g - xs[k]) END), 5) AS mapped FROM lk""")
def _(spark, sf):
    """Monotone level map of every target."""
    m = cp.level_maps(scored(spark, sf, HELD).where("pred IS NOT NULL"))
    return m.select("target", "n", F.posexplode(F.arrays_zip("grid", "mapped")).alias("i", "p")).select(
        "target", "n", F.col("i").cast("long").alias("i"), F.round("p.grid", 6).alias("grid"), F.round("p.mapped", 5).alias("mapped")
    )


_PROXY = SCORED + """,
px AS (SELECT target, season, actual, pred, pred * 1.1E0 AS proj, floor(pred) + 0.5E0 AS line FROM scored WHERE pred IS NOT NULL),
py AS (SELECT *, abs((season * 7 + actual * 13) % 10) / 10.0E0 + 0.05E0 AS p FROM px WHERE line > 0 AND abs(proj - line) >= 0.05 * line)"""


def _proxy(spark, sf):
    s = scored(spark, sf).where("pred IS NOT NULL").withColumn("proj", F.col("pred") * 1.1)
    s = s.withColumn("line", pr.proxy_line(F.col("pred"), F.col("proj"))).where("line IS NOT NULL")
    return s.withColumn("p", F.expr("abs((season * 7 + actual * 13) % 10) / 10.0D + 0.05D"))


_EDGE_SQL = "(VALUES (0.0, 0.3), (0.3, 0.4), (0.4, 0.45), (0.45, 0.5), (0.5, 0.55), (0.55, 0.6), (0.6, 0.7), (0.7, 1.0)) v(bin_lo, bin_hi)"
_CURVE = _PROXY + f""",
curve AS (SELECT target, CAST(bin_lo AS DOUBLE) AS bin_lo, CAST(bin_hi AS DOUBLE) AS bin_hi, avg(p) AS claimed, avg(CASE WHEN actual > line THEN 1.0E0 ELSE 0.0E0 END) AS actual, count(*) AS n
 FROM py JOIN {_EDGE_SQL} ON p >= CAST(bin_lo AS DOUBLE) AND p < CAST(bin_hi AS DOUBLE) GROUP BY 1, 2, 3 HAVING count(*) >= 30)"""


@query("reliability_curve", "CP6 SF21", f"WITH {_CURVE} SELECT target, bin_lo, bin_hi, round(claimed, 6) AS claimed, round(actual, 6) AS actual, n FROM curve")
def _(spark, sf):
    s = _proxy(spark, sf).withColumn("hit", (F.col("actual") > F.col("line")).cast("double"))
    c = cp.reliability_curve(s, "p", "hit", ("target",))
    return c.withColumn("claimed", F.round("claimed", 6)).withColumn("actual", F.round("actual", 6))


@query("expected_calibration_error", "CP6", f"WITH {_CURVE}, t AS (SELECT target, count(*) AS n FROM py GROUP BY target) SELECT target, round(sum(c.n * abs(claimed - actual)) / any_value(t.n), 6) AS ece FROM curve c JOIN t USING (target) GROUP BY target")
def _(spark, sf):
    s = _proxy(spark, sf).withColumn("hit", (F.col("actual") > F.col("line")).cast("double"))
    totals = s.groupBy("target").agg(F.count(F.lit(1)).alias("rows_all"))
    e = cp.calibration_error(cp.reliability_curve(s, "p", "hit", ("target",)), totals, ("target",))
    return e.withColumn("ece", F.round("ece", 6))


@query("side_picking_accuracy", "CP7", f"""WITH {_PROXY}, a AS (SELECT target, count(*) AS n, avg(CASE WHEN (proj > line) = (actual > line) THEN 1.0E0 ELSE 0.0E0 END) AS acc, avg(CASE WHEN actual > line THEN 1.0E0 ELSE 0.0E0 END) AS o FROM py GROUP BY target)
SELECT target, n, round(acc, 8) AS accuracy, round(greatest(o, 1 - o), 8) AS common_side, round(100 * (acc - greatest(o, 1 - o)), 6) AS edge_pts FROM a""")
def _(spark, sf):
    r = cp.side_picking(_proxy(spark, sf), ["target"], F.col("proj") > F.col("line"), F.col("actual") > F.col("line"))
    return r.select("target", "n", F.round("accuracy", 8).alias("accuracy"), F.round("common_side", 8).alias("common_side"), F.round("edge_pts", 6).alias("edge_pts"))


_KNOTS = [round(0.05 * i, 2) for i in range(20)] + [0.99]


@query("level_map_apply", "SF16 SF15", f"""WITH {SCORED},
m AS (SELECT target, quantile_cont(pred, {_KNOTS}) AS g FROM scored WHERE pred IS NOT NULL GROUP BY target),
x AS (SELECT s.game_id, s.gsis_id, s.target, s.pred, g, list_transform(g, lambda v: v * 0.75E0 + 0.1E0) AS y, len(list_filter(g, lambda v: v <= s.pred)) AS k FROM scored s JOIN m USING (target) WHERE pred IS NOT NULL)
SELECT game_id, gsis_id, target, round(greatest(CASE WHEN pred > g[len(g)] THEN pred * (y[len(g)] / g[len(g)]) WHEN k = 0 THEN y[1] WHEN k = len(g) OR g[k] = pred THEN y[k]
  ELSE y[k] + (y[k + 1] - y[k]) / (g[k + 1] - g[k]) * (pred - g[k]) END, 0), 5) AS mapped FROM x""")
def _(spark, sf):
    """A stated map on quantile knots; values above the last knot carry its ratio."""
    from pitpanel.operators.ordered import quantiles_of_counts

    s = materialise(scored(spark, sf).where("pred IS NOT NULL").select("game_id", "gsis_id", "target", "pred"), "scored")
    counts = s.groupBy("target", F.col("pred").alias("__v")).agg(F.count(F.lit(1)).cast("double").alias("__m"))
    knots = quantiles_of_counts(materialise(counts, "counts"), ["target"], _KNOTS, "g").select("target", "g", F.transform("g", lambda v: v * 0.75 + 0.1).alias("y"))
    j = s.join(F.broadcast(knots), "target")  # a row per target
    return j.select("game_id", "gsis_id", "target", F.round(pr.apply_level(F.col("pred"), F.col("g"), F.col("y")), 5).alias("mapped"))
