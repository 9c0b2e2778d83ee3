"""Model protocol queries: baselines, gate, strata, verdict, estimands, walk-forward."""

from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.operators import additive as ad, aggregates as ag, calibrate as cp, models as ml
from pitpanel.operators.shape import rank_cap
from pitpanel.plans import blocks as fb, serving as sv
from pitpanel.queries import query, steady, steady_sql
from pitpanel.queries.blocks import FEATURES, _LITERAL
from pitpanel.session import materialise, scratch_path

_REC = "('WR', 'TE', 'RB')"


def feature_panel(spark, sf):
    return fb.entity_block(rank_cap(td.panel(spark, sf)), _LITERAL)


@query("baseline_serving", "ML3", f"""WITH {FEATURES}, m AS (SELECT sum(targets) / count(*) AS m FROM fh WHERE position IN {_REC})
SELECT game_id, gsis_id, CASE WHEN position IN {_REC} THEN coalesce(f_std_targets, f_career_targets, m) END AS targets FROM fh, m""")
def _(spark, sf):
    h = feature_panel(spark, sf)
    return ml.baseline_serving(h, td.panel(spark, sf), "targets", ml.RECEIVERS).select("game_id", "gsis_id", "targets")


@query("two_estimands", "ML4", f"""WITH {FEATURES}
SELECT game_id, gsis_id, f_r8_targets AS targets, f_r8_targets * (CASE WHEN depth_rank = 1 THEN 0.75E0 ELSE 0.5E0 END) AS targets_expected FROM fh""")
def _(spark, sf):
    h = feature_panel(spark, sf).withColumn("p_play", F.when(F.col("depth_rank") == 1, 0.75).otherwise(0.5))
    out = ml.estimands(h.drop("targets"), "targets", "f_r8_targets")
    return out.select("game_id", "gsis_id", "targets", "targets_expected")


_TEST = FEATURES + f""",
tm AS (SELECT sum(targets) / count(*) AS m FROM fh WHERE season < 2000 AND position IN {_REC}),
te AS (SELECT fh.*, coalesce(f_r8_targets, m) AS pred, m AS b1, coalesce(f_std_targets, m) AS b2, coalesce(f_career_targets, m) AS b3 FROM fh, tm WHERE season = 2000 AND position IN {_REC})"""


def _scored(spark, sf):
    h = feature_panel(spark, sf).where(F.col("position").isin(ml.RECEIVERS))
    mean = h.where("season < 2000").agg(F.avg("targets")).first()[0]
    test = h.where("season = 2000").withColumn("pred", F.coalesce("f_r8_targets", F.lit(mean)))
    return ml.with_baselines(test, "targets", mean)


@query("baselines_and_ship_gate", "ML7 ML8", f"""WITH {_TEST},
s AS (SELECT position, count(*) AS n, {", ".join(f"avg(abs(targets - {p})) AS {p}_mae" for p in ("pred", "b1", "b2", "b3"))} FROM te GROUP BY position)
SELECT position, n, {", ".join(f"{steady_sql(p + '_mae')} AS {p}_mae" for p in ("pred", "b1", "b2", "b3"))},
 pred_mae < b2_mae AND pred_mae < b3_mae AS passes_gate,
 CASE WHEN NOT (pred_mae < b2_mae AND pred_mae < b3_mae) THEN 'baseline' WHEN pred_mae >= b1_mae THEN 'model_low_confidence' ELSE 'model' END AS present_as FROM s""")
def _(spark, sf):
    s = ml.ship_gate(ml.scores(_scored(spark, sf), ["position"], "targets", ["pred", "b1", "b2", "b3"]))
    return s.select(
        "position", "n", *[steady(F.col(f"{p}_mae")).alias(f"{p}_mae") for p in ("pred", "b1", "b2", "b3")], "passes_gate", "present_as"
    )


_STRATA = FEATURES + """,
er AS (SELECT season, metric, stratum, abs(y - b) AS b, abs(y - a) AS a FROM (
  SELECT season, metric, y, b, a, unnest(list_filter(['pooled', CASE WHEN depth_rank = 1 THEN 'rank1' END, CASE WHEN f_games_prior < 3 THEN 'cold' END], lambda s: s IS NOT NULL)) AS stratum FROM (
   SELECT season, depth_rank, f_games_prior, 'targets' AS metric, targets AS y, coalesce(f_std_targets, 0) AS b, coalesce(f_career_targets, 0) AS a FROM fh
   UNION ALL SELECT season, depth_rank, f_games_prior, 'carries', carries, coalesce(f_std_carries, 0), coalesce(f_career_carries, 0) FROM fh
   UNION ALL SELECT season, depth_rank, f_games_prior, 'attempts', attempts, coalesce(f_std_attempts, 0), coalesce(f_career_attempts, 0) FROM fh))),
sg AS (SELECT season, metric, stratum, count(*) AS n, avg(b) AS base, avg(a) AS arm FROM er GROUP BY 1, 2, 3
  HAVING count(*) >= CASE stratum WHEN 'rank1' THEN 50 WHEN 'cold' THEN 30 ELSE 1 END)"""


def _strata(spark, sf):
    h = feature_panel(spark, sf)
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("metric"), F.col(t).alias("y"), F.coalesce(f"f_std_{t}", F.lit(0.0)).alias("b"),
                F.coalesce(f"f_career_{t}", F.lit(0.0)).alias("a"),
            )
            for t in ("targets", "carries", "attempts")
        ]
    )
    long = h.select("season", "depth_rank_capped", "f_games_prior", F.explode(rows).alias("r")).select(
        "season", "depth_rank_capped", "f_games_prior", "r.*"
    )
    return ml.strata_errors(long, ["season", "metric"], "y", "b", "a")


@query("ablation_by_stratum", "ML9", f"""WITH {_STRATA} SELECT season, metric, stratum, n, {steady_sql('base')} AS base, {steady_sql('arm')} AS arm, {steady_sql('100 * (1 - arm / base)')} AS delta_pct FROM sg""")
def _(spark, sf):
    s = _strata(spark, sf)
    return s.select("season", "metric", "stratum", "n", *[steady(F.col(c)).alias(c) for c in ("base", "arm", "delta_pct")])


@query("two_stage_verdict", "ML10 SE4", f"""WITH {_STRATA},
p AS (SELECT metric || '::' || stratum AS m, max(CASE WHEN season = 1999 THEN 100 * (1 - arm / base) END) AS f1, max(CASE WHEN season = 2000 THEN 100 * (1 - arm / base) END) AS f2 FROM sg GROUP BY 1),
v AS (SELECT avg(f1) AS a, avg(f2) AS b, count(*) AS moved, count(CASE WHEN f1 > 0 AND f2 > 0 THEN 1 END) AS w, count(CASE WHEN f1 < 0 AND f2 < 0 THEN 1 END) AS l
 FROM p WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND (abs(f1) > 1e-9 OR abs(f2) > 1e-9))
SELECT 'career' AS block, {steady_sql('a')} AS mean_1, {steady_sql('b')} AS mean_2, moved, w AS repeated_wins, l AS repeated_losses,
 CASE WHEN a > 0 AND b > 0 AND w >= 3 THEN 'SHIP' WHEN a > 0 THEN 'MIRAGE' ELSE 'REJECT' END AS verdict FROM v""")
def _(spark, sf):
    s = _strata(spark, sf).withColumn("block", F.lit("career")).withColumn("m", F.concat_ws("::", "metric", "stratum"))
    fold = F.when(F.col("season") == 1999, "validation").when(F.col("season") == 2000, "test")
    v = ml.two_stage_verdict(s.withColumn("fold", fold).where("fold IS NOT NULL"), "block", "m", "fold", "validation", "test")
    return v.withColumn("mean_1", steady(F.col("mean_1"))).withColumn("mean_2", steady(F.col("mean_2")))


@query("in_sample_guard", "ML13 DQ15", f"""WITH {td.PANEL} SELECT season, season <= 1999 AS in_sample, count(*) AS n FROM panel GROUP BY season""")
def _(spark, sf):
    from pitpanel.operators.lines import in_sample

    return td.panel(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("n")).withColumn("in_sample", in_sample(F.col("season"), 1999))


def trained(spark, sf, variants=(ad.Variant(),), cfg=fb.Config(), passes=ad.PASSES, keep=()):
    """(plan, packs, fields that they carry besides, models) of the panel: every row with all features, posteriors lean on the eras before the row's own."""
    p = rank_cap(td.panel(spark, sf)).withColumn("p_play", F.when(F.col("depth_rank") == 1, 0.75).otherwise(0.5))
    plan, packs, kept = fb.history_packs(p, cfg, keep)
    return plan, packs, kept, materialise(ad.train(packs, plan, list(variants), passes), "models")


def fold_table(spark, sf, variants=(ad.Variant(),), cfg=fb.Config(), passes=ad.PASSES):
    plan, packs, _, models = trained(spark, sf, variants, cfg, passes)
    return sv.scored_folds(sv.fold_errors(packs, models, plan))


_GRADES = ["pred", "b1", "b2", "b3"]


@query("walk_forward_scores", "ML1 ML2 ML6 ML8 ML12")
def _(spark, sf):
    """Every target scored on every era after the first, with all features and the default floors (no SQL twin).

    A fold that is left out keeps its row, with the reason.
    """
    s = fold_table(spark, sf).withColumn("trained_through", F.col("era") - 1)
    return s.select(F.col("era").alias("season"), "target", "form", "trained_through", "n_train", "n_test", "reason", *[f"{p}_mae" for p in _GRADES], "passes_gate", "present_as")


def _sql_rows():
    """One row per eligible (row, target): actual value, era-to-date and career means, opportunity and shrunk rate."""
    out = []
    rate_of = {name: (n, d, p, k) for name, (n, d, p, k) in fb.EFFICIENCY.items()}
    for t, (cohorts, kind, opp, rate) in ml.TARGETS.items():
        if t not in td.BOX:
            continue
        shrunk, o = "NULL::DOUBLE", "NULL::DOUBLE"
        if opp:
            n, d, p, k = rate_of[rate]
            shrunk = f"(coalesce(t_{n}, 0.0E0) + {fb.SHRINK_K[k]}E0 * prior_{p}) / (coalesce(t_{d}, 0.0E0) + {fb.SHRINK_K[k]}E0)"
            o = f"f_std_{opp}"
        among = ", ".join(f"'{c}'" for c in cohorts)
        some = f" AND {t} >= 0" if kind == "count" else ""
        out.append(f"SELECT season, '{t}' AS target, {t} AS y, f_std_{t} AS std, f_career_{t} AS car, {o} AS o, {shrunk} AS rate, '{kind}' AS kind FROM fp WHERE position IN ({among}) AND {t} IS NOT NULL{some}")
    return " UNION ALL ".join(out)


def _sql_priors():
    cols = ", ".join(f"coalesce(sum({n}) OVER w / nullif(sum({d}) OVER w, 0), {lit}E0) AS prior_{p}" for p, (n, d, lit) in ag.LEAGUE_PRIORS.items())
    sums = ", ".join(f"sum({c}) AS {c}" for c in sorted({c for n, d, _ in ag.LEAGUE_PRIORS.values() for c in (n, d)}))
    return f"se AS (SELECT season, {sums} FROM panel GROUP BY season), sp AS (SELECT season, {cols} FROM se WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


_TOTALS = sorted({c for n, d, *_ in fb.EFFICIENCY.values() for c in (n, d)})
_BASELINES = FEATURES + f""",
{_sql_priors()},
ft AS (SELECT game_id, gsis_id, {", ".join(f"sum({c}) OVER w AS t_{c}" for c in _TOTALS)} FROM panel
  WINDOW w AS (PARTITION BY gsis_id ORDER BY season, week, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fp AS (SELECT fh.*, sp.* EXCLUDE (season), ft.* EXCLUDE (game_id, gsis_id) FROM fh JOIN sp ON fh.season = sp.season JOIN ft ON ft.game_id = fh.game_id AND ft.gsis_id = fh.gsis_id),
lo AS ({_sql_rows()}),
er AS (SELECT season, target, count(*) AS n, sum(y) AS s, avg(o) AS mo FROM lo GROUP BY 1, 2),
fo AS (SELECT a.season, a.target, a.n AS n_test, a.mo, coalesce(sum(b.n), 0)::BIGINT AS n_train, sum(b.s) / sum(b.n) AS b1 FROM er a LEFT JOIN er b ON a.target = b.target AND b.season < a.season
  WHERE a.season > (SELECT min(season) FROM panel) GROUP BY 1, 2, 3, 4),
ba AS (SELECT lo.season, lo.target, y, b1, coalesce(std, b1) AS b2, coalesce(CASE WHEN kind = 'yards' THEN coalesce(o, mo) * rate END, car, b1) AS b3 FROM lo JOIN fo ON lo.season = fo.season AND lo.target = fo.target)
"""
_WHY = f"CASE WHEN n_train < {ml.MIN_TRAIN} THEN 'under {ml.MIN_TRAIN} training rows' WHEN n_test < {ml.MIN_TEST} THEN 'under {ml.MIN_TEST} rows to test on' END"


@query("walk_forward_baselines", "ML6 ML7", f"""WITH {_BASELINES},
g AS (SELECT season, target, {", ".join(f"avg(abs(y - {b})) AS {b}_mae" for b in _GRADES[1:])} FROM ba GROUP BY 1, 2)
SELECT fo.season, fo.target, n_train, n_test, {_WHY} AS reason, {", ".join(f"CASE WHEN ({_WHY}) IS NULL THEN {steady_sql(b + '_mae')} END AS {b}_mae" for b in _GRADES[1:])}
FROM fo JOIN g ON g.season = fo.season AND g.target = fo.target""")
def _(spark, sf):
    """Rows, reasons and the three baselines of every fold and target; training means come from the summed matrices."""
    s = fold_table(spark, sf, passes=0)
    return s.select(F.col("era").alias("season"), "target", "n_train", "n_test", "reason", *[steady(F.col(f"{b}_mae")).alias(f"{b}_mae") for b in _GRADES[1:]])


VARIANTS = (
    ad.Variant("base", leave_out="f_r16_"), ad.Variant("recency", leave_out="f_r16_", recency=True),
    ad.Variant("per_cohort", leave_out="f_r16_", per_cohort=True), ad.Variant("longer_window"),
)


@query("model_variant_errors", "ML11 SF20")
def _(spark, sf):
    """Base, recency-weighted, per-cohort and longer-window models of every target on every later era (no SQL twin)."""
    return fold_table(spark, sf, VARIANTS, fb.Config(windows=(3, 8, 16))).select(F.col("era").alias("season"), "target", "variant", "n_train", "n_test", "reason", F.col("pred_mae").alias("mae"))


@query("serve_projection", "ML2 ML4 ML5 SNK2")
def _(spark, sf):
    """Models trained, gated, published as a version, read back, and every row served by the models of its own era (no SQL twin)."""
    keep = ["season", "week", "game_id", "gsis_id", "position"]
    plan, packs, kept, models = trained(spark, sf, keep=(*keep, "p_play"))
    store = scratch_path(spark, "model-store")
    sv.publish(models, sv.gate_of(sv.fold_errors(packs, models, plan)), store)
    return sv.serve_packs(packs, sv.load(spark, store), plan, kept, keep, "p_play")


@query("calibration_chain", "CP4 CP5 SF16 SF17")
def _(spark, sf):
    """Level maps and ratio quantiles of every target and era, from walk-forward predictions of the eras before it (no SQL twin)."""
    ids = ("game_id", "gsis_id")
    plan, packs, kept, models = trained(spark, sf, keep=ids)
    _, ratios = cp.cross_fitted(sv.predictions(packs, models, plan, sv.fold_errors(packs, models, plan), kept))
    return ratios.select("target", "era", "bin", "lo", "hi", "n", "mean_pred", "mean_actual", F.col("quantiles")[99].alias("median_ratio"))
