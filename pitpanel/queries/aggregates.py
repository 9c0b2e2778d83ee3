"""Aggregation queries on the plays, panel and orders bindings."""

from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.operators import aggregates as ag
from pitpanel.queries import query
from pitpanel.queries.shaping import ATT, SCRIM

S, N_, D = "is_scrimmage", "(neutral AND is_scrimmage)", "is_dropback"


def _n(mask):
    return f"coalesce(sum(CASE WHEN {mask} THEN 1.0E0 ELSE 0.0E0 END), 0.0E0)"


def _avg(value, mask):
    return f"sum(CASE WHEN {mask} THEN {value} END) / nullif(count(CASE WHEN {mask} THEN {value} END), 0)"


def _tot(value, mask="true"):
    return f"coalesce(sum(CASE WHEN {mask} THEN {value} END), 0.0E0)"


def _zone(m):
    return f"({S} AND yardline_100 <= {m})"


MEASURES = {
    "off_plays": _n(S),
    "off_dropbacks": _n(D),
    "off_pass_att": _tot("off_pass_att"),
    "off_rush_att": _tot("off_rush_att"),
    "off_designed_rush": _tot("off_designed_rush"),
    "off_scrambles": _tot("off_scramble"),
    "off_sacks": _tot("off_sack"),
    "off_pass_rate": f"{_n(D)} / nullif({_n(S)}, 0)",
    "off_neutral_pass_rate": f"{_n(N_ + ' AND ' + D)} / nullif({_n(N_)}, 0)",
    "off_proe": _avg("pass_oe", S),
    "off_neutral_proe": _avg("pass_oe", N_),
    "off_xpass": _avg("xpass", S),
    "off_neutral_plays": _n(N_),
    "off_epa_play": _avg("epa", S),
    "off_pass_epa": _avg("epa", f"{S} AND {D}"),
    "off_rush_epa": _avg("epa", f"{S} AND off_designed_rush > 0"),
    "off_success_rate": _avg("success", S),
    "off_yards": _tot("yards_gained", S),
    "off_sec_per_play": _avg("play_clock", N_),
    "off_drives": f"CAST(count(DISTINCT CASE WHEN {S} THEN drive END) AS DOUBLE)",
    "off_rz_plays": _n(_zone(20)),
    "off_i10_plays": _n(_zone(10)),
    "off_i5_plays": _n(_zone(5)),
    "off_rz_rush": _tot("off_rush_att", _zone(20)),
    "off_rz_pass": _tot("off_pass_att", _zone(20)),
    "off_pass_td": _tot("coalesce(pass_touchdown, 0.0E0)", S),
    "off_rush_td": _tot("coalesce(rush_touchdown, 0.0E0)", S),
    "realized_mean_wp": f"round({_avg('wp', S)}, 9)",
    "realized_mean_score_diff": _avg("score_differential", S),
    "realized_frac_leading": _avg("CASE WHEN score_differential > 0 THEN 1.0E0 ELSE 0.0E0 END", S),
    "realized_frac_trailing": _avg("CASE WHEN score_differential < 0 THEN 1.0E0 ELSE 0.0E0 END", S),
}

TEAM = ATT + """,
opp AS (SELECT game_id, posteam, defteam AS opponent FROM (
  SELECT game_id, posteam, defteam, row_number() OVER (PARTITION BY game_id, posteam ORDER BY count(*) DESC, defteam) AS rn
  FROM att WHERE """ + SCRIM + """ GROUP BY game_id, posteam, defteam) WHERE rn = 1),
tw0 AS (SELECT season, week, game_id, posteam AS team, max(CAST(home_team = posteam AS BIGINT)) AS is_home,
  """ + ",\n  ".join(f"{e} AS {n}" for n, e in MEASURES.items()) + """
  FROM att WHERE """ + SCRIM + """ GROUP BY season, week, game_id, posteam),
tw AS (SELECT tw0.*, opponent FROM tw0 JOIN opp ON tw0.game_id = opp.game_id AND tw0.team = opp.posteam)"""


def team_week(spark, sf):
    """Group x event table of the plays binding."""
    return ag.team_side(td.plays(spark, sf)).withColumn("realized_mean_wp", F.round("realized_mean_wp", 9))


@query("team_event_measures", "AG1 AG2 AG3 AG4", f"WITH {TEAM} SELECT * FROM tw")
def _(spark, sf):
    return team_week(spark, sf)


_OFF = [m for m in MEASURES if m.startswith("off_")]


@query("rival_side_self_join", "JN6", f"""WITH {TEAM}
SELECT a.game_id, a.team, a.opponent, """ + ", ".join(
    f"b.{c} AS {c.replace('off_', 'def_allowed_', 1)}" for c in _OFF
) + " FROM tw a LEFT JOIN tw b ON a.game_id = b.game_id AND a.opponent = b.team")
def _(spark, sf):
    allowed = [c.replace("off_", "def_allowed_", 1) for c in _OFF]
    return ag.with_rival_side(team_week(spark, sf)).select("game_id", "team", "opponent", *allowed)


_LG = ["off_plays", "off_dropbacks", "off_pass_att", "off_designed_rush", "off_rz_plays", "off_drives", "off_pass_td", "off_rush_td"]


@query("era_league_means", "AG5", f"""WITH {TEAM} SELECT season, """ + ", ".join(
    f"sum({c}) / count({c}) AS league_{c}" for c in _LG
) + ", count(*) AS league_team_games FROM tw GROUP BY season")
def _(spark, sf):
    return ag.league_context(team_week(spark, sf), columns=_LG)


@query("crosswalk_and_max_snaps", "AG6 JN4", """WITH x AS (SELECT s_name AS pfr_id, min(s_suppkey) AS gsis_id FROM supplier GROUP BY s_name),
c AS (SELECT l_orderkey AS game_id, s_name AS pfr_id, l_quantity AS offense_snaps, l_tax AS offense_pct FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT game_id, gsis_id, max(offense_snaps) AS off_snaps, max(offense_pct) + 0.0E0 AS off_pct FROM c JOIN x USING (pfr_id) GROUP BY game_id, gsis_id""")
def _(spark, sf):
    s = td.table(spark, sf, "supplier")
    x = ag.crosswalk(s.select(F.col("s_name").alias("pfr_id"), F.col("s_suppkey").alias("gsis_id")), "pfr_id", "gsis_id")
    c = td.table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("game_id"), F.col("s_name").alias("pfr_id"),
        F.col("l_quantity").alias("offense_snaps"), F.col("l_tax").alias("offense_pct"),
    )
    return ag.snaps(c, x, "pfr_id").withColumn("off_pct", F.col("off_pct") + F.lit(0.0))


@query("on_field_exposure", "AG7 JN2", f"""WITH {td.PLAYS},
part AS (SELECT game_id, play_id, string_agg(DISTINCT CAST(player_id AS VARCHAR), ';') AS ids FROM plays GROUP BY game_id, play_id),
j AS (SELECT p.game_id, p.play_id, p.qb_dropback, unnest(string_split(ids, ';')) AS gsis_id FROM plays p JOIN part USING (game_id, play_id)
      WHERE play_type IN ('pass', 'run'))
SELECT game_id, gsis_id, count(*) AS off_snaps_pbp, sum(qb_dropback) AS routes_run_proxy, sum(qb_dropback) AS pass_snaps
FROM j WHERE length(gsis_id) > 0 GROUP BY game_id, gsis_id""")
def _(spark, sf):
    p = td.plays(spark, sf)
    part = p.groupBy("game_id", "play_id").agg(
        F.concat(F.array_join(F.collect_set(F.col("player_id").cast("string")), ";"), F.lit(";")).alias("offense_players")
    )
    return ag.on_field(p, part)


def _opp_side(who, count, prefix, extra):
    z = {"rz": "yardline_100 <= 20", "i10": "yardline_100 <= 10", "i5": "yardline_100 <= 5", "neutral": "neutral"}
    flags = ", ".join(f"sum(CASE WHEN {c} THEN 1.0E0 ELSE 0.0E0 END) AS {prefix}_{n}" for n, c in z.items())
    return f"SELECT game_id, {who} AS gsis_id, sum({count}) AS pbp_{prefix}, {flags}, {extra} FROM att WHERE {count} > 0 GROUP BY game_id, {who}"


@query("opportunity_by_location", "AG8 JN3", f"""WITH {ATT},
r AS ({_opp_side('player_id', 'off_rush_att', 'carries', 'sum(epa) / nullif(count(epa), 0) AS rush_epa')}),
t AS ({_opp_side('partner_id', 'off_pass_att', 'targets', 'sum(air_yards) / nullif(count(air_yards), 0) AS adot, sum(epa) / nullif(count(epa), 0) AS target_epa')})
SELECT * FROM r FULL JOIN t USING (game_id, gsis_id)""")
def _(spark, sf):
    return ag.opportunity(td.plays(spark, sf), "player_id", "partner_id")


_M4 = ["targets", "receiving_yards", "carries", "rushing_yards"]


@query("rival_cohort_allowed_totals", "AG9", f"""WITH {td.PANEL}
SELECT season, week, game_id, opponent_team AS def_team, position, """ + ", ".join(f"sum({m}) AS {m}" for m in _M4)
    + " FROM panel GROUP BY season, week, game_id, opponent_team, position")
def _(spark, sf):
    return ag.allowed_totals(td.panel(spark, sf), _M4)


SCHEME = """scheme AS (SELECT season, defteam AS def_team,
 avg(CASE WHEN defense_man_zone_type IN ('MAN_COVERAGE', 'ZONE_COVERAGE') THEN CASE WHEN defense_man_zone_type = 'MAN_COVERAGE' THEN 1.0E0 ELSE 0.0E0 END END) AS man_rate,
 avg(CASE WHEN qb_dropback = 1 THEN was_pressure END) AS pressure_rate,
 avg(CASE WHEN qb_dropback = 1 THEN CASE WHEN number_of_pass_rushers >= 5 THEN 1.0E0 ELSE 0.0E0 END END) AS blitz_rate,
 avg(CASE WHEN rush_attempt = 1 THEN CASE WHEN defenders_in_box >= 8 THEN 1.0E0 ELSE 0.0E0 END END) AS box8_rate,
 avg(CASE WHEN rush_attempt = 1 THEN defenders_in_box END) AS box_avg,
 count(CASE WHEN defense_man_zone_type IN ('MAN_COVERAGE', 'ZONE_COVERAGE') THEN 1 END) AS n_classified,
 count(CASE WHEN qb_dropback = 1 THEN 1 END) AS n_pass, count(CASE WHEN rush_attempt = 1 THEN 1 END) AS n_rush
 FROM plays GROUP BY season, defteam)"""


@query("rates_with_own_denominators", "AG10", f"WITH {td.PLAYS}, {SCHEME} SELECT * FROM scheme")
def _(spark, sf):
    return ag.scheme_rates(td.plays(spark, sf))


CREW = """crew AS (SELECT season, home_team AS referee, avg(pen) AS ref_pen_per_game, avg(yds) AS ref_pen_yards_per_game,
 avg(dpi) AS ref_dpi_per_game, count(*) AS n_games FROM (
  SELECT season, home_team, game_id, sum(penalty) AS pen, sum(penalty_yards) AS yds,
   sum(CASE WHEN contains(lower(coalesce(penalty_type, '')), 'defensive pass interference') THEN 1.0E0 ELSE 0.0E0 END) AS dpi
  FROM plays GROUP BY season, home_team, game_id) GROUP BY season, home_team)"""


@query("two_level_event_then_group_means", "AG11 SF23", f"WITH {td.PLAYS}, {CREW} SELECT * FROM crew")
def _(spark, sf):
    p = td.plays(spark, sf).withColumn("referee", F.col("home_team"))
    return ag.crew_rates(p, "referee")


def priors_sql(before, src="panel"):
    return "SELECT " + ", ".join(
        f"coalesce(sum(CASE WHEN season < {before} THEN {n} END) / nullif(sum(CASE WHEN season < {before} THEN {d} END), 0), {lit}) AS {name}"
        for name, (n, d, lit) in ag.LEAGUE_PRIORS.items()
    ) + f" FROM {src}"


@query("league_priors", "AG12", f"WITH {td.PANEL} {priors_sql(1999)}")
def _(spark, sf):
    return ag.league_priors(td.box_totals(spark, sf, ["season"]), 1999)


@query("group_share_of_era_mean", "AG14", f"""WITH {td.PLAYS}, {SCHEME},
m AS (SELECT season, avg(man_rate) AS a, avg(box_avg) AS b FROM scheme GROUP BY season)
SELECT s.season, def_team, round(man_rate / nullif(a, 0), 8) AS rel_man_rate, round(box_avg / nullif(b, 0), 8) AS rel_box_avg
FROM scheme s JOIN m ON s.season = m.season""")
def _(spark, sf):
    t = ag.era_share(ag.scheme_rates(td.plays(spark, sf)), "season", ["man_rate", "box_avg"])
    return t.select("season", "def_team", *[F.round(c, 8).alias(c) for c in ("rel_man_rate", "rel_box_avg")])


@query("weighted_sums", "AG15", f"""WITH {td.PANEL}
SELECT game_id, gsis_id, 3.0E0 * carries + targets AS points,
 coalesce(ngs_avg_separation, 0.0E0) * 0.5E0 + receptions AS skip_null, ngs_avg_separation * 0.5E0 + receptions AS null_wins FROM panel""")
def _(spark, sf):
    p = td.panel(spark, sf)
    return p.select(
        "game_id", "gsis_id",
        ag.weighted_sum([("carries", 3.0), ("targets", 1.0)], False).alias("points"),
        ag.weighted_sum([("ngs_avg_separation", 0.5), ("receptions", 1.0)], True).alias("skip_null"),
        ag.weighted_sum([("ngs_avg_separation", 0.5), ("receptions", 1.0)], False).alias("null_wins"),
    )


@query("reconciliation_of_two_sources", "AG16 DQ5", f"""WITH {ATT},
a AS (SELECT game_id, posteam AS team, sum(off_pass_att) AS x1, sum(off_rush_att) AS x2 FROM att WHERE {SCRIM} GROUP BY 1, 2),
b AS (SELECT game_id, posteam AS team, sum(complete_pass + incomplete_pass + interception) AS y1, sum(rush_attempt) AS y2 FROM att WHERE play_type <> 'punt' GROUP BY 1, 2),
j AS (SELECT * FROM a JOIN b USING (game_id, team))
SELECT 'off_pass_att=targets' AS "check", count(CASE WHEN x1 = y1 THEN 1 END) AS equal, count(*) AS joined, max(abs(x1 - y1)) AS worst FROM j
UNION ALL SELECT 'off_rush_att=carries', count(CASE WHEN x2 = y2 THEN 1 END), count(*), max(abs(x2 - y2)) FROM j""")
def _(spark, sf):
    a = team_week(spark, sf).select("game_id", "team", "off_pass_att", "off_rush_att")
    b = td.panel(spark, sf).groupBy("game_id", "team").agg(F.sum("targets").alias("targets"), F.sum("carries").alias("carries"))
    return ag.reconcile(a, b, ["game_id", "team"], [("off_pass_att", "targets"), ("off_rush_att", "carries")])


# Scored rows: predict a supplier's targets by its prior mean in the era, base = career mean.
def scored_sql(targets) -> str:
    cols = ", ".join(f"sum({t}) OVER e / nullif(count(*) OVER e, 0) AS {t}_std, sum({t}) OVER c / nullif(count(*) OVER c, 0) AS {t}_car" for t in targets)
    rows = " UNION ALL ".join(
        f"SELECT season, week, game_id, gsis_id, team, position, '{t}' AS target, {t}_std AS pred, {t} AS actual, abs({t}_std - {t}) AS abs_err_model, abs({t}_car - {t}) AS abs_err_b2 FROM sc0"
        for t in targets
    )
    return td.PANEL + f""",
sc0 AS (SELECT season, week, game_id, gsis_id, team, position, {", ".join(targets)}, {cols}
 FROM panel WINDOW e AS (PARTITION BY gsis_id, season ORDER BY week, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  c AS (PARTITION BY gsis_id ORDER BY season, week, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scored AS ({rows})"""


SCORED = scored_sql(["targets", "carries"])


def scored(spark, sf, targets=("targets", "carries")):
    """Long history of predictions, actuals and paired errors for each target."""
    from pitpanel.operators.ordered import Spec
    from pitpanel.operators.windows import history
    from pitpanel.roles import PLAYER_PANEL as R

    specs = []
    for t in targets:
        specs += [Spec(f"{t}_std", "mean", t, within=("season",)), Spec(f"{t}_car", "mean", t)]
    h = history(td.panel(spark, sf), R, specs)
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("target"),
                F.col(f"{t}_std").alias("pred"),
                F.col(t).alias("actual"),
                F.abs(F.col(f"{t}_std") - F.col(t)).alias("abs_err_model"),
                F.abs(F.col(f"{t}_car") - F.col(t)).alias("abs_err_b2"),
            )
            for t in targets
        ]
    )
    return h.select(
        "season", "week", "game_id", "gsis_id", "team", "position", F.explode(rows).alias("r")
    ).select("season", "week", "game_id", "gsis_id", "team", "position", "r.*")


_PAIRED = "abs_err_model IS NOT NULL AND abs_err_b2 IS NOT NULL AND week >= 2"


@query("paired_errors_per_target", "AG17", f"""WITH {SCORED},
t AS (SELECT target, count(*) AS n, avg(abs_err_model) AS m, avg(abs_err_b2) AS b FROM scored WHERE {_PAIRED} GROUP BY target)
SELECT target, n, round(m, 6) AS model_mae, round(b, 6) AS base_mae, round(100 * (1 - m / b), 4) AS edge_pct FROM t""")
def _(spark, sf):
    e = ag.paired_errors(scored(spark, sf).where("week >= 2"), ["target"])
    return e.select(
        "target", "n", F.round("model_mae", 6).alias("model_mae"), F.round("base_mae", 6).alias("base_mae"),
        F.round("edge_pct", 4).alias("edge_pct"),
    )


@query("edge_summary_grouping_sets", "AG18", f"""WITH {SCORED},
t AS (SELECT season, target, avg(abs_err_model) AS m, avg(abs_err_b2) AS b FROM scored WHERE {_PAIRED} GROUP BY GROUPING SETS ((season, target), (target)))
SELECT season, count(*) AS stats, count(CASE WHEN m < b THEN 1 END) AS better, round(avg(100 * (1 - m / b)), 4) AS mean_edge FROM t GROUP BY season""")
def _(spark, sf):
    paired = scored(spark, sf).where(_PAIRED)
    per = (
        paired.groupingSets([["season", "target"], ["target"]], "season", "target")
        .agg(F.avg("abs_err_model").alias("model_mae"), F.avg("abs_err_b2").alias("base_mae"))
        .withColumn("edge_pct", 100 * (1 - F.col("model_mae") / F.col("base_mae")))
    )
    return ag.edge_summary(per, ["season"]).withColumn("mean_edge", F.round("mean_edge", 4))


_PROFILE = f"""WITH {SCORED},
e AS (SELECT target, pred AS p, actual AS a, abs(actual - pred) AS err FROM scored WHERE pred IS NOT NULL),
s AS (SELECT target, stddev_pop(a - p) AS sd FROM e GROUP BY target)
SELECT e.target, count(*) AS n, round(avg(a), 6) AS mean, round(avg(err), 6) AS mae, round(100 * avg(err) / avg(a), 4) AS mae_pct,
 round(quantile_cont(err, 0.5), 6) AS p50, round(quantile_cont(err, 0.9), 6) AS p90,
 round(100 * avg(CASE WHEN err <= 0.2 * greatest(p, 1e-9) THEN 1.0E0 ELSE 0.0E0 END), 6) AS within20,
 round(100 * avg(CASE WHEN err <= sd THEN 1.0E0 ELSE 0.0E0 END), 6) AS within1sd, round(any_value(sd), 6) AS sd
FROM e JOIN s ON e.target = s.target GROUP BY e.target"""


def _profile(spark, sf, hot_rows=None):
    p = ag.error_profile(scored(spark, sf).where("pred IS NOT NULL"), ["target"], "pred", "actual", hot_rows)
    four = {"mae_pct"}
    return p.select("target", "n", *[F.round(c, 4 if c in four else 6).alias(c) for c in p.columns if c not in ("target", "n")])


@query("error_quantiles", "AG19", _PROFILE)
def _(spark, sf):
    return _profile(spark, sf)


@query("error_quantiles_split_runs", "AG19", _PROFILE)
def _(spark, sf):
    """Two targets hold the whole table; quantiles come from accumulated value counts."""
    return _profile(spark, sf, hot_rows=2000)


_MARKS = [0.05, 0.25, 0.5, 0.75, 0.9, 0.99]


@query("mergeable_error_quantiles", "AG19 CP5", f"""WITH {SCORED}
SELECT target, p, count(*) AS n, true AS close FROM scored, (VALUES {", ".join(f"({p}E0)" for p in _MARKS)}) v(p) WHERE pred IS NOT NULL AND actual IS NOT NULL GROUP BY target, p""")
def _(spark, sf):
    """Sketches of the errors per target and season, merged over seasons; each returned value's true rank is checked against the wanted one."""
    e = scored(spark, sf).where("pred IS NOT NULL").select("target", "season", F.abs(F.col("pred") - F.col("actual")).alias("err"))
    merged = ag.state_quantiles(ag.merged_states(ag.quantile_states(e, ["target", "season"], "err"), ["target"]), _MARKS)
    asked = merged.select("target", "n", F.posexplode("quantiles").alias("k", "value"))
    ranks = e.join(F.broadcast(asked), "target").groupBy("target", "n", "k").agg(  # six rows a target
        F.count_if(F.col("err") < F.col("value")).alias("below"), F.count_if(F.col("err") <= F.col("value")).alias("upto")
    )
    p = F.array(*[F.lit(x) for x in _MARKS])[F.col("k")]
    slack = F.lit(ag.SKETCH_ERROR) * F.col("n") + 1
    close = (F.col("below") <= p * F.col("n") + slack) & (F.col("upto") >= p * F.col("n") - slack)
    return ranks.select("target", p.alias("p"), "n", close.alias("close"))


@query("concentration_per_group", "AG22", f"""WITH {td.PANEL}
SELECT season, week, team, max(carries) / nullif(sum(carries), 0) AS top_share,
 coalesce(pow(sum(CASE WHEN carries > 0 THEN carries END), 2) / sum(CASE WHEN carries > 0 THEN carries * carries END), 0.0E0) AS effective_n
FROM panel GROUP BY season, week, team""")
def _(spark, sf):
    return ag.concentration(td.panel(spark, sf), ["season", "week", "team"], "carries")


@query("totals_in_three_estimands", "AG23", f"""WITH {td.PANEL},
e AS (SELECT season, team, targets AS a, receptions AS p, receptions * 0.5E0 AS x, carries > 0 AS played FROM panel)
SELECT season, team, sum(p) AS conditional, sum(x) AS expected, coalesce(sum(CASE WHEN played THEN p END), 0.0E0) AS played_only, sum(a) AS actual,
 sum(p) / nullif(sum(a), 0) AS conditional_ratio, sum(x) / nullif(sum(a), 0) AS expected_ratio,
 coalesce(sum(CASE WHEN played THEN p END), 0.0E0) / nullif(sum(a), 0) AS played_only_ratio FROM e GROUP BY season, team""")
def _(spark, sf):
    p = td.panel(spark, sf).select(
        "season", "team", F.col("targets").alias("a"), F.col("receptions").alias("p"),
        (F.col("receptions") * 0.5).alias("x"), (F.col("carries") > 0).alias("played"),
    )
    return ag.estimand_totals(p, ["season", "team"], "p", "x", "a", "played")


@query("slate_summary", "AG24", """SELECT CAST(year(o_orderdate) AS BIGINT) AS season, CAST(month(o_orderdate) AS BIGINT) AS week, count(*) AS games,
 count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS with_line, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finals,
 CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    g = td.table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("bigint").alias("season"), F.month("o_orderdate").cast("bigint").alias("week"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("total_line"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("home_score"),
        F.to_date("o_orderdate").alias("gameday"),
    )
    return ag.slate_summary(g, ["season", "week"])


@query("groups_on_bye", "AG24 AG27", """WITH l AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS season, CAST(month(o_orderdate) AS BIGINT) AS week, o_custkey AS team FROM orders),
p AS (SELECT DISTINCT season, week FROM l), t AS (SELECT DISTINCT season, team FROM l)
SELECT t.season, t.team, p.week FROM t JOIN p ON t.season = p.season
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.season = t.season AND l.team = t.team AND l.week = p.week)""")
def _(spark, sf):
    legs = td.table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("bigint").alias("season"), F.month("o_orderdate").cast("bigint").alias("week"),
        F.col("o_custkey").alias("team"),
    )
    return ag.groups_idle(legs, "season", "week", "team")


@query("distinct_periods_of_eras", "AG27", """SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS season, CAST(month(o_orderdate) AS BIGINT) AS week FROM orders""")
def _(spark, sf):
    o = td.table(spark, sf, "orders")
    return o.select(
        F.year("o_orderdate").cast("bigint").alias("season"), F.month("o_orderdate").cast("bigint").alias("week")
    ).distinct()


@query("computed_share_against_feed", "AG25", f"""WITH {td.PANEL},
e AS (SELECT position, receptions / targets AS ours, completions / targets AS feed FROM panel WHERE targets > 0)
SELECT position, count(*) AS n, round(corr(ours, feed), 6) AS corr, round(avg(abs(ours - feed)), 6) AS mean_gap FROM e GROUP BY position""")
def _(spark, sf):
    p = td.panel(spark, sf).where("targets > 0").select(
        "position", (F.col("receptions") / F.col("targets")).alias("ours"), (F.col("completions") / F.col("targets")).alias("feed")
    )
    return p.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.corr("ours", "feed"), 6).alias("corr"),
        F.round(F.avg(F.abs(F.col("ours") - F.col("feed"))), 6).alias("mean_gap"),
    )


@query("value_distribution", "AG26", """SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def _(spark, sf):
    return td.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("era_drift_report", "AG28", f"""WITH {TEAM} SELECT season, """ + ", ".join(
    f"round(avg({c}), 8) AS mean_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in ("off_plays", "off_pass_rate", "off_proe")
) + " FROM tw GROUP BY season")
def _(spark, sf):
    r = ag.drift_report(team_week(spark, sf), "season", ["off_plays", "off_pass_rate", "off_proe"])
    return r.select(*[F.round(c, 8).alias(c) if c.startswith("mean_") else c for c in r.columns])
