"""Feature block queries on the panel binding."""

from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.operators import aggregates as ag
from pitpanel.operators.shape import rank_cap
from pitpanel.plans import blocks as fb
from pitpanel.queries import query, steady, steady_sql
from pitpanel.session import materialise
from pitpanel.queries.aggregates import CREW, SCHEME, TEAM, priors_sql, team_week

_VOL = [c for c in fb.VOLUME_STATS if c in td.BOX]
_E = "PARTITION BY gsis_id ORDER BY season, week, game_id ROWS BETWEEN"
_PRE = "UNBOUNDED PRECEDING AND 1 PRECEDING"


def _hist(c):
    cols = [f"sum({c}) OVER c / nullif(count(*) OVER c, 0) AS f_career_{c}"]
    cols += [f"sum({c}) OVER r{w} / nullif(count(*) OVER r{w}, 0) AS f_r{w}_{c}" for w in (3, 8)]
    return cols + [f"sum({c}) OVER e / nullif(count(*) OVER e, 0) AS f_std_{c}"]


_WIN = f"""WINDOW c AS ({_E} {_PRE}), r3 AS ({_E} 3 PRECEDING AND 1 PRECEDING), r8 AS ({_E} 8 PRECEDING AND 1 PRECEDING),
 e AS (PARTITION BY gsis_id, season ORDER BY week, game_id ROWS BETWEEN {_PRE})"""
FEATURES = td.PANEL + f""",
fh AS (SELECT *, count(*) OVER c AS f_games_prior, count(*) OVER e AS f_games_prior_season, {", ".join(x for c in _VOL for x in _hist(c))} FROM panel {_WIN})"""


def panel_priors(spark, sf, before=1999):
    """League priors of the panel; one row, read to the driver as seven numbers."""
    return fb.priors_dict(ag.league_priors(td.box_totals(spark, sf, ["season"]), before).first())


_LITERAL = {n: lit for n, (_, _, lit) in ag.LEAGUE_PRIORS.items()}


@query("entity_history_block", "FB1", f"WITH {FEATURES} SELECT game_id, gsis_id, f_games_prior, f_games_prior_season, "
       + ", ".join(f"f_{p}_{c}" for c in _VOL for p in ("career", "r3", "r8", "std")) + " FROM fh")
def _(spark, sf):
    """Fourteen counts with four windows each, one exchange."""
    h = fb.entity_block(td.panel(spark, sf), _LITERAL)
    return h.select("game_id", "gsis_id", *[c for c in h.columns if c.startswith("f_") and not c.startswith("f_shrunk")])


@query("rate_history_skips_missing", "FB13", f"""WITH {td.PANEL}
SELECT game_id, gsis_id, sum(ngs_avg_separation) OVER c / nullif(count(ngs_avg_separation) OVER c, 0) AS f_career_ngs_avg_separation,
 sum(carries_rz) OVER c / nullif(count(*) OVER c, 0) AS f_career_carries_rz FROM panel WINDOW c AS ({_E} {_PRE})""")
def _(spark, sf):
    h = fb.entity_block(td.panel(spark, sf), _LITERAL, fb.Config(tracking=True, zone=True))
    return h.select("game_id", "gsis_id", "f_career_ngs_avg_separation", "f_career_carries_rz")


def _post(n, d, p, k):
    return f"(coalesce(sum({n}) OVER c, 0.0E0) + {k}E0 * {p}) / (coalesce(sum({d}) OVER c, 0.0E0) + {k}E0)"


@query("shrunk_efficiency_block", "FB2 SF14 AG12", f"""WITH {td.PANEL}, pri AS ({priors_sql(1999)})
SELECT game_id, gsis_id, {", ".join(f"{steady_sql(_post(n, d, 'pri.' + p, fb.SHRINK_K[k]))} AS {name}" for name, (n, d, p, k) in fb.EFFICIENCY.items())}
FROM panel, pri WINDOW c AS ({_E} {_PRE})""")
def _(spark, sf):
    h = fb.entity_block(td.panel(spark, sf), panel_priors(spark, sf))
    return h.select("game_id", "gsis_id", *[steady(F.col(c)).alias(c) for c in fb.EFFICIENCY])


@query("shrunk_share_block", "FB3", f"""WITH {td.PANEL}
SELECT game_id, gsis_id, {", ".join(f"{_post(n, d, p, fb.SHRINK_K[k])} AS {name}" for name, (n, d, p, k) in fb.SHARES.items())}
FROM panel WINDOW c AS ({_E} {_PRE})""")
def _(spark, sf):
    h = fb.entity_block(td.panel(spark, sf), _LITERAL)
    return h.select("game_id", "gsis_id", *fb.SHARES)


_S4 = fb.ALLOWED_STATS
_DVP = td.PANEL + f""",
al AS (SELECT season, week, game_id, opponent_team AS def_team, position, {", ".join(f"sum({c}) AS {c}" for c in _S4)} FROM panel GROUP BY 1, 2, 3, 4, 5),
em AS (SELECT position, season, {", ".join(f"sum({c}) / count(*) AS {c}" for c in _S4)} FROM al GROUP BY 1, 2),
ep AS (SELECT position, season, {", ".join(f"avg({c}) OVER (PARTITION BY position ORDER BY season ROWS BETWEEN {_PRE}) AS p_{c}" for c in _S4)} FROM em),
ea AS (SELECT position, {", ".join(f"sum({c}) / count(*) AS e_{c}" for c in _S4)} FROM al GROUP BY 1),
aw AS (SELECT *, count(*) OVER d AS n, {", ".join(f"coalesce(sum({c}) OVER d, 0.0E0) AS s_{c}" for c in _S4)} FROM al
  WINDOW d AS (PARTITION BY def_team, position ORDER BY season, week, game_id ROWS BETWEEN {_PRE}))"""


def _dvp_sql(compat):
    p = (lambda c: f"coalesce(p_{c}, e_{c})") if compat else (lambda c: f"p_{c}")
    cols = ", ".join(steady_sql(f"(s_{c} + {p(c)} * 12.0E0) / (n + 12.0E0)") + f" AS f_dvp_{c}" for c in _S4)
    return f"""WITH {_DVP} SELECT pa.game_id, pa.gsis_id, {cols} FROM panel pa
JOIN aw ON pa.game_id = aw.game_id AND pa.opponent_team = aw.def_team AND pa.position = aw.position AND pa.season = aw.season AND pa.week = aw.week
JOIN ep ON ep.position = pa.position AND ep.season = pa.season JOIN ea ON ea.position = pa.position"""


def _dvp(spark, sf, **cfg):
    h = fb.rival_cohort_block(td.panel(spark, sf), fb.Config(**cfg))
    return h.select("game_id", "gsis_id", *[steady(F.col(f"f_dvp_{c}")).alias(f"f_dvp_{c}") for c in _S4])


@query("rival_cohort_block", "FB4", _dvp_sql(False))
def _(spark, sf):
    return _dvp(spark, sf)


@query("rival_cohort_block_compat_split_runs", "FB4", _dvp_sql(True))
def _(spark, sf):
    """Published fallback, with (rival, cohort) timelines cut into runs of at most 50 rows."""
    return _dvp(spark, sf, compat=True, hot_rows=50)


_T7, _R4 = fb.TEAM_STATS, fb.RIVAL_STATS
_TW = TEAM + f""",
tj AS (SELECT a.*, {", ".join(f"b.{c.replace('def_allowed_', 'off_')} AS {c}" for c in _R4)} FROM tw a LEFT JOIN tw b ON a.game_id = b.game_id AND a.opponent = b.team),
lg AS (SELECT season, avg(off_proe) AS v FROM tw GROUP BY season),
th AS (SELECT *, {", ".join(f"avg(coalesce({c}, 0.0E0)) OVER t AS p_{c}, avg(coalesce({c}, 0.0E0)) OVER t4 AS q_{c}" for c in _T7)},
  {", ".join(f"avg(coalesce({c}, 0.0E0)) OVER t AS o_{c}" for c in _R4)}
  FROM tj WINDOW t AS (PARTITION BY team ORDER BY season, week, game_id ROWS BETWEEN {_PRE}), t4 AS (PARTITION BY team ORDER BY season, week, game_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
tc AS (SELECT *, {", ".join(f"avg(coalesce({c}, 0.0E0)) OVER t AS c_{c}" for c in _R4)}
  FROM tj WINDOW t AS (PARTITION BY opponent ORDER BY season, week, game_id ROWS BETWEEN {_PRE}))"""
_PAN = td.PANEL[len(td.PLAYS) :]


def _team(spark, sf):
    """The group table is an artifact: written once, then read by every block that needs it."""
    own = materialise(team_week(spark, sf), "team-own")
    return materialise(ag.with_rival_side(own), "team")


def _league(t):
    return t.groupBy("season").agg(F.avg("off_proe").alias("league_off_proe"))


def _r8(h, cols):
    return h.select("game_id", "gsis_id", *[steady(F.col(c)).alias(c) for c in cols])


_TEAM_COLS = [f"f_team_{k}_{c}" for c in _T7 for k in ("prior", "r4")] + ["f_team_proe_centered"]


@query("group_tendency_block", "FB5", f"""WITH {_TW}{_PAN}
SELECT p.game_id, p.gsis_id, {", ".join(f"{steady_sql('p_' + c)} AS f_team_prior_{c}, {steady_sql('q_' + c)} AS f_team_r4_{c}" for c in _T7)},
 {steady_sql("p_off_proe - (SELECT v FROM lg WHERE lg.season = (SELECT max(season) FROM lg x WHERE x.season < th.season))")} AS f_team_proe_centered
FROM panel p LEFT JOIN th ON p.game_id = th.game_id AND p.team = th.team""")
def _(spark, sf):
    t = _team(spark, sf)
    return _r8(fb.team_block(td.panel(spark, sf), t, _league(t)), _TEAM_COLS)


_OPP = [f"f_opp_prior_{c}" for c in _R4]


@query("rival_history_block", "FB6", f"""WITH {_TW}{_PAN}
SELECT p.game_id, p.gsis_id, {", ".join(f"{steady_sql('o_' + c)} AS f_opp_prior_{c}" for c in _R4)} FROM panel p LEFT JOIN th ON p.game_id = th.game_id AND p.opponent_team = th.team""")
def _(spark, sf):
    t = _team(spark, sf)
    return _r8(fb.team_block(td.panel(spark, sf), t, _league(t)), _OPP)


@query("rival_history_block_compat", "FB6", f"""WITH {_TW}{_PAN}
SELECT p.game_id, p.gsis_id, {", ".join(f"{steady_sql('c_' + c)} AS f_opp_prior_{c}" for c in _R4)} FROM panel p LEFT JOIN tc ON p.game_id = tc.game_id AND p.opponent_team = tc.opponent""")
def _(spark, sf):
    t = _team(spark, sf)
    return _r8(fb.team_block(td.panel(spark, sf), t, _league(t), fb.Config(compat=True)), _OPP)


_CV = [c for c in fb.COHORT_STATS if c in td.BOX]


@query("cohort_regressed_volume", "FB7 WN7", f"""WITH {FEATURES},
k AS (SELECT *, CAST(coalesce(CASE WHEN depth_rank IS NOT NULL THEN least(depth_rank, 3) END, 9) AS INTEGER) AS r FROM fh),
m AS (SELECT position, r, season, {", ".join(f"sum({c}) / count(*) AS {c}" for c in _CV)} FROM k GROUP BY 1, 2, 3),
e AS (SELECT position, r, season, {", ".join(f"avg({c}) OVER w AS p_{c}" for c in _CV)} FROM m WINDOW w AS (PARTITION BY position, r ORDER BY season ROWS BETWEEN {_PRE}))
SELECT k.game_id, k.gsis_id, {", ".join(f"{steady_sql(f'(coalesce(f_career_{c}, 0) * f_games_prior + coalesce(p_{c}, f_career_{c}, 0) * 6.0E0) / (f_games_prior + 6.0E0)')} AS f_marcel_{c}" for c in _CV)}
FROM k JOIN e ON k.position = e.position AND k.r = e.r AND k.season = e.season""")
def _(spark, sf):
    h = fb.cohort_volume(fb.entity_block(rank_cap(td.panel(spark, sf)), _LITERAL))
    return _r8(h, [f"f_marcel_{c}" for c in _CV])


@query("role_divergence_block", "FB8", f"""WITH {FEATURES},
k AS (SELECT *, CAST(coalesce(CASE WHEN depth_rank IS NOT NULL THEN least(depth_rank, 3) END, -1) AS INTEGER) AS r FROM fh),
m AS (SELECT position, r, season, avg(f_career_off_snaps) AS u FROM k WHERE f_career_off_snaps IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT position, r, season, avg(u) OVER (PARTITION BY position, r ORDER BY season ROWS BETWEEN {_PRE}) AS norm FROM m)
SELECT k.game_id, k.gsis_id, {steady_sql('f_career_off_snaps / nullif(norm, 0)')} AS f_usage_vs_rank, CASE WHEN f_career_off_snaps / nullif(norm, 0) < 0.6 THEN 1.0E0 ELSE 0.0E0 END AS f_role_promoted
FROM k LEFT JOIN e ON k.position = e.position AND k.r = e.r AND k.season = e.season""")
def _(spark, sf):
    h = fb.role_change(fb.entity_block(rank_cap(td.panel(spark, sf)), _LITERAL))
    return h.select("game_id", "gsis_id", steady(F.col("f_usage_vs_rank")).alias("f_usage_vs_rank"), "f_role_promoted")


@query("lagged_scheme_block", "FB9 AG14 JN13", f"""WITH {td.PANEL}, {SCHEME}, m AS (SELECT season, {", ".join(f"avg({c}) AS m_{c}" for c in fb.SCHEME_RATES)} FROM scheme GROUP BY season),
r AS (SELECT s.season + 1 AS season, def_team, {", ".join(f"{c} / nullif(m_{c}, 0) AS {c}" for c in fb.SCHEME_RATES)} FROM scheme s JOIN m ON s.season = m.season)
SELECT game_id, gsis_id, {", ".join(f"{steady_sql('r.' + c)} AS f_sch_{c}" for c in fb.SCHEME_RATES)} FROM panel p LEFT JOIN r ON r.season = p.season AND r.def_team = p.opponent_team""")
def _(spark, sf):
    t = ag.scheme_rates(td.plays(spark, sf))
    h = fb.reference_block(td.panel(spark, sf), t, fb.SCHEME_RATES, {"opponent_team": "def_team"}, "f_sch_")
    return _r8(h, [f"f_sch_{c}" for c in fb.SCHEME_RATES])


@query("lagged_crew_block", "FB10 AG11", f"""WITH {td.PANEL}, {CREW}, m AS (SELECT season, {", ".join(f"avg({c}) AS m_{c}" for c in fb.CREW_RATES)} FROM crew GROUP BY season),
r AS (SELECT s.season + 1 AS season, referee, {", ".join(f"{c} / nullif(m_{c}, 0) AS {c}" for c in fb.CREW_RATES)} FROM crew s JOIN m ON s.season = m.season)
SELECT game_id, gsis_id, {", ".join(f"{steady_sql('r.' + c)} AS f_{c}" for c in fb.CREW_RATES)} FROM panel p LEFT JOIN r ON r.season = p.season AND r.referee = p.team""")
def _(spark, sf):
    t = ag.crew_rates(td.plays(spark, sf).withColumn("referee", F.col("home_team")), "referee")
    p = td.panel(spark, sf).withColumn("referee", F.col("team"))
    h = fb.reference_block(p, t, fb.CREW_RATES, {"referee": "referee"}, "f_")
    return _r8(h, [f"f_{c}" for c in fb.CREW_RATES])


@query("feature_build", "FB15", f"""WITH {_TW}{_PAN}, k AS (SELECT * FROM panel)
SELECT p.game_id, p.gsis_id, count(*) OVER c AS f_games_prior, sum(targets) OVER c / nullif(count(*) OVER c, 0) AS f_career_targets,
 {steady_sql('p_off_plays')} AS f_team_prior_off_plays FROM panel p LEFT JOIN th ON p.game_id = th.game_id AND p.team = th.team
 WINDOW c AS (PARTITION BY gsis_id ORDER BY p.season, p.week, p.game_id ROWS BETWEEN {_PRE})""".replace(", k AS (SELECT * FROM panel)", ""))
def _(spark, sf):
    """All default blocks in one plan; three of its columns are compared."""
    t = _team(spark, sf)
    h = fb.build(rank_cap(td.panel(spark, sf)), t, _league(t), _LITERAL)
    return h.select("game_id", "gsis_id", "f_games_prior", "f_career_targets", steady(F.col("f_team_prior_off_plays")).alias("f_team_prior_off_plays"))
