"""Quality, contract, projection and sink queries."""

from pyspark.sql import functions as F

from pitpanel import contract, testdata as td
from pitpanel.operators import quality as dq
from pitpanel.operators.shape import rank_cap
from pitpanel.plans import blocks as fb, project as pj
from pitpanel.queries import query, steady, steady_sql
from pitpanel.queries.aggregates import SCORED, TEAM, scored, team_week
from pitpanel.queries.blocks import _PAN, _TW, FEATURES, _LITERAL
from pitpanel.queries.models import feature_panel
from pitpanel.session import materialise, scratch_path
from pitpanel.sources import sinks


_BUCKET = {
    "key": ["season", "week", "game_id", "team", "opponent_team", "gsis_id", "position"],
    "target": [c for c in td.BOX if c in contract.TARGETS],
    "same_game_exposure": ["off_snaps", "ngs_avg_separation", "carries_rz"],
    "same_game_team": ["off_pass_att", "off_designed_rush"],
    "pregame": ["depth_rank"],
}


@query("contract_bucket_profile", "DQ1 PF17", f"WITH {td.PANEL} " + " UNION ALL ".join(
    f"SELECT '{b}' AS bucket, CAST({len(c)} AS BIGINT) AS columns, " + " + ".join(f"count({x})" for x in c) + " AS filled FROM panel" for b, c in _BUCKET.items()
))
def _(spark, sf):
    """Filled cells per contract bucket; the buckets come from schema metadata."""
    df = contract.annotate(td.panel(spark, sf))
    buckets: dict[str, list[str]] = {}
    for c, bucket in contract.placed(df.schema):
        buckets.setdefault(bucket, []).append(c)
    one = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("bucket"), F.lit(len(cols)).cast("bigint").alias("columns"), sum((F.col(c) for c in cols[1:]), F.col(cols[0])).alias("filled"))
            for b, cols in buckets.items()
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


_PARITY = ["is_starter", "depth_rank_capped"]


@query("train_serve_parity", "DQ7 SE6", f"""WITH {td.PANEL}, h AS (SELECT season < 2001 AS past, CASE WHEN depth_rank = 1 THEN 1.0E0 ELSE 0.0E0 END AS is_starter, CASE WHEN depth_rank IS NOT NULL THEN least(depth_rank, 3) END AS depth_rank_capped FROM panel)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN past THEN CASE WHEN {c} IS NOT NULL THEN 1.0E0 ELSE 0.0E0 END END) AS filled_history, "
    f"avg(CASE WHEN NOT past THEN CASE WHEN {c} IS NOT NULL THEN 1.0E0 ELSE 0.0E0 END END) AS filled_serving FROM h" for c in _PARITY
))
def _(spark, sf):
    """Fill rates of derived pregame columns in history and in the serving era."""
    h = rank_cap(td.panel(spark, sf))
    cols = [c for c in contract.columns_in(contract.annotate(h).schema) if c in _PARITY]
    past = F.col("season") < 2001
    one = h.agg(
        *[F.avg(F.when(past, F.col(c).isNotNull().cast("double"))).alias(f"h_{c}") for c in cols],
        *[F.avg(F.when(~past, F.col(c).isNotNull().cast("double"))).alias(f"s_{c}") for c in cols],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"h_{c}").alias("filled_history"), F.col(f"s_{c}").alias("filled_serving")) for c in cols])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("key_uniqueness", "DQ2", f"""WITH {TEAM}, d AS (SELECT game_id, team FROM tw GROUP BY 1, 2 HAVING count(*) > 1),
e AS (SELECT game_id, gsis_id FROM panel GROUP BY 1, 2 HAVING count(*) > 1), pd AS (SELECT game_id, play_id FROM plays GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'team events' AS "check", (SELECT count(*) FROM d) = 0 AS ok, (SELECT count(*) FROM d) AS violations
UNION ALL SELECT 'plays', (SELECT count(*) FROM pd) = 0, (SELECT count(*) FROM pd)""".replace("e AS (SELECT game_id, gsis_id FROM panel GROUP BY 1, 2 HAVING count(*) > 1), ", ""))
def _(spark, sf):
    return dq.key_unique(team_week(spark, sf), ["game_id", "team"], "team events").unionByName(
        dq.key_unique(td.plays(spark, sf), ["game_id", "play_id"], "plays")
    )


@query("row_count_against_schedule", "DQ3", f"""WITH {TEAM}, g AS (SELECT DISTINCT game_id FROM plays)
SELECT 'team events' AS "check", (SELECT count(*) FROM tw) = 2 * (SELECT count(*) FROM g) AS ok, (SELECT count(*) FROM tw) AS rows, CAST(2 * (SELECT count(*) FROM g) AS BIGINT) AS expected""")
def _(spark, sf):
    games = td.plays(spark, sf).select("game_id").distinct()
    return dq.row_count(team_week(spark, sf), games, 2, "team events")


@query("orphan_check", "DQ4", f"""WITH {TEAM}{td.PANEL[len(td.PLAYS):]}
SELECT 'panel without team row' AS "check", count(*) = 0 AS ok, count(*) AS violations FROM panel p WHERE NOT EXISTS (SELECT 1 FROM tw WHERE tw.game_id = p.game_id AND tw.team = p.team)""")
def _(spark, sf):
    return dq.orphans(td.panel(spark, sf), team_week(spark, sf), ["game_id", "team"], "panel without team row")


@query("bound_checks", "DQ6", f"""WITH {td.PANEL}, c AS (SELECT count(CASE WHEN targets < 0 THEN 1 END) AS a, count(CASE WHEN carries < 0 THEN 1 END) AS b, count(CASE WHEN receptions > targets THEN 1 END) AS c, count(CASE WHEN completions > attempts THEN 1 END) AS d FROM panel)
SELECT 'targets >= 0' AS "check", a = 0 AS ok, a AS violations FROM c UNION ALL SELECT 'carries >= 0', b = 0, b FROM c
UNION ALL SELECT 'receptions <= targets', c = 0, c FROM c UNION ALL SELECT 'completions <= attempts', d = 0, d FROM c""")
def _(spark, sf):
    rules = dq.count_rules(["targets", "carries"], [("receptions", "targets"), ("completions", "attempts")])
    return dq.bounds(td.panel(spark, sf), rules)


@query("constant_column_check", "DQ8 PF7", f"""WITH {td.PANEL}
SELECT season, c AS "column", lo <> hi AS varies, ns AS null_share, (lo <> hi AND ns <= 0.05) AS ok FROM (
 SELECT season, 'position' AS c, min(position) AS lo, max(position) AS hi, avg(CASE WHEN position IS NULL THEN 1.0E0 ELSE 0.0E0 END) AS ns FROM panel GROUP BY season
 UNION ALL SELECT season, 'depth_rank', CAST(min(depth_rank) AS VARCHAR), CAST(max(depth_rank) AS VARCHAR), avg(CASE WHEN depth_rank IS NULL THEN 1.0E0 ELSE 0.0E0 END) FROM panel GROUP BY season)""")
def _(spark, sf):
    return dq.varies(td.panel(spark, sf), ["position", "depth_rank"], ["season"])


@query("missingness_leak_scan", "DQ9", f"""WITH {td.PANEL}
SELECT 'ngs_avg_separation' AS "column", avg(CASE WHEN targets = 0 THEN CASE WHEN ngs_avg_separation IS NULL THEN 1.0E0 ELSE 0.0E0 END END) AS null_if_zero,
 avg(CASE WHEN targets > 0 THEN CASE WHEN ngs_avg_separation IS NULL THEN 1.0E0 ELSE 0.0E0 END END) AS null_if_positive FROM panel
UNION ALL SELECT 'depth_rank', avg(CASE WHEN targets = 0 THEN CASE WHEN depth_rank IS NULL THEN 1.0E0 ELSE 0.0E0 END END), avg(CASE WHEN targets > 0 THEN CASE WHEN depth_rank IS NULL THEN 1.0E0 ELSE 0.0E0 END END) FROM panel""")
def _(spark, sf):
    return dq.missingness_leak(td.panel(spark, sf), "targets", ["ngs_avg_separation", "depth_rank"])


@query("self_correlation_scan", "DQ10", f"""WITH {FEATURES}
SELECT 'f_career_targets' AS feature, {steady_sql('corr(f_career_targets, targets)')} AS corr, abs(corr(f_career_targets, targets)) < 0.8 AS ok FROM fh
UNION ALL SELECT 'f_r3_targets', {steady_sql('corr(f_r3_targets, targets)')}, abs(corr(f_r3_targets, targets)) < 0.8 FROM fh""")
def _(spark, sf):
    s = dq.self_correlation(feature_panel(spark, sf), "targets", ["f_career_targets", "f_r3_targets"])
    return s.withColumn("corr", steady(F.col("corr")))


@query("coherence_bands", "DQ12 AG22 AG23", f"""WITH {td.PANEL}, t AS (SELECT team, season, sum(receptions) AS e, sum(targets) AS a, max(receptions) / nullif(sum(receptions), 0) AS mt, max(targets) / nullif(sum(targets), 0) AS act FROM panel GROUP BY 1, 2),
r AS (SELECT sum(e) / sum(a) AS x, avg(mt) / (avg(act) * ({dq.ORACLE_TOP_SHARE['targets']!r})) AS y FROM t)
SELECT 'targets within 20%' AS "check", abs(x - 1) <= 0.2 AS ok, {steady_sql('x')} AS ratio FROM r UNION ALL SELECT 'targets top share', abs(y - 1) <= 0.25, {steady_sql('y')} FROM r""")
def _(spark, sf):
    t = td.panel(spark, sf).groupBy("team", "season").agg(
        F.sum("receptions").alias("expected"), F.sum("targets").alias("actual"),
        (F.max("receptions") / F.nullif(F.sum("receptions"), F.lit(0.0))).alias("model_top"),
        (F.max("targets") / F.nullif(F.sum("targets"), F.lit(0.0))).alias("actual_top"),
    )
    out = dq.coherence(t, "targets").unionByName(dq.concentration_band(t, "targets"))
    return out.withColumn("ratio", steady(F.col("ratio")))


@query("pairedness_checks", "DQ13", f"""WITH {SCORED}, a AS (SELECT avg(CASE WHEN abs_err_model IS NULL OR abs_err_b2 IS NULL THEN 1.0E0 ELSE 0.0E0 END) AS u, count(CASE WHEN abs(abs_err_model - abs(pred - actual)) > 1e-9 THEN 1 END) AS w FROM scored),
d AS (SELECT coalesce(sum(n - 1), 0) AS d FROM (SELECT count(*) AS n FROM scored GROUP BY game_id, gsis_id, target HAVING count(*) > 1))
SELECT 'unpaired share <= 1 %' AS "check", u <= 0.01 AS ok, u AS value FROM a UNION ALL SELECT 'no duplicate scorings', d = 0, CAST(d AS DOUBLE) FROM d
UNION ALL SELECT 'error is |pred - actual|', w = 0, CAST(w AS DOUBLE) FROM a""")
def _(spark, sf):
    return dq.pairedness(scored(spark, sf), ["game_id", "gsis_id", "target"])


@query("coverage_by_cohort", "DQ14", f"""WITH {td.PANEL} SELECT position, count(*) AS n, avg(CASE WHEN depth_rank IS NOT NULL THEN 1.0E0 ELSE 0.0E0 END) AS share_depth_rank,
 avg(CASE WHEN ngs_avg_separation IS NOT NULL THEN 1.0E0 ELSE 0.0E0 END) AS share_ngs_avg_separation FROM panel GROUP BY position""")
def _(spark, sf):
    return dq.coverage(td.panel(spark, sf), ["position"], ["depth_rank", "ngs_avg_separation"])


@query("latest_roster_rows", "SRC6 SO5", f"""WITH {td.PANEL}, r AS (SELECT season, team, gsis_id, depth_rank, position, row_number() OVER (PARTITION BY season, team, week, gsis_id ORDER BY game_id DESC, depth_rank DESC) AS rn, week FROM panel)
SELECT season, CAST(week AS INTEGER) AS week, team, gsis_id, position, depth_rank FROM r WHERE rn = 1""")
def _(spark, sf):
    snaps = td.panel(spark, sf).select(
        "season", "week", "team", "gsis_id", F.col("position").alias("pos_abb"), F.col("depth_rank").alias("pos_rank"), F.col("game_id").alias("dt")
    )
    return pj.roster_normalized(snaps)


_GAMES = f"""gm AS (SELECT DISTINCT game_id, season, week, home_team, away_team, 40.0E0 + week AS total_line, week - 2.5E0 AS spread_line, 7.0E0 AS home_rest, 6.0E0 AS away_rest FROM plays WHERE season = 2001)"""


@query("inference_row_construction", "FB16 PF9 PF11 PF6 JN19", f"""WITH {td.PANEL}, {_GAMES},
r AS (SELECT team, gsis_id, position, depth_rank FROM (SELECT team, gsis_id, position, depth_rank, row_number() OVER (PARTITION BY team, gsis_id ORDER BY season DESC, week DESC, game_id DESC) AS rn FROM panel WHERE season < 2001) WHERE rn = 1),
l AS (SELECT *, home_team AS team, away_team AS opp, 1 AS is_home FROM gm UNION ALL SELECT *, away_team, home_team, 0 FROM gm)
SELECT game_id, gsis_id, team, opp AS opponent_team, is_home, CASE is_home WHEN 1 THEN total_line / 2 + spread_line / 2 ELSE total_line / 2 - spread_line / 2 END AS team_implied_total,
 CASE is_home WHEN 1 THEN -spread_line ELSE spread_line END AS team_spread, CASE is_home WHEN 1 THEN 7.0E0 ELSE 6.0E0 END AS rest_days,
 CASE WHEN depth_rank IS NOT NULL THEN least(depth_rank, 3) END AS depth_rank_capped, CASE WHEN depth_rank = 1 THEN 1.0E0 ELSE 0.0E0 END AS is_starter,
 CASE gsis_id % 3 WHEN 0 THEN 3.0E0 ELSE 0.0E0 END AS injury_severity FROM l JOIN r USING (team)""")
def _(spark, sf):
    return _future(spark, sf).select(
        "game_id", "gsis_id", "team", "opponent_team", "is_home", "team_implied_total", "team_spread", "rest_days",
        "depth_rank_capped", "is_starter", "injury_severity",
    )


def _future(spark, sf, panel=None):
    from pitpanel.operators.windows import latest

    g = td.plays(spark, sf).where("season = 2001").selectExpr(
        "game_id", "season", "week", "home_team", "away_team", "40.0D + week AS total_line", "week - 2.5D AS spread_line",
        "7.0D AS home_rest", "6.0D AS away_rest",
    ).distinct()
    past = (td.panel(spark, sf) if panel is None else panel).where("season < 2001").select("team", "gsis_id", "position", "season", "week", "game_id", "depth_rank")
    roster = latest(past, ["team", "gsis_id"], ["season", "week", "game_id"]).select("team", "gsis_id", "position", "depth_rank")
    inj = td.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("gsis_id"), F.when(F.col("s_suppkey") % 3 == 0, "Out").alias("report_status"), F.lit(None).cast("string").alias("practice_status")
    )
    return pj.inference_rows(g, roster, inj, None)


def _projected_sql() -> str:
    """Every feature of every future row, by aggregates over the rows before its own period."""
    vol = [c for c in fb.VOLUME_STATS if c in td.BOX]
    mean = lambda c, some="": f"sum({c}) FILTER (p_game IS NOT NULL{some}) / nullif(count(*) FILTER (p_game IS NOT NULL{some}), 0)"
    ent = ["count(p_game) AS f_games_prior", "count(*) FILTER (p_season = 2001) AS f_games_prior_season"]
    for c in vol:
        ent += [f"{mean(c)} AS f_career_{c}", *[f"{mean(c, f' AND rn <= {w}')} AS f_r{w}_{c}" for w in (3, 8)], f"{mean(c, ' AND p_season = 2001')} AS f_std_{c}"]
    for name, (n, d, p, k) in {**fb.EFFICIENCY, **fb.SHARES}.items():
        level = _LITERAL[p] if isinstance(p, str) else p
        ent.append(f"{steady_sql(f'(coalesce(sum({n}), 0.0E0) + {fb.SHRINK_K[k]}E0 * {level}E0) / (coalesce(sum({d}), 0.0E0) + {fb.SHRINK_K[k]}E0)')} AS {name}")
    stats = sorted({*vol, *[c for n, d, *_ in [*fb.EFFICIENCY.values(), *fb.SHARES.values()] for c in (n, d)]})
    s4, t7, r4 = fb.ALLOWED_STATS, fb.TEAM_STATS, fb.RIVAL_STATS
    dvp = ", ".join(f"{steady_sql(f'(coalesce(sum(al.{c}), 0.0E0) + (SELECT avg(v.{c}) FROM em v WHERE v.position = a.position AND v.season < 2001) * 12.0E0) / (count(al.game_id) + 12.0E0)')} AS f_dvp_{c}" for c in s4)
    zero = lambda c, some="": f"avg(coalesce({c}, 0.0E0)) FILTER (p_game IS NOT NULL{some})"
    team = ", ".join(f"{steady_sql(zero(c))} AS f_team_prior_{c}, {steady_sql(zero(c, ' AND rn <= 4'))} AS f_team_r4_{c}" for c in t7)
    opp = ", ".join(f"{steady_sql(zero(c))} AS f_opp_prior_{c}" for c in r4)
    return f"""WITH {_TW}{_PAN}, {_GAMES},
r AS (SELECT team, gsis_id, position, depth_rank FROM (SELECT team, gsis_id, position, depth_rank, row_number() OVER (PARTITION BY team, gsis_id ORDER BY season DESC, week DESC, game_id DESC) AS rn FROM panel WHERE season < 2001) WHERE rn = 1),
l AS (SELECT game_id, week, home_team AS team, away_team AS opp FROM gm UNION ALL SELECT game_id, week, away_team, home_team FROM gm),
fu AS (SELECT game_id, week, gsis_id, team, opp, position FROM l JOIN r USING (team)),
ea AS (SELECT DISTINCT gsis_id, week FROM fu),
eh AS (SELECT a.gsis_id, a.week, p.season AS p_season, p.game_id AS p_game, {", ".join(f"p.{c}" for c in stats)}, row_number() OVER (PARTITION BY a.gsis_id, a.week ORDER BY p.season DESC, p.week DESC, p.game_id DESC) AS rn
 FROM ea a LEFT JOIN panel p ON p.gsis_id = a.gsis_id AND (p.season < 2001 OR (p.season = 2001 AND p.week < a.week))),
eg AS (SELECT gsis_id, week, {", ".join(ent)} FROM eh GROUP BY 1, 2),
al AS (SELECT season, week, game_id, opponent_team AS def_team, position, {", ".join(f"sum({c}) AS {c}" for c in s4)} FROM panel GROUP BY 1, 2, 3, 4, 5),
em AS (SELECT position, season, {", ".join(f"sum({c}) / count(*) AS {c}" for c in s4)} FROM al GROUP BY 1, 2),
da AS (SELECT DISTINCT opp, position, week FROM fu),
dg AS (SELECT a.opp, a.position, a.week, {dvp} FROM da a LEFT JOIN al ON al.def_team = a.opp AND al.position = a.position AND (al.season < 2001 OR (al.season = 2001 AND al.week < a.week)) GROUP BY 1, 2, 3),
ta AS (SELECT DISTINCT team, week FROM l),
tg AS (SELECT a.team, a.week, tj.game_id AS p_game, {", ".join(f"tj.{c}" for c in [*t7, *r4])}, row_number() OVER (PARTITION BY a.team, a.week ORDER BY tj.season DESC, tj.week DESC, tj.game_id DESC) AS rn
 FROM ta a LEFT JOIN tj ON tj.team = a.team AND (tj.season < 2001 OR (tj.season = 2001 AND tj.week < a.week))),
tn AS (SELECT team, week, {team}, {steady_sql(zero('off_proe') + ' - (SELECT v FROM lg WHERE season = 2000)')} AS f_team_proe_centered FROM tg GROUP BY 1, 2),
tq AS (SELECT team, week, {opp} FROM tg GROUP BY 1, 2)
SELECT fu.game_id, fu.gsis_id, eg.* EXCLUDE (gsis_id, week), dg.* EXCLUDE (opp, position, week), tn.* EXCLUDE (team, week), tq.* EXCLUDE (team, week)
FROM fu JOIN eg ON eg.gsis_id = fu.gsis_id AND eg.week = fu.week JOIN dg ON dg.opp = fu.opp AND dg.position = fu.position AND dg.week = fu.week
 JOIN tn ON tn.team = fu.team AND tn.week = fu.week JOIN tq ON tq.team = fu.opp AND tq.week = fu.week"""


_EXACT = ("f_games", "f_career_", "f_r3_", "f_r8_", "f_std_")


@query("project_future_period", "FB15 FB16 JN20 SNK7", _projected_sql())
def _(spark, sf):
    """Every feature of every period of the last era from the history before it; unplayed rows add nothing to one another."""
    from pitpanel.operators import aggregates as ag

    t = materialise(ag.with_rival_side(materialise(team_week(spark, sf), "team-own")), "team")
    league = t.groupBy("season").agg(F.avg("off_proe").alias("league_off_proe"))
    panel = materialise(td.panel(spark, sf), "panel")
    live = pj.project(panel, _future(spark, sf, panel), t, league, _LITERAL)
    return live.select("game_id", "gsis_id", *[F.col(c) if c.startswith(_EXACT) else steady(F.col(c)).alias(c) for c in live.columns if c.startswith("f_")])


@query("versioned_upsert_sink", "SNK1 SNK3 SNK5", """SELECT o_custkey, o_orderkey, o_totalprice FROM (
 SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def _(spark, sf):
    """Two upserts into a versioned table, then a refused empty refresh."""
    from pitpanel.operators.windows import latest

    o = td.table(spark, sf, "orders")
    best = latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    path = scratch_path(spark, "upsert")
    older = latest(o.where("o_orderdate < '1999-01-01'"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    sinks.upsert_latest(older, path, ["o_custkey"])
    sinks.upsert_latest(best, path, ["o_custkey"])
    assert not sinks.guarded_write(best.limit(0), path)
    return sinks.read_latest(spark, path).select("o_custkey", "o_orderkey", "o_totalprice")


@query("resumed_incremental_build", "SNK4 JN12", """SELECT c_custkey, c_acctbal, CASE WHEN c_nationkey < 10 THEN 'first' ELSE 'second' END AS built FROM customer""")
def _(spark, sf):
    c = td.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    path = scratch_path(spark, "resume")
    sinks.resume_write(c.where("c_nationkey < 10"), lambda d: d.withColumn("built", F.lit("first")), path, ["c_custkey"])
    sinks.resume_write(c, lambda d: d.withColumn("built", F.lit("second")), path, ["c_custkey"])
    return sinks.read_latest(spark, path).select("c_custkey", "c_acctbal", "built")


@query("keyed_store_writes", "SNK4 SNK5", """SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderdate >= '1999-01-01' THEN 'new' ELSE 'old' END AS built FROM (
 SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
 UNION ALL SELECT c_custkey, NULL, NULL, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(spark, sf):
    """Two upserts into hash buckets under a manifest, then the customers that the table lacks."""
    from pitpanel.sources import keyed

    o = td.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    o = o.withColumn("built", F.when(F.col("o_orderdate") >= "1999-01-01", "new").otherwise("old"))
    path = scratch_path(spark, "keyed")
    for some in (o.where("built = 'old'"), o.where("built = 'new'")):
        keyed.upsert(some, path, ["o_custkey"], ["o_orderdate", "o_orderkey"], buckets=16)
    every = td.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    keyed.add_missing(every, path, ["o_custkey"], lambda d: d.withColumn("built", F.lit("none")))
    return keyed.read(spark, path).select("o_custkey", "o_orderkey", "o_totalprice", "built")


@query("board_save_by_period", "SNK6 WN14", f"""WITH {td.EVENTS}, l AS (SELECT event_id, concat('user ', user_id) AS name, event_type AS stat_type, CASE WHEN k % 3 = 0 THEN 'standard' ELSE 'demon' END AS odds_type, ts, 2024 AS season, CAST(day(ts) AS INTEGER) AS week FROM ev)
SELECT season, week, event_id FROM (SELECT *, row_number() OVER (PARTITION BY season, week, name, stat_type ORDER BY CASE odds_type WHEN 'standard' THEN 0 ELSE 1 END, CASE WHEN event_id < 5000 THEN 0 ELSE 1 END DESC, ts DESC, event_id DESC) AS rn FROM l) WHERE rn = 1""")
def _(spark, sf):
    e = td.events(spark, sf).select(
        "event_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("stat_type"),
        F.when(F.col("k") % 3 == 0, "standard").otherwise("demon").alias("odds_type"), "ts", F.lit(2024).alias("season"), F.dayofmonth("ts").alias("week"),
    )
    path = scratch_path(spark, "board")
    sinks.save_board(e.where("event_id < 5000"), path, ["ts", "event_id"])
    sinks.save_board(e.where("event_id >= 5000"), path, ["ts", "event_id"])
    return spark.read.parquet(path).select("season", "week", "event_id")


@query("registered_table_scans", "SRC1 SRC2 SRC3", """SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1999 GROUP BY 1""")
def _(spark, sf):
    """A fact written by season and read back through its coverage floor."""
    from pitpanel.sources.tables import Catalog

    root = scratch_path(spark, "catalog")
    o = td.table(spark, sf, "orders").withColumn("season", F.year("o_orderdate"))
    o.repartition("season").write.partitionBy("season").parquet(f"{root}/pbp")
    return Catalog(spark, root).fact("pbp").groupBy("season").agg(F.count(F.lit(1)).alias("n"))
