"""Queries that read and write files of the given tables: overlays, snapshot histories, gated tables; ordered outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.operators import calibrate as cp
from pitpanel.plans import blocks as fb
from pitpanel.plans import project as pj
from pitpanel.queries import blocks as bq, query, steady, steady_sql
from pitpanel.queries.blocks import _LITERAL, _league, _team
from pitpanel.queries.calibration import _APPLY, with_availability
from pitpanel.session import materialise, scratch_path
from pitpanel.sources import feeds, groups, sinks, tables


@query("csv_overlay_scan", "SRC7", """SELECT CAST(s_suppkey AS BIGINT) AS stadium_id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey * 10.5E0 END AS altitude_m FROM supplier""")
def _(spark, sf):
    """A curated CSV written from suppliers and read under a stated schema; cells that are no number are null."""
    path = scratch_path(spark, "overlay")
    s = td.table(spark, sf, "supplier").select(
        "s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 == 0, "n/a").otherwise((F.col("s_suppkey") * 10.5).cast("string")).alias("altitude")
    )
    s.write.option("header", True).csv(path)
    return tables.csv_overlay(spark, path, "stadium_id long, name string, altitude_m double")


SNAPSHOT_ROWS = 5_000


@query("snapshot_history_scan", "SRC10 SF24", f"""WITH {td.EVENTS}
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS scraped_at, 'User ' || CAST(user_id AS VARCHAR) AS player, event_type AS stat, k + 0.5E0 AS line,
 CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start_at FROM ev""")
def _(spark, sf):
    """JSON files of events by day, as a feed keeps its revisions, read back with their text timestamps.

    A day's events are dealt over as many files as keep each under SNAPSHOT_ROWS on average, so no value grows with the day.
    A folder per (day, part) keeps every JSON text in a file of its own: a task may hold several texts of a day.
    """
    path = scratch_path(spark, "snapshots")
    days = td.events(spark, sf).groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    files = -(-(days.agg(F.max("n")).first()[0] or 1) // SNAPSHOT_ROWS)
    e = td.events(spark, sf).select(F.to_date("ts").alias("day"), F.pmod(F.xxhash64("event_id"), F.lit(files)).alias("part"), F.to_json(F.struct(
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("player"), F.col("event_type").alias("stat"),
        (F.col("k") + 0.5).cast("string").alias("line"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startTimeIso"),
    )).alias("prop"))
    files = e.groupBy("day", "part").agg(F.collect_list("prop").alias("props")).select(
        "day", "part", F.concat(F.lit('{"scrapedAt":"'), F.date_add("day", 1).cast("string"), F.lit('T00:00:00Z","props":['), F.array_join("props", ","), F.lit("]}")).alias("value")
    )
    files.write.partitionBy("day", "part").text(path)
    p = feeds.snapshot_props(tables.json_snapshots(spark, path), "scraped", "payload")
    return p.select(F.col("scraped_at").cast("timestamp_ntz").alias("scraped_at"), "player", "stat", "line", F.col("start_at").cast("timestamp_ntz").alias("start_at"))


@query("gated_availability_table", "CP3 SNK2", f"""WITH {_APPLY}, per AS (SELECT season, week, team, sum(p_play) AS p, sum(CASE WHEN appeared THEN 1.0E0 ELSE 0.0E0 END) AS a FROM ap2 GROUP BY 1, 2, 3),
g AS (SELECT abs(avg(p) / avg(a) - 1) <= 0.05 AS ok FROM per)
SELECT season, team, count(*) AS n FROM ap2, g WHERE g.ok GROUP BY 1, 2""")
def _(spark, sf):
    """The table is written only if expected and observed appearances agree; a failed gate leaves no rows."""
    path = scratch_path(spark, "gated")
    df = with_availability(spark, sf)
    try:
        cp.sum_gate(df, ["season", "week", "team"])
        sinks.gate_then_write(df.select("season", "team", "gsis_id", "p_play"), path, True, "")
        kept = sinks.read_latest(spark, path)
    except (cp.GateError, sinks.GateError):
        kept = df.where("false")
    return kept.groupBy("season", "team").agg(F.count(F.lit(1)).alias("n"))


@query("ordered_roster", "SO7", f"""WITH {td.PANEL}, r AS (SELECT DISTINCT team, position, gsis_id FROM panel)
SELECT team, position, gsis_id, CAST(coalesce(list_position(['QB', 'RB', 'FB', 'WR', 'TE', 'K'], position), 7) AS INTEGER) AS place FROM r ORDER BY team, place, gsis_id""")
def _(spark, sf):
    r = td.panel(spark, sf).select("team", "position", "gsis_id").distinct()
    place = F.coalesce(pj.roster_order(F.col("position")), F.lit(7)).cast("int")
    return r.withColumn("place", place).orderBy("team", "place", "gsis_id")


def _every_feature_sql() -> str:
    """The blocks' SQL side by side: entity windows, posteriors, rival and cohort, group and rival."""
    vol = [*bq._VOL, *[c for c in fb.ZONE_STATS if c in td.BOX]]
    s4, t7, r4 = fb.ALLOWED_STATS, fb.TEAM_STATS, fb.RIVAL_STATS
    level = lambda p: f"{_LITERAL[p]}E0" if isinstance(p, str) else f"{p}E0"
    post = ", ".join(f"{steady_sql(bq._post(n, d, level(p)[:-2], fb.SHRINK_K[k]))} AS {name}" for name, (n, d, p, k) in {**fb.EFFICIENCY, **fb.SHARES}.items())
    dvp = ", ".join(f"{steady_sql(f'(s_{c} + p_{c} * 12.0E0) / (n + 12.0E0)')} AS f_dvp_{c}" for c in s4)
    team = ", ".join(f"{steady_sql('g.p_' + c)} AS f_team_prior_{c}, {steady_sql('g.q_' + c)} AS f_team_r4_{c}" for c in t7)
    centred = steady_sql("g.p_off_proe - (SELECT v FROM lg WHERE lg.season = (SELECT max(season) FROM lg x WHERE x.season < g.season))")
    opp = ", ".join(f"{steady_sql('o.o_' + c)} AS f_opp_prior_{c}" for c in r4)
    return f"""WITH {bq._TW}{bq._PAN}{bq._DVP[len(td.PANEL):]},
en AS (SELECT season, week, game_id, gsis_id, team, opponent_team, position, count(*) OVER c AS f_games_prior, count(*) OVER e AS f_games_prior_season,
  {", ".join(x for v in vol for x in bq._hist(v))}, {post} FROM panel {bq._WIN})
SELECT p.* EXCLUDE (team, opponent_team, position), {dvp}, {team}, {centred} AS f_team_proe_centered, {opp}
FROM en p JOIN aw ON p.game_id = aw.game_id AND p.opponent_team = aw.def_team AND p.position = aw.position AND p.season = aw.season AND p.week = aw.week
JOIN ep ON ep.position = p.position AND ep.season = p.season LEFT JOIN th g ON p.game_id = g.game_id AND p.team = g.team LEFT JOIN th o ON p.game_id = o.game_id AND p.opponent_team = o.team"""


@query("feature_build_all", "FB12 FB14 FB15 PF18 SO1", _every_feature_sql())
def _(spark, sf):
    """Every feature column of every default block and the zone counts, in event order."""
    from pitpanel.operators.shape import rank_cap

    t = _team(spark, sf)
    panel = rank_cap(materialise(td.panel(spark, sf), "panel"))
    return fb.build_in_order(panel, t, _league(t), _LITERAL, fb.Config(zone=True), finish=steady)


@query("tracking_scan", "SRC4", f"""WITH {td.PANEL}
SELECT season, week, count(*) AS n, count(ngs_avg_separation) AS filled FROM panel WHERE week < 4 GROUP BY season, week""")
def _(spark, sf):
    """A table of tracking rates by season, with season totals in week 0 and later rounds, read for its regular weeks alone."""
    root = scratch_path(spark, "tracking")
    p = td.panel(spark, sf).select("season", "week", "gsis_id", "ngs_avg_separation", F.when(F.col("week") < 4, "REG").otherwise("POST").alias("season_type"))
    totals = p.groupBy("season", "gsis_id").agg(F.max("ngs_avg_separation").alias("ngs_avg_separation")).withColumns({"week": F.lit(0).cast("bigint"), "season_type": F.lit("REG")})
    p.unionByName(totals).write.partitionBy("season").parquet(f"{root}/ngs_receiving")
    t = tables.Catalog(spark, root).tracking("receiving")
    return t.groupBy(F.col("season").cast("bigint").alias("season"), "week").agg(F.count(F.lit(1)).alias("n"), F.count("ngs_avg_separation").alias("filled"))


@query("advanced_scan", "SRC5", f"""WITH {td.PANEL}
SELECT season + 20 AS season, count(*) AS n, CAST(sum(targets) AS DOUBLE) AS targets FROM panel WHERE season + 20 IN (2018, 2019, 2021) AND week < 4 GROUP BY season""")
def _(spark, sf):
    """Advanced rates of some seasons, from the first covered one on; asking for an earlier one adds nothing."""
    root = scratch_path(spark, "advanced")
    p = td.panel(spark, sf).select((F.col("season") + 20).alias("season"), "gsis_id", "targets", F.when(F.col("week") < 4, "REG").otherwise("POST").alias("game_type"))
    p.write.partitionBy("season").parquet(f"{root}/pfr_rec")
    t = tables.Catalog(spark, root).advanced("rec", [2016, 2018, 2019, 2021])
    return t.groupBy(F.col("season").cast("bigint").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.sum("targets").alias("targets"))


@query("training_only_guard", "DQ11", f"""WITH {td.PANEL}, h AS (SELECT season, count(routes) OVER (PARTITION BY gsis_id ORDER BY season, week, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n
  FROM (SELECT *, CASE WHEN season < 2001 THEN targets END AS routes FROM panel))
SELECT 'f_career_routes_run_proxy' AS feature, season, count(*) AS n, count(CASE WHEN n > 0 THEN 1 END) AS filled FROM h GROUP BY season""")
def _(spark, sf):
    """Features built from a source that is published only after its season, and how many rows of each season they fill."""
    from pitpanel import contract
    from pitpanel.operators.ordered import Spec
    from pitpanel.operators.windows import history
    from pitpanel.roles import PLAYER_PANEL

    p = td.panel(spark, sf).withColumn("routes_run_proxy", F.when(F.col("season") < 2001, F.col("targets")))
    specs = [Spec("f_career_routes_run_proxy", "mean_present", "routes_run_proxy"), Spec("f_career_targets", "mean", "targets")]
    h = history(p, PLAYER_PANEL, specs)
    bad = contract.training_only_features(h.schema)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().alias("there")) for c in bad])
    return h.select("season", F.inline(rows)).groupBy("feature", "season").agg(F.count(F.lit(1)).alias("n"), F.count_if("there").alias("filled"))


_GROUP_VALUES = ", ".join(f"('{k}', '{c}', '{d}')" for k, (_, c, d) in groups.GROUPS.items())


@query("groups_dimension_join", "SRC11", f"""WITH g(team, conference, division) AS (VALUES {_GROUP_VALUES}), n AS (SELECT team, row_number() OVER (ORDER BY team) - 1 AS i FROM g)
SELECT g.conference, g.division, count(*) AS n_customers, CAST(sum(round(c_acctbal * 100)) AS DOUBLE) AS cents
FROM customer JOIN n ON n.i = c_custkey % 32 JOIN g USING (team) GROUP BY 1, 2""")
def _(spark, sf):
    """Customers dealt over the groups of the fixed dimension and summed per division."""
    from pyspark.sql import Window

    g = groups.groups_table(spark)
    g = g.withColumn("i", F.row_number().over(Window.orderBy("team")) - 1)  # 32 fixed rows
    c = td.table(spark, sf, "customer").withColumn("i", F.col("c_custkey") % 32)
    return c.join(F.broadcast(g), "i").groupBy("conference", "division").agg(
        F.count(F.lit(1)).alias("n_customers"), F.sum(F.round(F.col("c_acctbal") * 100)).cast("double").alias("cents")
    )
