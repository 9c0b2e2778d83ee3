"""Join queries."""

from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.operators import joins as jn
from pitpanel.operators import windows as wn
from pitpanel.operators.aggregates import league_context
from pitpanel.queries import query
from pitpanel.queries.aggregates import CREW, SCHEME, TEAM, team_week
from pitpanel.sources.groups import ALIASES, canonical


@query("left_join_composite_key", "JN1", f"""WITH {td.PANEL}, c AS (SELECT game_id, posteam AS team, max(yards_gained) AS longest FROM plays WHERE play_type = 'run' GROUP BY 1, 2)
SELECT p.game_id, p.gsis_id, longest FROM panel p LEFT JOIN c ON p.game_id = c.game_id AND p.team = c.team""")
def _(spark, sf):
    c = td.plays(spark, sf).where("play_type = 'run'").groupBy("game_id", F.col("posteam").alias("team")).agg(
        F.max("yards_gained").alias("longest")
    )
    return td.panel(spark, sf).join(c, ["game_id", "team"], "left").select("game_id", "gsis_id", "longest")


@query("alternate_id_join", "JN5 SRC2", """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS old_game_id, o_orderpriority AS referee FROM orders WHERE o_orderstatus = 'F')
SELECT l_orderkey, l_linenumber, referee FROM lineitem LEFT JOIN r ON CAST(l_orderkey AS VARCHAR) = old_game_id""")
def _(spark, sf):
    o = td.table(spark, sf, "orders").where("o_orderstatus = 'F'")
    ref = o.select(F.col("o_orderkey").cast("string").alias("old_game_id"), F.col("o_orderpriority").alias("referee"))
    li = td.table(spark, sf, "lineitem").withColumn("old_game_id", F.col("l_orderkey").cast("string"))
    return li.join(ref, "old_game_id", "left").select("l_orderkey", "l_linenumber", "referee")


_VIEWS = f"""WITH {td.EVENTS}, s AS (SELECT * FROM ev WHERE event_type <> 'purchase'), g AS (SELECT * FROM ev WHERE event_type = 'purchase')"""
_ASOF_SQL = f"""{_VIEWS}
SELECT s.event_id, g.event_id AS next_id, g.ts AS kickoff FROM s ASOF LEFT JOIN g ON s.user_id = g.user_id AND s.ts <= g.ts"""


def _snapshots(spark, sf):
    e = td.events(spark, sf)
    return e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'")


def _asof(spark, sf, hot_rows=None):
    s, g = _snapshots(spark, sf)
    out = jn.asof(
        s.select("event_id", "user_id", "ts"), g.select("event_id", "user_id", "ts"), ["user_id"], "ts", "ts",
        {"event_id": "next_id", "ts": "kickoff"}, "event_id", "forward", False, hot_rows,
    )
    return out.select("event_id", "next_id", "kickoff")


@query("asof_forward_by_group", "JN7", _ASOF_SQL)
def _(spark, sf):
    return _asof(spark, sf)


@query("asof_forward_split_runs", "JN7", _ASOF_SQL)
def _(spark, sf):
    """Every user's timeline is cut into runs of at most 20 rows."""
    return _asof(spark, sf, hot_rows=20)


_NEAR_SQL = f"""{_VIEWS},
b AS (SELECT s.event_id, g.event_id AS bid, epoch_us(s.ts) - epoch_us(g.ts) AS bg FROM s ASOF LEFT JOIN g ON s.event_type <> g.event_type AND s.ts >= g.ts),
f AS (SELECT s.event_id, g.event_id AS fid, epoch_us(g.ts) - epoch_us(s.ts) AS fg FROM s ASOF LEFT JOIN g ON s.ts <= g.ts)
SELECT event_id, CASE WHEN fg IS NULL OR bg <= fg THEN CASE WHEN bg <= 600000000 THEN bid END ELSE CASE WHEN fg <= 600000000 THEN fid END END AS game
FROM b JOIN f USING (event_id)""".replace("s.event_type <> g.event_type AND ", "")


@query("asof_nearest_with_tolerance", "JN8", _NEAR_SQL)
def _(spark, sf):
    """No grouping key: the single timeline is cut into runs, tolerance ten minutes."""
    s, g = _snapshots(spark, sf)
    one = F.lit(0).alias("__all")
    out = jn.asof_nearest(
        s.select("event_id", "ts", one), g.select("event_id", "ts", one), ["__all"], "ts", "ts",
        {"event_id": "game"}, "event_id", 600_000_000, hot_rows=1000,
    )
    return out.select("event_id", "game")


_MODE_SQL = f"""WITH {td.EVENTS},
c AS (SELECT e.event_id, day(g.ts) AS period, count(*) AS n FROM ev e JOIN ev g ON g.event_type = 'purchase'
  AND abs(epoch_us(e.ts) - epoch_us(g.ts)) < 21600000000 GROUP BY 1, 2),
b AS (SELECT event_id, period, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, period) AS rn FROM c)
SELECT ev.event_id, CAST(b.period AS BIGINT) AS routed FROM ev LEFT JOIN b ON ev.event_id = b.event_id AND rn = 1"""


@query("interval_join_modal_period", "JN9 MK10", _MODE_SQL)
def _(spark, sf):
    e = td.events(spark, sf)
    g = e.where("event_type = 'purchase'").select("ts", F.dayofmonth("ts").cast("bigint").alias("period"))
    return jn.modal_period_within(e, g, "ts", "ts", "period", "routed").select("event_id", "routed")


@query("interval_join_split_runs", "JN9 MK10", _MODE_SQL)
def _(spark, sf):
    """Running totals per period in runs of at most 100 points."""
    e = td.events(spark, sf)
    g = e.where("event_type = 'purchase'").select("ts", F.dayofmonth("ts").cast("bigint").alias("period"))
    return jn.modal_period_within(e, g, "ts", "ts", "period", "routed", hot_rows=100).select("event_id", "routed")


@query("hourly_range_aggregate", "JN10", f"""WITH {td.EVENTS},
h AS (SELECT user_id, date_trunc('hour', ts) AS hour, max(cents) AS temp, max(k) AS wind, sum(k) AS precip FROM ev GROUP BY 1, 2)
SELECT g.event_id, max(CASE WHEN h.hour = date_trunc('hour', g.ts) THEN temp END) AS wx_temp, max(wind) AS wx_wind_max, CAST(sum(precip) AS BIGINT) AS wx_precip
FROM ev g JOIN h ON g.user_id = h.user_id AND h.hour >= date_trunc('hour', g.ts) AND h.hour < date_trunc('hour', g.ts) + INTERVAL 3 HOUR GROUP BY g.event_id""")
def _(spark, sf):
    e = td.events(spark, sf)
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    h = e.groupBy("user_id", hour).agg(F.max("cents").alias("temp"), F.max("k").alias("wind"), F.sum("k").alias("precip"))
    out = jn.hourly_window(
        e.select("event_id", "user_id", "ts"), h, "user_id", "ts", "hour", 3,
        {"wx_temp": "temp"}, {"wx_wind_max": "wind"}, {"wx_precip": "precip"},
    )
    return out.select("event_id", "wx_temp", "wx_wind_max", "wx_precip")


@query("semi_join_and_flag", "JN11", """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS appeared FROM customer""")
def _(spark, sf):
    seen = td.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    c = td.table(spark, sf, "customer").select("c_custkey")
    return c.join(seen.withColumn("hit", F.lit(True)), "c_custkey", "left").select(
        "c_custkey", F.coalesce("hit", F.lit(False)).alias("appeared")
    )


@query("anti_join_already_built", "JN12 SNK4 DQ4", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def _(spark, sf):
    done = td.table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return td.table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("prior_era_lagged_join", "JN13", f"""WITH {td.PANEL}, {SCHEME}
SELECT game_id, gsis_id, s.box_avg AS f_box_avg, s.man_rate AS f_man_rate FROM panel p
LEFT JOIN scheme s ON s.season + 1 = p.season AND s.def_team = p.opponent_team""")
def _(spark, sf):
    from pitpanel.operators.aggregates import scheme_rates

    t = scheme_rates(td.plays(spark, sf))
    out = jn.lagged_era(td.panel(spark, sf), t, "season", {"opponent_team": "def_team"}, ["box_avg", "man_rate"])
    return out.select("game_id", "gsis_id", "f_box_avg", "f_man_rate")


@query("latest_prior_era_lookup", "JN14", f"""WITH {TEAM}, lg AS (SELECT season, avg(off_plays) AS v FROM tw WHERE season NOT IN (1996, 1999) GROUP BY season)
SELECT t.game_id, t.team, (SELECT v FROM lg WHERE lg.season = (SELECT max(season) FROM lg x WHERE x.season < t.season)) AS league_prior FROM tw t""")
def _(spark, sf):
    t = team_week(spark, sf)
    lg = league_context(t.where("season NOT IN (1996, 1999)"), columns=["off_plays"])
    out = jn.latest_prior_era(t, lg, "season", "league_off_plays", "league_prior")
    return out.select("game_id", "team", "league_prior")


_NAMES = """p AS (SELECT s_suppkey AS gsis_id, lower(s_name) AS name, s_acctbal AS actual FROM supplier),
l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS gsis_id,
  'supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS name FROM events)"""


def _names(spark, sf):
    p = td.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("gsis_id"), F.lower("s_name").alias("name"), F.col("s_acctbal").alias("actual")
    )
    lines = td.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("gsis_id"),
        F.concat(F.lit("supplier#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("name"),
    )
    return p, lines


@query("name_key_join_first_wins", "JN15", f"""WITH {_NAMES}, q AS (SELECT name || '' AS name, actual, gsis_id, row_number() OVER (PARTITION BY name ORDER BY gsis_id) AS rn FROM p)
SELECT event_id, q.actual FROM l LEFT JOIN q ON l.name = q.name AND rn = 1""")
def _(spark, sf):
    p, lines = _names(spark, sf)
    one = jn.first_per_key(p, "name", ["gsis_id"]).select("name", "actual")
    return jn.lookup_join(lines, one, ["name"]).select("event_id", "actual")


@query("preferred_then_fallback_key", "JN16", f"""WITH {_NAMES}
SELECT event_id, coalesce(a.actual, b.actual) AS actual, coalesce(a.actual, b.actual) IS NOT NULL AS matched
FROM l LEFT JOIN p a ON l.gsis_id = a.gsis_id LEFT JOIN p b ON l.name = b.name""")
def _(spark, sf):
    """Hot keys (more than 50 lines) are salted."""
    p, lines = _names(spark, sf)
    out = jn.id_then_name(lines, p, "gsis_id", "name", ["gsis_id"], ["actual"], hot_rows=50)
    return out.select("event_id", "actual", "matched")


_BINS = f"""WITH {td.ORDERS},
q AS (SELECT segment, quantile_cont(cents, [0.1, 0.3, 0.5, 0.7, 0.9]) AS e FROM orders_panel WHERE era < 2000 GROUP BY segment),
b AS (SELECT segment, i - 1 AS bin, e[i] AS lo, e[i + 1] AS hi FROM q, generate_series(1, 4) g(i)),
h AS (SELECT o.orderkey, min(b.bin) AS bin FROM orders_panel o JOIN b ON o.segment = b.segment AND b.lo <= o.cents AND o.cents <= b.hi GROUP BY o.orderkey)
SELECT o.orderkey, coalesce(h.bin, CASE WHEN o.cents < q.e[1] THEN 0 ELSE 3 END) AS bin
FROM orders_panel o LEFT JOIN h USING (orderkey) JOIN q ON o.segment = q.segment"""


@query("bin_lookup_with_clamp", "JN17 SO6", _BINS)
def _(spark, sf):
    from pitpanel.operators.ordered import quantiles

    o = td.orders_panel(spark, sf)
    q = quantiles(o.where("era < 2000"), ["segment"], "cents", [0.1, 0.3, 0.5, 0.7, 0.9], "e")
    bins = q.select("segment", F.posexplode(F.slice("e", 1, 4)).alias("i", "lo"), "e").select(
        "segment", F.col("i").cast("bigint").alias("bin"), "lo", F.element_at("e", F.col("i") + 2).alias("hi")
    )
    return jn.bin_lookup(o, bins, "segment", "cents", ["bin"]).select("orderkey", "bin")


@query("grid_lookup_with_default", "JN18", f"""WITH {td.PANEL},
g AS (SELECT position, least(coalesce(depth_rank, 6), 6) AS r, avg(CASE WHEN carries > 0 THEN 1.0E0 ELSE 0.0E0 END) AS p FROM panel WHERE season < 1998 AND depth_rank <= 3 GROUP BY 1, 2)
SELECT game_id, gsis_id, coalesce(g.p, 0.5E0) AS p FROM panel LEFT JOIN g ON panel.position = g.position AND least(coalesce(depth_rank, 6), 6) = g.r""")
def _(spark, sf):
    capped = F.least(F.coalesce("depth_rank", F.lit(6.0)), F.lit(6.0))
    p = td.panel(spark, sf).withColumn("r", capped)
    grid = p.where("season < 1998 AND depth_rank <= 3").groupBy("position", "r").agg(
        F.avg((F.col("carries") > 0).cast("double")).alias("p")
    )
    return jn.grid_lookup(p, grid, ["position", "r"], ["p"], 0.5).select("game_id", "gsis_id", "p")


@query("future_row_construction", "JN19 SE2", f"""WITH {td.PANEL},
g AS (SELECT DISTINCT game_id, home_team, away_team FROM plays WHERE season = 2001),
r AS (SELECT team, gsis_id, depth_rank FROM (SELECT team, gsis_id, depth_rank, row_number() OVER (PARTITION BY team, gsis_id ORDER BY season DESC, week DESC, game_id DESC) AS rn FROM panel WHERE season < 2001) WHERE rn = 1),
l AS (SELECT game_id, home_team AS team, away_team AS opponent_team, 1 AS is_home FROM g UNION ALL SELECT game_id, away_team, home_team, 0 FROM g)
SELECT game_id, team, opponent_team, is_home, gsis_id, depth_rank FROM l JOIN r USING (team)""")
def _(spark, sf):
    g = td.plays(spark, sf).where("season = 2001").select("game_id", "home_team", "away_team").distinct()
    past = td.panel(spark, sf).where("season < 2001").select("team", "gsis_id", "season", "week", "game_id", "depth_rank")
    roster = wn.latest(past, ["team", "gsis_id"], ["season", "week", "game_id"]).select("team", "gsis_id", "depth_rank")
    return jn.future_rows(g, roster, ["team"]).select("game_id", "team", "opponent_team", "is_home", "gsis_id", "depth_rank")


@query("majority_label_join", "JN20", f"""WITH {td.ORDERS},
m AS (SELECT nation, segment, row_number() OVER (PARTITION BY nation ORDER BY count(*) DESC, segment) AS rn FROM orders_panel WHERE era < 1999 GROUP BY nation, segment)
SELECT o.orderkey, coalesce(m.segment, o.segment) AS segment, o.segment AS chart_segment FROM orders_panel o LEFT JOIN m ON o.nation = m.nation AND rn = 1""")
def _(spark, sf):
    o = td.orders_panel(spark, sf)
    out = jn.majority_or_own(o, o.where("era < 1999"), "nation", "segment", "chart_segment")
    return out.select("orderkey", "segment", "chart_segment")


_CODES = sorted({*ALIASES, "KC", "NE", "SEA", "DEN", "LA", "LV", "LAC", "JAX", "WAS", "GB", ""})
_CODE_SQL = "[" + ", ".join(f"'{c}'" for c in _CODES) + "]"
_CANON_SQL = "coalesce(CASE upper(trim({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " END, nullif(upper(trim({c})), ''))"


@query("alias_canonicalisation", "PF15 SRC11", f"""WITH c AS (SELECT o_orderkey, ' ' || lower({_CODE_SQL}[1 + o_custkey % {len(_CODES)}]) AS code FROM orders)
SELECT o_orderkey, {_CANON_SQL.format(c='code')} AS team FROM c""")
def _(spark, sf):
    codes = F.array(*[F.lit(c) for c in _CODES])
    o = td.table(spark, sf, "orders")
    code = F.concat(F.lit(" "), F.lower(F.element_at(codes, (1 + F.col("o_custkey") % len(_CODES)).cast("int"))))
    return o.select("o_orderkey", canonical(code).alias("team"))


@query("tolerant_event_resolution", "JN21", f"""WITH {td.PLAYS}, g AS (SELECT home_team, away_team, min(game_id) AS game_id FROM plays GROUP BY 1, 2),
a AS (SELECT DISTINCT posteam AS home, defteam AS away FROM plays UNION ALL SELECT 'NATION_0', 'NOWHERE')
SELECT a.home, a.away, coalesce(x.game_id, y.game_id) AS game_id FROM a LEFT JOIN g x ON x.home_team = a.home AND x.away_team = a.away
LEFT JOIN g y ON y.home_team = a.away AND y.away_team = a.home""")
def _(spark, sf):
    p = td.plays(spark, sf)
    asked = p.select(F.col("posteam").alias("home"), F.col("defteam").alias("away")).distinct()
    extra = asked.limit(1).select(F.lit("NATION_0").alias("home"), F.lit("NOWHERE").alias("away"))
    games = p.select("game_id", "home_team", "away_team")
    return jn.resolve_event(asked.unionByName(extra), games, canonical)


@query("status_overlay", "JN22", f"""WITH {td.PANEL}, r AS (SELECT o_custkey AS gsis_id, max(o_orderpriority) AS report FROM orders GROUP BY o_custkey)
SELECT DISTINCT p.team, p.gsis_id, p.position, r.report FROM panel p LEFT JOIN r ON p.gsis_id = r.gsis_id""")
def _(spark, sf):
    rep = td.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("gsis_id")).agg(F.max("o_orderpriority").alias("report"))
    roster = td.panel(spark, sf).select("team", "gsis_id", "position").distinct()
    return roster.join(rep, "gsis_id", "left")
