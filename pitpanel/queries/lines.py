"""Line ingest, comparison, freezing, grading and record queries."""

from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.functions import prob as pr
from pitpanel.functions.names import normalize_name, person_like
from pitpanel.operators import aggregates as ag
from pitpanel.operators import lines as ln
from pitpanel.queries import query
from pitpanel.queries.aggregates import scored_sql
from pitpanel.queries.calibration import BINS, HELD, calibration_of
from pitpanel.session import constant_table, materialise
from pitpanel.sources import feeds


def half_up(x: str, d: int) -> str:
    """SQL rounding that sends decimal ties away from zero, as the engine does."""
    return f"(CAST(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38, {d})) AS DOUBLE) + 0.0)"


# ---- posted lines: every event is a line --------------------------------------------------

_ID9 = "lpad(CAST(user_id AS {s}), 9, '0')"
_LINE_COLS = {
    "name": "CASE k % 3 WHEN 0 THEN concat('SUPPLIER#', " + _ID9 + ", ' Jr.') WHEN 1 THEN concat('Supplier#', " + _ID9
    + ") ELSE concat('Supplier  ', " + _ID9 + ") END",
    "stat_type": """CASE event_type WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN ' Receiving Yards' ELSE 'rush+rec yds' END
      WHEN 'view' THEN 'Rec Targets' WHEN 'purchase' THEN 'Player Touchdowns'
      WHEN 'signup' THEN CASE WHEN k % 4 = 0 THEN 'Longest Reception' ELSE 'Fantasy Score' END
      ELSE CASE WHEN k % 2 = 0 THEN 'Kicking Points' ELSE 'Mystery Stat' END END""",
    "line": "floor(cents / CASE event_type WHEN 'view' THEN 10000.0E0 ELSE 2000.0E0 END) + 0.5E0",
    "odds_type": "CASE k % 5 WHEN 1 THEN 'demon' WHEN 2 THEN 'goblin' ELSE 'standard' END",
    "direction": "CASE k % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'more' WHEN 2 THEN 'less' ELSE '' END",
}
LINES = td.EVENTS + ",\nln AS (SELECT event_id, ts, " + ", ".join(
    f"{e.format(s='VARCHAR') if '{s}' in e else e} AS {n}" for n, e in _LINE_COLS.items()
) + " FROM ev)"


def lines(spark, sf):
    return td.events(spark, sf).selectExpr(
        "event_id", "ts", *[f"{e.format(s='STRING') if '{s}' in e else e} AS {n}" for n, e in _LINE_COLS.items()]
    )


_PROJ = ["targets", "receptions", "receiving_yards", "receiving_tds", "rushing_yards", "rushing_tds",
         "passing_yards", "passing_tds", "passing_interceptions"]
PROJECTIONS = td.PANEL + """,
proj AS (SELECT gsis_id, any_value(s_name) AS player_display_name, any_value(team) AS team, any_value(position) AS position,
  CAST(count(*) AS DOUBLE) AS games, """ + ", ".join(f"sum({c}) / count(*) AS {c}" for c in _PROJ) + """
  FROM panel JOIN supplier ON gsis_id = s_suppkey GROUP BY gsis_id)"""


def projections(spark, sf, panel=None):
    p = (td.panel(spark, sf) if panel is None else panel).groupBy("gsis_id").agg(
        F.first("team").alias("team"), F.first("position").alias("position"),
        F.count(F.lit(1)).cast("double").alias("f_games_prior"), *[F.avg(c).alias(c) for c in _PROJ],
    )
    s = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("gsis_id"), F.col("s_name").alias("player_display_name"))
    src = F.when(F.col("gsis_id") % 2 == 0, "baseline").otherwise("model")
    return p.join(s, "gsis_id").withColumn("rushing_tds_source", src).withColumn("depth_rank", F.lit(1.0))


_KEY = """trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]+', ' ', 'g'), '\\b(jr|sr|ii|iii|iv|v)\\b', '', 'g'), ' +', ' ', 'g'))"""
_FANTASY = "(0.0E0 + " + " + ".join(
    f"{c} * {w}E0" for c, w in ln.FANTASY_WEIGHTS.items() if c in _PROJ
) + ")"
COMPARED = LINES + ", " + PROJECTIONS + f""",
m0 AS (SELECT ln.*, lower(trim(stat_type)) AS label, p.* EXCLUDE (player_display_name), p.player_display_name AS player
  FROM ln LEFT JOIN proj p ON {_KEY.format(c='ln.name')} = {_KEY.format(c='p.player_display_name')}),
m1 AS (SELECT *, CASE label WHEN 'longest reception' THEN 'refused' WHEN 'mystery stat' THEN 'unmapped'
   ELSE CASE WHEN player IS NULL THEN 'unmatched' WHEN label = 'kicking points' THEN 'unprojected'
   WHEN label = 'player touchdowns' AND rushing_tds + receiving_tds <= 0 THEN 'unprojected' ELSE 'matched' END END AS disposition FROM m0),
m2 AS (SELECT *, CASE WHEN disposition = 'matched' THEN CASE label WHEN 'receiving yards' THEN receiving_yards
    WHEN 'rush+rec yds' THEN rushing_yards + receiving_yards WHEN 'rec targets' THEN targets
    WHEN 'fantasy score' THEN {half_up(_FANTASY, 2)} ELSE rushing_tds + receiving_tds END END AS raw0 FROM m1)"""


def _poisson_series(lam: str, line: str, terms: int = 30) -> str:
    """Closed sum of the first floor(line) + 1 Poisson terms."""
    fact, parts = 1.0, []
    for i in range(terms):
        fact *= max(i, 1)
        parts.append(f"CASE WHEN {i} <= floor({line}) THEN pow({lam}, {i}) / {fact!r} ELSE 0 END")
    return f"exp(-({lam})) * (" + " + ".join(parts) + ")"


COMPARED = COMPARED + f""",
m3 AS (SELECT * EXCLUDE (player), CASE WHEN disposition = 'matched' THEN player END AS player, CASE WHEN label = 'player touchdowns' AND raw0 IS NOT NULL
   THEN least(0.99, greatest(0.01, 1 - {_poisson_series('raw0', 'line')})) ELSE raw0 END AS raw,
   CASE WHEN label = 'player touchdowns' THEN 0.5 ELSE line END AS against FROM m2),
cmp AS (SELECT *, raw - against AS gap, CASE WHEN disposition = 'matched' THEN CASE WHEN label = 'fantasy score' THEN 'composite'
   WHEN label = 'player touchdowns' AND gsis_id % 2 = 0 THEN 'baseline' WHEN label = 'rush+rec yds' THEN 'model' ELSE 'model' END END AS source,
   CASE WHEN disposition = 'matched' THEN CASE WHEN raw > against THEN 'More' WHEN raw < against THEN 'Less' ELSE 'Even' END END AS lean,
   CASE WHEN disposition = 'matched' THEN CASE WHEN direction = '' THEN 'both' ELSE direction END END AS sides FROM m3)"""


@query("compare_lines_with_projections", "MK1 MK2 MK3 PF25 SF6 SF12 SF19", f"""WITH {COMPARED}
SELECT event_id, disposition, player, {half_up('raw', 2)} AS model, {half_up('gap', 2)} AS diff,
  CASE WHEN label = 'player touchdowns' THEN {half_up('100 * gap', 1)} ELSE {half_up('100 * gap / line', 1)} END AS diff_pct,
  lean, sides, source, CASE WHEN disposition = 'matched' THEN games END AS games_prior FROM cmp""")
def _(spark, sf):
    c = ln.compare(lines(spark, sf), projections(spark, sf))
    return c.select("event_id", "disposition", "player", "model", "diff", "diff_pct", "lean", "sides", "source", "games_prior")


@query("compare_lines_salted_names", "MK2 JN15", f"WITH {COMPARED} SELECT event_id, disposition, player, lean FROM cmp")
def _(spark, sf):
    """Names with more than 40 lines are salted."""
    return ln.compare(lines(spark, sf), projections(spark, sf), hot_rows=40).select("event_id", "disposition", "player", "lean")


@query("line_accounting", "AG21 PF25", f"""WITH {COMPARED} SELECT disposition, stat_type, count(*) AS n FROM cmp GROUP BY disposition, stat_type""")
def _(spark, sf):
    a = ln.accounting(ln.compare(lines(spark, sf), projections(spark, sf)))
    return a.groupBy("disposition", "stat_type").agg(F.sum("n").alias("n"))


# Measured reliability per stat (tier, side-picking edge in points).
RELIABILITY = [
    ("attempts", "strong", 11.5), ("completions", "strong", 7.9), ("passing_yards", "strong", 8.4),
    ("targets", "moderate", 6.0), ("receptions", "moderate", 5.3), ("carries", "moderate", 4.3),
    ("receiving_yards", "weak", 2.9), ("rushing_yards", "weak", 2.4), ("receiving_tds", "none", -0.2),
    ("rushing_tds", "none", None), ("passing_tds", "weak", None), ("passing_interceptions", "weak", None),
    ("sacks_suffered", "weak", None), ("fg_att", "none", None), ("fg_made", "none", None), ("pat_att", "weak", None),
]


def reliability(spark):
    rows = [{"stat": s, "tier": t, "side_edge_pts": e, "pos": i} for i, (s, t, e) in enumerate(RELIABILITY)]
    return constant_table(spark, rows, "stat:string,tier:string,side_edge_pts:double,pos:int")


_BOARD = COMPARED + """,
brd AS (SELECT *, CASE label WHEN 'receiving yards' THEN 'weak' WHEN 'rush+rec yds' THEN 'weak' WHEN 'rec targets' THEN 'moderate' ELSE 'unmeasured' END AS tier,
  CASE WHEN NOT (lean IN ('More', 'Less') AND (sides = 'both' OR sides = lower(lean))) THEN 'side_not_offered'
       WHEN games < 3 THEN 'thin_history' END AS withheld_reason FROM cmp WHERE disposition = 'matched')"""


def board(spark, sf):
    return ln.board_rows(ln.compare(lines(spark, sf), projections(spark, sf), reliability=reliability(spark)))


@query("board_rows_shown_and_withheld", "PF20 PF21 PF22 SO4", f"WITH {_BOARD} SELECT event_id, tier, withheld_reason FROM brd")
def _(spark, sf):
    return board(spark, sf).select("event_id", "tier", "withheld_reason")


@query("ranked_board", "SO3", f"""WITH {_BOARD},
r AS (SELECT event_id, CASE tier WHEN 'moderate' THEN 1 ELSE 2 END AS tr,
  CASE WHEN label = 'player touchdowns' THEN abs({half_up('raw', 2)} - 0.5) ELSE abs({half_up('100 * gap / line', 1)}) / 400.0 END AS conf FROM brd WHERE withheld_reason IS NULL)
SELECT event_id, tr AS tier_rank, round(conf, 6) AS confidence FROM r ORDER BY tr, conf DESC, event_id""")
def _(spark, sf):
    b = board(spark, sf).where("withheld_reason IS NULL")
    top = ln.rank_board(b, ["event_id"])
    return top.select("event_id", ln.tier_rank(F.col("tier")).alias("tier_rank"), F.round(ln.confidence(top), 6).alias("confidence"))


@query("shown_lines_per_group", "AG20", f"WITH {_BOARD} SELECT team, count(*) AS lines FROM brd WHERE withheld_reason IS NULL GROUP BY team")
def _(spark, sf):
    return ln.line_counts(board(spark, sf), "team")


@query("weak_evidence_summary", "AG29", f"WITH {_BOARD} SELECT stat_type AS stat, count(*) AS n, CAST(NULL AS DOUBLE) AS edge FROM brd WHERE tier IN ('none', 'negative') GROUP BY stat_type")
def _(spark, sf):
    return ln.weak_evidence(board(spark, sf))


@query("collapse_alternate_lines", "WN14 MK10", f"""WITH {LINES}
SELECT event_id, name, stat_type, odds_type FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY.format(c='name')}, lower(trim(stat_type))
  ORDER BY CASE odds_type WHEN 'standard' THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS rn FROM ln) WHERE rn = 1""")
def _(spark, sf):
    return ln.collapse_alternates(lines(spark, sf), ["ts", "event_id"]).select("event_id", "name", "stat_type", "odds_type")


_FROZEN = COMPARED + """,
fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year(ts), weekofyear(ts), player, stat_type ORDER BY ts, event_id) AS rn FROM cmp WHERE disposition = 'matched') WHERE rn = 1)"""


def in_weeks(df):
    return df.withColumn("season", F.year("ts")).withColumn("week", F.weekofyear("ts"))


def frozen(spark, sf):
    c = in_weeks(ln.compare(lines(spark, sf), projections(spark, sf)).where("disposition = 'matched'"))
    return ln.freeze(c, None, F.col("ts"), "v1", tie=["ts", "event_id"])


@query("freeze_first_seen", "MK4 SNK5", f"""WITH {COMPARED},
m AS (SELECT *, CAST(year(ts) AS INTEGER) AS season, CAST(weekofyear(ts) AS INTEGER) AS week FROM cmp WHERE disposition = 'matched'),
old AS (SELECT DISTINCT season, week, player, stat_type FROM m WHERE ts < TIMESTAMP '2024-01-10')
SELECT season, week, player, stat_type AS stat, event_id, line, ts AS frozen_at, 'v2' AS model_version FROM (
  SELECT *, row_number() OVER (PARTITION BY season, week, player, stat_type ORDER BY ts, event_id) AS rn FROM m WHERE ts >= TIMESTAMP '2024-01-10') c
 WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.season = c.season AND old.week = c.week AND old.player = c.player AND old.stat_type = c.stat_type)""")
def _(spark, sf):
    """A second run in the middle of a week: that week's frozen lines stay, later weeks are frozen anew."""
    c = in_weeks(ln.compare(lines(spark, sf), projections(spark, sf)).where("disposition = 'matched'"))
    cut = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    old = ln.freeze(c.where(F.col("ts") < cut), None, F.col("ts"), "v1", tie=["ts", "event_id"])
    new = ln.freeze(c.where(F.col("ts") >= cut), old, F.col("ts"), "v2", tie=["ts", "event_id"])
    return new.select("season", "week", "player", "stat", "event_id", "line", "frozen_at", "model_version")


# Actuals: each supplier's last two panel rows, as two weeks; a line belongs to one of them.
_ACTUALS = """,
act AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gsis_id ORDER BY season DESC, week DESC, game_id DESC) AS rn FROM panel) WHERE rn <= 2),
gr0 AS (SELECT c.event_id, c.ts, c.line, c.lean, c.model2, c.label, CASE c.label WHEN 'receiving yards' THEN a.receiving_yards WHEN 'rush+rec yds' THEN a.rushing_yards + a.receiving_yards
   WHEN 'rec targets' THEN a.targets WHEN 'player touchdowns' THEN a.rushing_tds + a.receiving_tds
   ELSE {fantasy} END AS actual FROM (SELECT *, {model} AS model2 FROM cmp WHERE disposition = 'matched') c JOIN act a ON c.gsis_id = a.gsis_id AND a.rn = 1 + c.event_id % 2),
gr AS (SELECT *, CASE WHEN actual > line THEN 'More' WHEN actual < line THEN 'Less' ELSE 'Exact' END AS result FROM gr0),
graded AS (SELECT *, CASE WHEN result <> 'Exact' THEN result = lean END AS model_correct FROM gr)""".format(
    fantasy=half_up(_FANTASY.replace("passing_yards", "a.passing_yards").replace("rushing_yards", "a.rushing_yards")
                    .replace("receiving_yards", "a.receiving_yards").replace("receptions", "a.receptions").replace("passing_tds", "a.passing_tds")
                    .replace("rushing_tds", "a.rushing_tds").replace("receiving_tds", "a.receiving_tds").replace("passing_interceptions", "a.passing_interceptions"), 2),
    model=half_up("raw", 2),
)


def graded(spark, sf):
    """Compared lines and the panel are stored: counting hot keys, both joins and both uses of the panel read them."""
    from pyspark.sql import Window

    kept = ["season", "week", "game_id", "gsis_id", "team", "position", *_PROJ]
    panel = materialise(td.panel(spark, sf).select(*kept), "panel")
    c = materialise(ln.compare(lines(spark, sf), projections(spark, sf, panel)).where("disposition = 'matched'"), "compared")
    c = c.withColumn("season", F.lit(1)).withColumn("week", 1 + F.col("event_id") % 2)
    s = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("gsis_id"), F.col("s_name").alias("player_display_name"))
    newest = Window.partitionBy("gsis_id").orderBy(F.desc("season"), F.desc("week"), F.desc("game_id"))
    act = panel.withColumn("__n", F.row_number().over(newest)).where("__n <= 2")
    act = act.withColumn("season", F.lit(1)).withColumn("week", F.col("__n").cast("bigint")).drop("__n")
    act = materialise(act, "actuals")
    return ln.grade(c, act.join(s, "gsis_id")).drop("season", "week")


@query("grade_lines", "MK5 JN16", f"WITH {COMPARED}{_ACTUALS} SELECT event_id, actual, result, model_correct FROM graded")
def _(spark, sf):
    return graded(spark, sf).select("event_id", "actual", "result", "model_correct")


_Z = "1.96E0"
_WIL = """((hits / n0 + {z} * {z} / (2 * n0)) {op} {z} * sqrt((hits / n0) * (1 - hits / n0) / n0 + {z} * {z} / (4 * n0 * n0))) / (1 + {z} * {z} / n0)"""


@query("season_record_with_interval", "MK6 SF13 MK8", f"""WITH {COMPARED}{_ACTUALS},
r AS (SELECT label, count(*) AS n, count(model_correct) AS n0, count(CASE WHEN model_correct THEN 1 END) AS hits,
   count(*) - count(model_correct) AS ties, avg(CASE WHEN model_correct IS NOT NULL THEN CASE WHEN result = 'More' THEN 1.0E0 ELSE 0.0E0 END END) AS o FROM graded GROUP BY label)
SELECT label, n, n0 AS decided, hits, ties, {half_up('100.0E0 * hits / n0', 1)} AS hit_rate,
  {half_up('100 * greatest(0, ' + _WIL.format(z=_Z, op='-') + ')', 1)} AS ci_low, {half_up('100 * least(1, ' + _WIL.format(z=_Z, op='+') + ')', 1)} AS ci_high,
  {half_up('100 * greatest(o, 1 - o)', 1)} AS baseline, greatest(0, {_WIL.format(z=_Z, op='-')}) > greatest(o, 1 - o) AS beats_coin FROM r""")
def _(spark, sf):
    g = graded(spark, sf).withColumn("label", F.lower(F.trim("stat")))
    g = g.withColumn("basis", F.lit("frozen")).withColumn("season", F.year("ts"))
    return ln.record(ln.eligible_record(g, "season", 2023).drop("basis"), ["label"])


@query("week_scorecard", "MK7 ML13", f"""WITH {COMPARED}{_ACTUALS}
SELECT CAST(day(ts) AS BIGINT) AS day, count(*) AS n, count(model_correct) AS decided, count(CASE WHEN result = 'Exact' THEN 1 END) AS exact_ties,
  count(CASE WHEN model_correct THEN 1 END) AS hits, {half_up('100.0E0 * count(CASE WHEN model_correct THEN 1 END) / count(model_correct)', 1)} AS hit_rate,
  {half_up('avg(abs(model2 - actual))', 2)} AS mae, {half_up('avg(abs(line - actual))', 2)} AS line_mae FROM graded GROUP BY 1""")
def _(spark, sf):
    return ln.scorecard(graded(spark, sf).withColumn("day", F.dayofmonth("ts").cast("bigint")), ["day"])


@query("lines_per_entity_pages", "MK9", f"""WITH {LINES},
n AS (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY ts, event_id) - 1) // 20 AS page FROM ln)
SELECT name, CAST(page AS BIGINT) AS page, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM n GROUP BY name, page""")
def _(spark, sf):
    from pitpanel.operators.joins import micros

    p = ln.entity_pages(lines(spark, sf), "name", ["ts", "event_id"], micros("ts"), ["event_id", "line"], size=20)
    ids = F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",")
    return p.select("name", "page", F.size("rows").cast("bigint").alias("n"), ids.alias("ids"))


# ---- probability comparison ---------------------------------------------------------------

_INTERP = """CASE WHEN k = 0 THEN 0.0 WHEN k = len(q) THEN CASE WHEN x > q[len(q)] THEN 1.0 ELSE g[len(q)] END
  WHEN q[k] = x THEN g[k] ELSE g[k] + (g[k + 1] - g[k]) / (q[k + 1] - q[k]) * (x - q[k]) END"""


_LINED = {"rec targets": "targets", "receiving yards": "receiving_yards"}
_PRICED = f"""{COMPARED}{scored_sql(list(_LINED.values()))[len(td.PANEL):]}{BINS},
pl AS (SELECT event_id, label, line, raw, CASE label {" ".join(f"WHEN '{k}' THEN '{t}'" for k, t in _LINED.items())} END AS target FROM cmp WHERE disposition = 'matched'),
edge AS (SELECT target, min(lo) AS lo, max(hi) AS hi, min(bin) AS b0, max(bin) AS b1 FROM cal GROUP BY target),
pb AS (SELECT pl.*, CASE WHEN raw < edge.lo THEN b0 WHEN raw > edge.hi THEN b1 ELSE (SELECT min(bin) FROM cal WHERE cal.target = pl.target AND cal.lo <= raw AND raw <= cal.hi) END AS bin
 FROM pl LEFT JOIN edge ON edge.target = pl.target),
px AS (SELECT pb.*, c.quantiles AS q, c.q_grid AS g, line / raw AS x FROM pb LEFT JOIN cal c ON c.target = pb.target AND c.bin = pb.bin),
py AS (SELECT *, len(list_filter(q, lambda v: v <= x)) AS k FROM px),
pz AS (SELECT *, CASE WHEN raw >= 0.25 AND q IS NOT NULL THEN least(0.99, greatest(0.01, 0.5 + ((1 - ({_INTERP})) - 0.5) * 0.9)) END AS p_over FROM py)"""


@query("probability_over_every_line", "SF15 SF17 SF18 JN17", f"""WITH {_PRICED}
SELECT event_id, label, floor({half_up('p_over', 4)} * 1e3 + 0.37E0) / 1e3 AS p_over, {half_up('CASE WHEN p_over IS NOT NULL THEN raw * q[100] ELSE raw END', 2)} AS model FROM pz""")
def _(spark, sf):
    """A row for each priced line, by its own target's bins; a sum of targets has no bins, so its p_over is null."""
    posted = lines(spark, sf)
    asked = ln.single_targets(posted)
    c = ln.compare(posted, projections(spark, sf), calibration=calibration_of(spark, sf, [t for t in HELD if t in asked])).where("disposition = 'matched'")
    p = F.floor(F.col("p_over") * 1e3 + 0.37) / 1e3  # three digits, cut where no interpolated tie lies
    return c.select("event_id", F.lower(F.trim("stat")).alias("label"), p.alias("p_over"), "model")


# ---- scalar functions over whole tables ---------------------------------------------------

@query("normalize_names", "SF1", f"""SELECT c_custkey AS id, {_KEY.format(c="c_name || ' ÉÀÇü Jr. III' ").replace("lower(", "lower(strip_accents(").replace("Jr. III' )", "Jr. III' ))")} AS key FROM customer""")
def _(spark, sf):
    c = td.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), normalize_name(F.concat("c_name", F.lit(" ÉÀÇü Jr. III"))).alias("key"))


@query("person_like_labels", "SF2", """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS s FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, (length(s) >= 4 AND contains(s, ' ') AND NOT (s = upper(s) AND s <> lower(s) AND length(s) <= 5) AND regexp_matches(s, '[A-Za-z]{2,}[ \\t\\n\\x0B\\f\\r]+[A-Za-z]')) AS ok FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE ok) AS n_person_like FROM p GROUP BY doc_id""")
def _(spark, sf):
    """Every line of every whole text."""
    d = td.table(spark, sf, "documents").where("text IS NOT NULL")
    lines = F.transform(F.split("text", "\n"), lambda s: person_like(F.trim(s)))
    n = d.select("doc_id", lines.alias("l"))
    return n.select("doc_id", F.size("l").cast("bigint").alias("n_lines"), F.size(F.filter("l", lambda x: x)).cast("bigint").alias("n_person_like"))


@query("strip_trailing_markers", "SF3", """SELECT event_id, regexp_replace(event_type || ['', 'Demon', 'GoblinDemon', 'DemonGoblinDemon', 'DemonX'][1 + k % 5], '(Demon|Goblin)+$', '') AS label
FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def _(spark, sf):
    tails = F.array(*[F.lit(x) for x in ("", "Demon", "GoblinDemon", "DemonGoblinDemon", "DemonX")])
    e = td.events(spark, sf)
    return e.select("event_id", feeds.strip_markers(F.concat("event_type", F.element_at(tails, (1 + F.col("k") % 5).cast("int")))).alias("label"))


@query("finite_number_parse", "SF7", """WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Infinity' WHEN 1 THEN '1e400' WHEN 2 THEN 'abc' WHEN 3 THEN 'nan' ELSE CAST(value AS VARCHAR) END AS t FROM events),
x AS (SELECT event_id, TRY_CAST(t AS DOUBLE) AS v FROM s)
SELECT event_id, CASE WHEN isfinite(v) THEN v + 0.0E0 END AS v FROM x""")
def _(spark, sf):
    e = td.table(spark, sf, "events").select(
        "event_id",
        F.expr("CASE event_id % 6 WHEN 0 THEN 'Infinity' WHEN 1 THEN '1e400' WHEN 2 THEN 'abc' WHEN 3 THEN 'nan' ELSE CAST(value AS STRING) END").alias("t"),
    )
    return e.select("event_id", (pr.finite_number(F.col("t")) + F.lit(0.0)).alias("v"))


@query("poisson_tail", "SF11", f"""WITH {td.EVENTS}, x AS (SELECT event_id, k / 10.0E0 AS lam, user_id % 12 AS line FROM ev)
SELECT event_id, round(greatest(0, least(1, 1 - {_poisson_series('lam', 'line')})), 9) AS p FROM x""")
def _(spark, sf):
    e = td.events(spark, sf)
    p = pr.poisson_at_least(F.col("k") / 10.0, pr.threshold_for_line((F.col("user_id") % 12).cast("double")))
    return e.select("event_id", (F.round(p, 9) + F.lit(0.0)).alias("p"))


@query("recency_weight_and_break_even", "SF20 SF22", """SELECT o_orderkey, round(pow(0.5, (2001 - year(o_orderdate)) / 3.0), 9) AS weight,
  round(pow(1.0 / (2 + o_orderkey % 9), 1.0 / (2 + o_orderkey % 5)), 9) AS break_even FROM orders""")
def _(spark, sf):
    o = td.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", F.round(pr.recency_weight(2001 - F.year("o_orderdate")), 9).alias("weight"),
        F.round(pr.break_even(2 + k % 9, 2 + k % 5), 9).alias("break_even"),
    )


@query("json_feed_to_rows", "SF8 SF10 SRC8", f"""WITH {td.EVENTS}
SELECT event_id, CAST(0 AS INTEGER) AS pos, CASE WHEN k % 5 = 0 THEN NULL ELSE 'User ' || chr(CAST(65 + user_id % 26 AS INTEGER)) END AS name, event_type AS stat_type,
  CASE WHEN k % 7 = 0 THEN NULL ELSE k + 0.5E0 END AS line, CASE k % 4 WHEN 0 THEN 'more' WHEN 1 THEN 'less' ELSE 'both' END AS direction,
  CASE WHEN k % 5 = 0 THEN 'no_name' WHEN k % 7 = 0 THEN 'bad_line' END AS reject_reason FROM ev""")
def _(spark, sf):
    doc = F.expr("""concat('{"data":[{"type":"projection","attributes":{"stat_type":"', event_type, '","line_score":',
      CASE WHEN k % 7 = 0 THEN '"n/a"' ELSE concat(k, '.5') END, CASE k % 4 WHEN 0 THEN ',"allowed_wager_types":["over"]' WHEN 1 THEN ',"allowed_wager_types":"under"'
      WHEN 2 THEN ',"allowed_wager_types":["sideways"]' ELSE '' END, ',"description":"KC"},"relationships":{"new_player":{"data":{"id":"', CASE WHEN k % 5 = 0 THEN 'x' ELSE '9' END,
      '"}}}},"junk",7],"included":["odd",{"type":"new_player","id":"9","attributes":{"name":"User ', char(65 + user_id % 26), '","team":"KC"}}]}')""")
    docs = td.events(spark, sf).select("event_id", doc.alias("body"))
    r = feeds.parse_any(docs, "event_id", "body")
    return r.select("event_id", "pos", "name", "stat_type", "line", "direction", "reject_reason")


@query("board_text_to_rows", "SF9 SF10 SRC9", f"""WITH {td.EVENTS}, b AS (SELECT event_id, k, user_id, event_type FROM ev),
u AS (SELECT event_id, 2 AS pos, 'Ann ' || chr(CAST(65 + user_id % 26 AS INTEGER)) || 'x' AS name, CASE WHEN k % 2 = 0 THEN 'KC' END AS team, event_type AS stat_type, k + 0.5E0 AS line,
   CASE k % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'more' ELSE '' END AS direction, CASE WHEN k % 5 = 0 THEN 'demon' ELSE 'standard' END AS odds_type FROM b
 UNION ALL SELECT event_id, 5 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, 'Bob Lee', NULL, 'Targets', 3.0E0, 'less', 'standard' FROM b)
SELECT event_id, CAST(pos AS INTEGER) AS pos, name, team, stat_type, line, direction, odds_type FROM u""")
def _(spark, sf):
    body = F.expr("""concat_ws('\\n', 'KC', '44.5', concat('Ann ', char(65 + user_id % 26), 'x'), CASE WHEN k % 2 = 0 THEN ' KC - QB ' END, concat(k, '.5'), '',
      concat(event_type, CASE WHEN k % 5 = 0 THEN 'DemonGoblin' ELSE '' END), CASE k % 3 WHEN 0 THEN 'Less\\nMore' WHEN 1 THEN 'More' END, 'Bob Lee', '3', 'Targets', 'Less', 'tail')""")
    docs = td.events(spark, sf).select("event_id", body.alias("body"))
    r = feeds.parse_any(docs, "event_id", "body")
    return r.select("event_id", "pos", "name", "team", "stat_type", "line", "direction", "odds_type")
