"""Role bindings onto the star-schema test tables.

Each view exists twice: as a DataFrame and as SQL text for the independent check. Measures
are whole numbers held in doubles (cents, hundredths), so sums are exact in any order.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitpanel.session import input_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---- binding A: one row per order -------------------------------------------------------

def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_custkey").alias("custkey"),
        F.col("c_nationkey").cast("bigint").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.year("o_orderdate").cast("bigint").alias("era"),
        F.col("o_orderdate").alias("ordered_at"),
        F.round(F.col("o_totalprice") * 100).alias("cents"),
        F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") * 100)).alias("rate"),
    )


ORDERS = """orders_panel AS (
  SELECT o_orderkey AS orderkey, o_custkey AS custkey, CAST(c_nationkey AS BIGINT) AS nation,
         c_mktsegment AS segment, CAST(year(o_orderdate) AS BIGINT) AS era, o_orderdate AS ordered_at,
         round(o_totalprice * 100) AS cents,
         CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice * 100) END AS rate
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# ---- binding B: user events --------------------------------------------------------------

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.round(F.col("value") * 100).alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


EVENTS = """ev AS (
  SELECT event_id, ts, user_id, event_type, round(value * 100) AS cents,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""

MICROS = "CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE)"


# ---- binding C: order lines as plays between two nations ---------------------------------

def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with what a play is made of: the two nations, season, week, kind of play, and d, t, q."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    sn = n.select(F.col("n_nationkey").alias("s_nk"), F.col("n_name").alias("posteam"))
    cn = n.select(F.col("n_nationkey").alias("c_nk"), F.col("n_name").alias("defteam"))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(s, li.l_suppkey == s.s_suppkey)
        .join(sn, F.col("s_nationkey") == F.col("s_nk"))
        .join(cn, F.col("c_nationkey") == F.col("c_nk"))
        .where(F.col("posteam") != F.col("defteam"))
        .withColumn("d", F.round(F.col("l_discount") * 100) + 0.0)
        .withColumn("t", F.round(F.col("l_tax") * 100) + 0.0)
        .withColumn("q", F.col("l_quantity"))
        .withColumn("season", F.year("o_orderdate").cast("bigint"))
        .withColumn("week", F.quarter("o_orderdate").cast("bigint"))
        .withColumn("home_team", F.least("posteam", "defteam"))
        .withColumn("away_team", F.greatest("posteam", "defteam"))
        .withColumn(
            "play_type",
            F.expr(
                "CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'run' "
                "ELSE CASE l_linestatus WHEN 'O' THEN 'qb_kneel' ELSE 'punt' END END"
            ),
        )
    )


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is a play: the supplier's nation has the ball, the customer's nation defends."""
    return lines(spark, sf_dir).selectExpr(
        "season",
        "week",
        "concat_ws('_', CAST(season AS STRING), CAST(week AS STRING), home_team, away_team) AS game_id",
        "l_orderkey * 10 + l_linenumber AS play_id",
        "posteam",
        "defteam",
        "home_team",
        "away_team",
        "l_suppkey AS player_id",
        "l_partkey AS partner_id",
        "play_type",
        *[f"{expr} AS {name}" for name, expr in PLAY_COLUMNS.items()],
    )


# The same expressions serve both engines.
PLAY_COLUMNS = {
    "complete_pass": "CASE WHEN play_type = 'pass' AND d <= 5 THEN 1.0E0 ELSE 0.0E0 END",
    "incomplete_pass": "CASE WHEN play_type = 'pass' AND d > 5 AND d <= 8 THEN 1.0E0 ELSE 0.0E0 END",
    "interception": "CASE WHEN play_type = 'pass' AND d = 9 THEN 1.0E0 ELSE 0.0E0 END",
    "sack": "CASE WHEN play_type = 'pass' AND d = 10 THEN 1.0E0 END",
    "rush_attempt": "CASE WHEN play_type IN ('run', 'qb_kneel') THEN 1.0E0 ELSE 0.0E0 END",
    "qb_scramble": "CASE WHEN play_type = 'run' AND t = 8 THEN 1.0E0 ELSE 0.0E0 END",
    "two_point_attempt": "CASE WHEN t = 7 THEN 1.0E0 WHEN t > 0 THEN 0.0E0 END",
    "qb_dropback": "CASE WHEN play_type = 'pass' THEN 1.0E0 ELSE 0.0E0 END",
    "wp": "d / 10.0E0",
    "epa": "CASE WHEN t <> 1 THEN q - 25.0E0 END",
    "success": "CASE WHEN q > 25 THEN 1.0E0 ELSE 0.0E0 END",
    "yards_gained": "q - 10.0E0",
    "yardline_100": "q * 2.0E0 - 1.0E0",
    "pass_oe": "CASE WHEN t <> 0 THEN d * 10.0E0 - 50.0E0 END",
    "xpass": "t * 10.0E0",
    "air_yards": "CASE WHEN play_type = 'pass' THEN q - 5.0E0 END",
    "drive": "l_orderkey % 7",
    "score_differential": "l_linenumber - 4.0E0",
    "play_clock": "t * 5.0E0",
    "pass_touchdown": "CASE WHEN play_type = 'pass' AND d <= 5 AND q >= 40 THEN 1.0E0 ELSE 0.0E0 END",
    "rush_touchdown": "CASE WHEN play_type = 'run' AND q >= 40 THEN 1.0E0 END",
    "penalty": "CASE WHEN d = 0 THEN 1.0E0 ELSE 0.0E0 END",
    "penalty_yards": "CASE WHEN d = 0 THEN t * 5.0E0 ELSE 0.0E0 END",
    "penalty_type": "CASE WHEN d > 0 THEN NULL WHEN t > 4 THEN 'DEFENSIVE Pass Interference' ELSE 'Holding' END",
    "defense_man_zone_type": "CASE WHEN t < 3 THEN 'MAN_COVERAGE' WHEN t < 7 THEN 'ZONE_COVERAGE' ELSE 'OTHER' END",
    "was_pressure": "CASE WHEN t <> 4 THEN CASE WHEN q > 30 THEN 1.0E0 ELSE 0.0E0 END END",
    "number_of_pass_rushers": "CASE WHEN t <> 5 THEN d - 2.0E0 END",
    "defenders_in_box": "CASE WHEN t <> 6 THEN t + 3.0E0 END",
}

PLAYS = """pl0 AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_linestatus,
         round(l_discount * 100) + 0.0E0 AS d, round(l_tax * 100) + 0.0E0 AS t, l_quantity AS q,
         CAST(year(o_orderdate) AS BIGINT) AS season, CAST(quarter(o_orderdate) AS BIGINT) AS week,
         sn.n_name AS posteam, cn.n_name AS defteam,
         least(sn.n_name, cn.n_name) AS home_team, greatest(sn.n_name, cn.n_name) AS away_team,
         CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'run'
              ELSE CASE l_linestatus WHEN 'O' THEN 'qb_kneel' ELSE 'punt' END END AS play_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  WHERE sn.n_name <> cn.n_name),
plays AS (
  SELECT season, week,
         concat_ws('_', CAST(season AS VARCHAR), CAST(week AS VARCHAR), home_team, away_team) AS game_id,
         l_orderkey * 10 + l_linenumber AS play_id, posteam, defteam, home_team, away_team,
         l_suppkey AS player_id, l_partkey AS partner_id, play_type,
         """ + ",\n         ".join(f"{e} AS {n}" for n, e in PLAY_COLUMNS.items()) + """
  FROM pl0)"""


# ---- the entity panel on top of the plays ------------------------------------------------

BOX = {
    "targets": "sum(complete_pass + incomplete_pass + interception)",
    "receptions": "sum(complete_pass)",
    "receiving_yards": "sum(complete_pass * yards_gained)",
    "receiving_tds": "sum(pass_touchdown)",
    "carries": "sum(rush_attempt)",
    "rushing_yards": "sum(rush_attempt * yards_gained)",
    "rushing_tds": "sum(coalesce(rush_touchdown, 0.0E0))",
    "attempts": "sum(qb_dropback)",
    "completions": "sum(complete_pass * success)",
    "passing_yards": "sum(qb_dropback * yards_gained)",
    "passing_tds": "sum(pass_touchdown)",
    "passing_interceptions": "sum(interception)",
    "sacks_suffered": "sum(coalesce(sack, 0.0E0))",
    "off_snaps": "CAST(count(*) AS DOUBLE)",
    "off_pass_att": "sum(qb_dropback + penalty)",
    "off_designed_rush": "sum(rush_attempt + penalty)",
    "ngs_avg_separation": "max(pass_oe)",
    "carries_rz": "sum(CASE WHEN yardline_100 <= 20 THEN rush_attempt ELSE 0.0E0 END)",
}

#: Columns of a play that the panel sums; they follow from play_type, d, t and q.
BOX_COLUMNS = [n for n in PLAY_COLUMNS if any(n in re.findall(r"\w+", e) for e in BOX.values())]

# Position labels and depth ranks follow from the entity key alone.
POSITION = (
    "CASE {e} % 6 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'FB' WHEN 3 THEN 'WR' "
    "WHEN 4 THEN 'TE' ELSE 'K' END"
)


#: Lineitem bytes whose plays one task of the panel takes.
TASK_BYTES = 8 << 20


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity x game rows: a supplier's lines against one rival nation in one quarter.

    Nearly every play is a row of its own, so summing before the exchange saves little and fills the memory of the scanning
    tasks. The plays are dealt by entity first, over as many tasks as their bytes ask for; sums and windows per entity follow
    in those tasks, and no further exchange is needed. What is dealt are the few values of a line that a play's columns follow
    from, and the event's name follows from the other keys.
    """
    p = lines(spark, sf_dir).where("play_type <> 'punt'").selectExpr("season", "week", "posteam AS team", "defteam AS opponent_team", "l_suppkey AS gsis_id", "play_type", "d", "t", "q")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(table(spark, sf_dir, "lineitem")) // TASK_BYTES))
    game = "concat_ws('_', CAST(season AS STRING), CAST(week AS STRING), least(team, opponent_team), greatest(team, opponent_team)) AS game_id"
    return (
        p.repartition(tasks, "gsis_id")
        .selectExpr("season", "week", "team", "opponent_team", "gsis_id", *[f"{PLAY_COLUMNS[n]} AS {n}" for n in BOX_COLUMNS])
        .groupBy("season", "week", "team", "opponent_team", "gsis_id")
        .agg(*[F.expr(e).alias(n) for n, e in BOX.items()])
        .selectExpr("season", "week", game, "team", "opponent_team", "gsis_id", *BOX)
        .withColumn("position", F.expr(POSITION.format(e="gsis_id")))
        .withColumn("depth_rank", F.expr("CAST(CASE WHEN gsis_id % 7 < 6 THEN gsis_id % 7 + 1 END AS DOUBLE)"))
    )


def box_totals(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    """The panel's counts summed over its rows per ``by``, straight from the plays: whole numbers, so the sums are the same."""
    p = plays(spark, sf_dir).where("play_type <> 'punt'")
    return p.groupBy(*by).agg(*[F.expr(e).alias(n) for n, e in BOX.items() if e.startswith("sum(")])


PANEL = PLAYS + """,
panel AS (
  SELECT season, week, game_id, posteam AS team, defteam AS opponent_team, player_id AS gsis_id,
         """ + ",\n         ".join(f"{e} AS {n}" for n, e in BOX.items()) + f""",
         {POSITION.format(e='player_id')} AS position,
         CAST(CASE WHEN player_id % 7 < 6 THEN player_id % 7 + 1 END AS DOUBLE) AS depth_rank
  FROM plays WHERE play_type <> 'punt'
  GROUP BY season, week, game_id, posteam, defteam, player_id)"""
