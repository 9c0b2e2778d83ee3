"""Window queries on the orders and events bindings."""

from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.operators import windows as wn
from pitpanel.operators.ordered import Spec
from pitpanel.queries import query
from pitpanel.roles import ORDERS_PANEL as R

W = "PARTITION BY custkey ORDER BY era, ordered_at, orderkey ROWS BETWEEN"
N = "PARTITION BY nation ORDER BY era, ordered_at, orderkey ROWS BETWEEN"
BEFORE = "UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("prior_mean_zero_filled", "WN1", f"""WITH {td.ORDERS}
SELECT orderkey, sum(coalesce(rate, 0.0E0)) OVER ({W} {BEFORE})
       / nullif(count(*) OVER ({W} {BEFORE}), 0) AS prior_mean FROM orders_panel""")
def _(spark, sf):
    df = wn.prior_mean(td.orders_panel(spark, sf), R, "rate", "prior_mean")
    return df.select("orderkey", "prior_mean")


@query("prior_mean_skip_null", "WN2", f"""WITH {td.ORDERS}
SELECT orderkey, sum(rate) OVER ({W} {BEFORE}) / nullif(count(rate) OVER ({W} {BEFORE}), 0) AS prior_mean
FROM orders_panel""")
def _(spark, sf):
    df = wn.prior_mean_present(td.orders_panel(spark, sf), R, "rate", "prior_mean")
    return df.select("orderkey", "prior_mean")


@query("prior_sum_and_count", "WN3", f"""WITH {td.ORDERS}
SELECT orderkey, coalesce(sum(rate) OVER ({W} {BEFORE}), 0.0E0) AS prior_sum,
       count(*) OVER ({W} {BEFORE}) AS prior_n FROM orders_panel""")
def _(spark, sf):
    df = wn.prior_sum_and_count(td.orders_panel(spark, sf), R, "rate", "prior_sum", "prior_n")
    return df.select("orderkey", "prior_sum", "prior_n")


@query("prior_rolling_means", "WN4", f"""WITH {td.ORDERS}
SELECT orderkey,
       sum(coalesce(rate, 0.0E0)) OVER ({W} 3 PRECEDING AND 1 PRECEDING)
         / nullif(count(*) OVER ({W} 3 PRECEDING AND 1 PRECEDING), 0) AS r3,
       sum(coalesce(rate, 0.0E0)) OVER ({W} 8 PRECEDING AND 1 PRECEDING)
         / nullif(count(*) OVER ({W} 8 PRECEDING AND 1 PRECEDING), 0) AS r8 FROM orders_panel""")
def _(spark, sf):
    specs = [Spec("r3", "rolling", "rate", 3), Spec("r8", "rolling", "rate", 8)]
    return wn.history(td.orders_panel(spark, sf), R, specs).select("orderkey", "r3", "r8")


@query("prior_ordinals", "WN5", f"""WITH {td.ORDERS}
SELECT orderkey, row_number() OVER (PARTITION BY custkey ORDER BY era, ordered_at, orderkey) - 1 AS games_prior,
       row_number() OVER (PARTITION BY custkey, era ORDER BY ordered_at, orderkey) - 1 AS games_prior_era
FROM orders_panel""")
def _(spark, sf):
    df = wn.prior_ordinals(td.orders_panel(spark, sf), R)
    return df.select("orderkey", "games_prior", "games_prior_era")


@query("era_to_date_mean", "WN6", f"""WITH {td.ORDERS}
SELECT orderkey, sum(coalesce(rate, 0.0E0)) OVER w / nullif(count(*) OVER w, 0) AS std_mean
FROM orders_panel
WINDOW w AS (PARTITION BY custkey, era ORDER BY ordered_at, orderkey ROWS BETWEEN {BEFORE})""")
def _(spark, sf):
    df = wn.era_to_date_mean(td.orders_panel(spark, sf), R, "rate", "std_mean")
    return df.select("orderkey", "std_mean")


@query("expanding_mean_of_era_means", "WN7 AG13", f"""WITH {td.ORDERS},
m AS (SELECT segment, era, sum(cents) / count(cents) AS mean_cents FROM orders_panel GROUP BY segment, era)
SELECT segment, era, round(sum(mean_cents) OVER (PARTITION BY segment ORDER BY era ROWS BETWEEN {BEFORE})
       / count(mean_cents) OVER (PARTITION BY segment ORDER BY era ROWS BETWEEN {BEFORE}), 3) AS prior_cents
FROM m""")
def _(spark, sf):
    df = wn.expanding_era_prior(td.orders_panel(spark, sf), ["segment"], "era", ["cents"])
    return df.select("segment", "era", F.round("prior_cents", 3).alias("prior_cents"))


_GROUP_SQL = f"""WITH {td.PANEL},
g AS (SELECT game_id, team, any_value(season) AS season, any_value(week) AS week,
             max(off_snaps) AS off_snaps, max(carries) AS carries FROM panel GROUP BY game_id, team)
SELECT game_id, team,
       sum(off_snaps) OVER (w ROWS BETWEEN {BEFORE}) / nullif(count(*) OVER (w ROWS BETWEEN {BEFORE}), 0) AS prior_snaps,
       sum(carries) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
         / nullif(count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS r4_carries
FROM g WINDOW w AS (PARTITION BY team ORDER BY season, week, game_id)"""


def _group_history(spark, sf, hot_rows=None):
    from pitpanel.roles import PLAYER_PANEL

    df = wn.deduped_group_history(
        td.panel(spark, sf), PLAYER_PANEL, ["off_snaps", "carries"],
        {"prior_snaps": "off_snaps"}, {"r4_carries": ("carries", 4)}, hot_rows,
    )
    return df.select("game_id", "team", "prior_snaps", "r4_carries")


@query("group_history_on_deduped_rows", "WN8", _GROUP_SQL)
def _(spark, sf):
    return _group_history(spark, sf)


@query("group_history_split_runs", "WN8", _GROUP_SQL)
def _(spark, sf):
    """Same result with every group cut into runs of at most 100 rows."""
    return _group_history(spark, sf, hot_rows=100)


@query("whole_partition_mean", "WN9", f"""WITH {td.ORDERS}
SELECT o.orderkey, m.segment_mean FROM orders_panel o
JOIN (SELECT segment, sum(cents) / count(*) AS segment_mean FROM orders_panel GROUP BY segment) m USING (segment)""")
def _(spark, sf):
    df = wn.with_partition_mean(td.orders_panel(spark, sf), ["segment"], "cents", "segment_mean")
    return df.select("orderkey", "segment_mean")


_NATION_SQL = f"""WITH {td.ORDERS}
SELECT orderkey, sum(coalesce(rate, 0.0E0)) OVER ({N} {BEFORE}) / nullif(count(*) OVER ({N} {BEFORE}), 0) AS career,
       sum(rate) OVER ({N} {BEFORE}) / nullif(count(rate) OVER ({N} {BEFORE}), 0) AS present,
       coalesce(sum(rate) OVER ({N} {BEFORE}), 0.0E0) AS total,
       sum(coalesce(rate, 0.0E0)) OVER ({N} 8 PRECEDING AND 1 PRECEDING)
         / nullif(count(*) OVER ({N} 8 PRECEDING AND 1 PRECEDING), 0) AS r8,
       sum(coalesce(rate, 0.0E0)) OVER e / nullif(count(*) OVER e, 0) AS std
FROM orders_panel WINDOW e AS (PARTITION BY nation, era ORDER BY ordered_at, orderkey ROWS BETWEEN {BEFORE})"""

_NATION_SPECS = [
    Spec("career", "mean", "rate"),
    Spec("present", "mean_present", "rate"),
    Spec("total", "sum", "rate"),
    Spec("r8", "rolling", "rate", 8),
    Spec("std", "mean", "rate", within=("era",)),
]


@query("prior_windows_few_large_keys", "WN1 WN2 WN3 WN4 WN6", _NATION_SQL)
def _(spark, sf):
    """25 keys for the whole table: every key is cut into runs of at most 200 rows."""
    df = wn.history(td.orders_panel(spark, sf), R, _NATION_SPECS, ["nation"], hot_rows=200)
    return df.select("orderkey", "career", "present", "total", "r8", "std")


@query("latest_snapshot", "WN10", f"""WITH {td.EVENTS}
SELECT user_id, event_type, event_id, cents FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM ev)
WHERE rn = 1""")
def _(spark, sf):
    df = td.events(spark, sf).select("user_id", "event_type", "ts", "event_id", "cents")
    return wn.latest(df, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("rows_at_latest_stamp", "WN11", f"""WITH {td.ORDERS}
SELECT o.nation, o.orderkey FROM orders_panel o
JOIN (SELECT nation, max(ordered_at) AS m FROM orders_panel GROUP BY nation) x
ON o.nation = x.nation AND o.ordered_at = x.m""")
def _(spark, sf):
    df = wn.rows_at_latest(td.orders_panel(spark, sf), ["nation"], "ordered_at")
    return df.select("nation", "orderkey")


@query("latest_strictly_before_event", "WN12", f"""WITH {td.EVENTS},
s AS (SELECT *, date_trunc('day', ts) + INTERVAL 12 HOUR AS start_at, CAST(ts AS DATE) AS day FROM ev)
SELECT user_id, event_type, day, event_id, cents FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY ts DESC, event_id DESC) AS rn
  FROM s WHERE ts < start_at) WHERE rn = 1""")
def _(spark, sf):
    df = td.events(spark, sf).select(
        "user_id", "event_type", F.to_date("ts").alias("day"), "ts", "event_id", "cents",
        (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("start_at"),
    )
    got = wn.latest_before(df, ["user_id", "event_type", "day"], "ts", "start_at", ["event_id"])
    return got.drop("ts", "start_at")


@query("first_seen_wins", "WN13", f"""WITH {td.EVENTS}
SELECT user_id, event_type, event_id, cents FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM ev)
WHERE rn = 1""")
def _(spark, sf):
    df = td.events(spark, sf).select("user_id", "event_type", "ts", "event_id", "cents")
    return wn.first_seen(df, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("ladder_collapse", "WN14", f"""WITH {td.EVENTS}
SELECT user_id, event_type, event_id, k FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type
            ORDER BY CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS rn FROM ev)
WHERE rn = 1""")
def _(spark, sf):
    df = td.events(spark, sf).select("user_id", "event_type", "ts", "event_id", "k")
    got = wn.collapse_ladder(df, ["user_id", "event_type"], F.col("k") % 3 != 0, ["ts", "event_id"])
    return got.drop("ts")


@query("current_era_and_period", "WN15 AG27", f"""WITH {td.ORDERS},
f AS (SELECT era, min(ordered_at) AS first_at FROM orders_panel GROUP BY era)
SELECT 'era' AS what, coalesce(max(CASE WHEN first_at <= TIMESTAMP '1999-12-01' + INTERVAL 45 DAY THEN era END), min(era)) AS value FROM f
UNION ALL
SELECT 'period', coalesce(min(CASE WHEN ordered_at >= TIMESTAMP '2000-05-20' THEN month(ordered_at) END), max(month(ordered_at)))
FROM orders_panel WHERE era = 2000""")
def _(spark, sf):
    o = td.orders_panel(spark, sf)
    era = wn.current_era(o, "era", "ordered_at", F.expr("TIMESTAMP_NTZ '1999-12-01 00:00:00'"))
    in_era = o.where("era = 2000").withColumn("month", F.month("ordered_at").cast("bigint"))
    per = wn.current_period(in_era, "month", "ordered_at", F.expr("TIMESTAMP_NTZ '2000-05-20 00:00:00'"))
    return era.select(F.lit("era").alias("what"), F.col("current_era").alias("value")).unionByName(
        per.select(F.lit("period").alias("what"), F.col("current_period").alias("value"))
    )


_BIN_SQL = f"""WITH {td.ORDERS},
r AS (SELECT segment, cents, orderkey % 1000 AS y, row_number() OVER (PARTITION BY segment ORDER BY cents, orderkey) AS rn,
             count(*) OVER (PARTITION BY segment) AS n FROM orders_panel),
b AS (SELECT *, greatest(5, least(50, n // 60)) AS bins FROM r),
edges AS (SELECT DISTINCT segment, n, bins, i, CAST(floor(i * n / bins) AS BIGINT) AS lo,
                 CAST(floor((i + 1) * n / bins) AS BIGINT) AS hi
          FROM (SELECT DISTINCT segment, n, bins FROM b), generate_series(0, 49) g(i) WHERE i < bins)
SELECT b.segment, e.i AS bin, count(*) AS n, sum(cents) / count(*) AS mean_x, sum(y) / count(*) AS mean_y
FROM b JOIN edges e ON b.segment = e.segment AND b.rn - 1 >= e.lo AND b.rn - 1 < e.hi
GROUP BY b.segment, e.i HAVING count(*) >= 60"""


@query("equal_count_bins", "WN16", _BIN_SQL)
def _(spark, sf):
    o = td.orders_panel(spark, sf).withColumn("y", (F.col("orderkey") % 1000).cast("double"))
    return wn.equal_count_bins(o, ["segment"], "cents", "y", ["orderkey"])


@query("equal_count_bins_split_runs", "WN16", _BIN_SQL)
def _(spark, sf):
    """Ranks computed in runs of at most 500 rows."""
    o = td.orders_panel(spark, sf).withColumn("y", (F.col("orderkey") % 1000).cast("double"))
    return wn.equal_count_bins(o, ["segment"], "cents", "y", ["orderkey"], hot_rows=500)


_QBIN_SQL = f"""WITH {td.ORDERS},
q AS (SELECT segment, quantile_cont(cents, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS edges
      FROM orders_panel GROUP BY segment)
SELECT o.segment, CAST(greatest(len(list_filter(q.edges, lambda v: v < o.cents)), 1) - 1 AS BIGINT) AS bin,
       count(*) AS n, sum(cents) AS total
FROM orders_panel o JOIN q ON o.segment = q.segment GROUP BY 1, 2"""


@query("quantile_bins", "WN17", _QBIN_SQL)
def _(spark, sf):
    df = wn.quantile_bins(td.orders_panel(spark, sf), ["segment"], "cents")
    return df.groupBy("segment", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total")
    )


@query("quantile_bins_split_runs", "WN17", _QBIN_SQL)
def _(spark, sf):
    """Edges from accumulated value counts instead of one percentile buffer per key."""
    df = wn.quantile_bins(td.orders_panel(spark, sf), ["segment"], "cents", hot_rows=500)
    return df.groupBy("segment", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total")
    )
