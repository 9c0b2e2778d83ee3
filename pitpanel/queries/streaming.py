"""Streaming queries over the events table; SQL checks the batch meaning."""

import os

from pyspark.sql import functions as F

from pitpanel import testdata as td
from pitpanel.queries import query
from pitpanel.streaming import jobs


def stream(spark, sf):
    path = os.path.join(sf, "events.parquet")
    schema = spark.read.parquet(path).schema
    # A one-letter pattern makes the single file a streaming source.
    return jobs.file_stream(spark, os.path.join(sf, "event[s].parquet"), schema)


def stamped(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_snapshot_period_assignment", "SM1 JN7", f"""WITH {td.EVENTS}
SELECT s.event_id, g.event_id AS next_id FROM ev s ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') g ON s.user_id = g.user_id AND s.ts <= g.ts""")
def _(spark, sf):
    kicks = td.table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    snaps = stream(spark, sf).select("event_id", "user_id", "ts")
    got = jobs.assign_periods(snaps, kicks, ["user_id"], "ts", "ts", {"event_id": "next_id"}, "event_id")
    return got.select("event_id", "next_id")


@query("stream_first_seen_freeze", "SM2 WN13", f"""WITH {td.EVENTS}
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM ev) WHERE rn = 1""")
def _(spark, sf):
    got = jobs.freeze_stream(stream(spark, sf), ["user_id", "event_type"], ["ts", "event_id"])
    return got.select("user_id", "event_type", "event_id")


@query("stream_tumbling_counts", "SM3 AG20", f"""WITH {td.EVENTS}
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM ev GROUP BY 1, 2""")
def _(spark, sf):
    got = jobs.window_counts(stamped(stream(spark, sf)), "ts", ["event_type"], "1 hour")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_sliding_counts", "SM3", f"""WITH {td.EVENTS}, s AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * i AS start, event_type FROM ev, generate_series(0, 1) g(i))
SELECT start, event_type, count(*) AS n FROM s GROUP BY 1, 2""")
def _(spark, sf):
    got = jobs.window_counts(stamped(stream(spark, sf)), "ts", ["event_type"], "2 hours", "1 hour")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_session_bursts", "SM3", f"""WITH {td.EVENTS},
g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM i GROUP BY user_id, k""")
def _(spark, sf):
    """Bursts of each user's events with half an hour between them, those still open at the end of the stream included."""
    got = jobs.session_bursts(stamped(stream(spark, sf)).select("user_id", "ts"), "ts", ["user_id"], "30 minutes")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
