"""Repeated hours as the SQL reads them, one JSON text per snapshot file, and steps that no longer grow faster than their input."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitpanel.functions import schedule as sc
from pitpanel.queries import load_all


def test_the_repeated_hour_may_be_read_as_standard_time(spark):
    rows = [("2026-11-01", "01:30"), ("2026-11-01", "00:30"), ("2026-11-01", "02:30"), ("2026-03-08", "02:30"), ("2026-09-13", "13:00"), (None, "13:00")]
    df = spark.createDataFrame(rows, "d string, t string")
    second = sc.kickoff_utc(F.col("d"), F.col("t"), repeated="second")
    got = [r[0] for r in df.select(second).collect()]
    want = ["2026-11-01 06:30", "2026-11-01 04:30", "2026-11-01 07:30", "2026-03-08 07:00", "2026-09-13 17:00", None]
    assert [g and g.strftime("%Y-%m-%d %H:%M") for g in got] == want
    with pytest.raises(ValueError):
        sc.kickoff_utc(F.col("d"), F.col("t"), repeated="third")


def test_kickoffs_in_the_repeated_hour_equal_their_sql(spark, tmp_path):
    import duckdb

    rows = [(24 * i + h, datetime(y, 10, d)) for i, (y, d) in enumerate([(1995, 29), (1996, 27), (1997, 26)]) for h in range(4)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    q = load_all()["kickoff_and_lock_times"]
    got = sorted(tuple(r) for r in q.run(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == sorted(con.execute(q.sql).fetchall())


def test_snapshots_of_a_day_in_several_texts_are_all_read(spark, tmp_path, monkeypatch):
    from pitpanel.queries import files

    monkeypatch.setattr(files, "SNAPSHOT_ROWS", 10)
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=i), i % 7, "view", 1.0, '{"k": %d}' % i) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = load_all()["snapshot_history_scan"].run(spark, str(tmp_path))
    assert sorted(r.line for r in got.collect()) == [i + 0.5 for i in range(300)]


def test_a_quantile_between_equal_values_is_that_value(spark):
    from pitpanel.operators.ordered import quantiles

    df = spark.createDataFrame([("k", 0.1 + 0.2)] * 500, "k string, v double")
    probs = [i / 100 for i in range(101)]
    assert set(quantiles(df, ["k"], "v", probs, hot_rows=50).first().quantiles) == {0.1 + 0.2}


def test_bins_cut_through_ties_as_the_order_says(spark):
    """Few distinct values, so that every edge cuts one; nulls come first, and a tie column is itself tied."""
    from pitpanel.operators import windows as wn

    rows = [("k", None if i % 50 == 0 else float((i * 7) % 3), float(i % 11), "g%02d" % ((i * 13) % 17), i % 29) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x double, y double, g string, i int")
    got = {r.bin: (r.n, r.mean_y) for r in wn.equal_count_bins(df, ["k"], "x", "y", ["g", "i"], hot_rows=100).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[3], r[4]))
    nb, n = 33, len(rows)
    bins = {}
    for r, row in enumerate(order):
        bins.setdefault(((r + 1) * nb - 1) // n, []).append(row)
    assert {b: v[0] for b, v in got.items()} == {b: len(v) for b, v in bins.items() if len(v) >= 60}
    whole = {b for b, v in bins.items() if b in got and len({r[1:2] + r[3:] for r in v}) == len(v)}
    for b in whole:
        assert got[b][1] == pytest.approx(sum(r[2] for r in bins[b]) / len(bins[b]))


def test_levelled_rows_equal_the_expression(spark):
    from pitpanel.functions.prob import apply_level
    from pitpanel.operators import calibrate as cp

    maps = spark.createDataFrame([("a", [0.0, 1.0, 1.0, 3.0], [0.5, 1.0, 2.0, 2.5]), ("b", None, None), ("c", [-2.0, -1.0], [1.0, 0.5])], "k string, grid array<double>, mapped array<double>")
    rows = [(k, None if i == 0 else i / 4 - 3) for k in "abcd" for i in range(32)]
    df = spark.createDataFrame(rows, "k string, p double").withColumn("raw", F.col("p"))
    got = sorted((r.k, str(r.raw), r.p) for r in cp.levelled(df, maps, "k", "p").collect() if r.raw is not None)
    want = df.join(maps, "k").where("raw IS NOT NULL").select("k", "raw", apply_level(F.col("p"), F.col("grid"), F.col("mapped")).alias("p")).collect()
    assert got == sorted((r.k, str(r.raw), r.p) for r in want)
