import json

import pytest
from pyspark.sql import functions as F

from pitpanel.sources import keyed


def rows(df):
    return sorted(tuple(r) for r in df.select("k", "v").collect())


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "t")


def test_upsert_replaces_and_keeps(spark, path):
    assert keyed.read(spark, path) is None
    first = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    m = keyed.upsert(first, path, ["k"], buckets=8)
    assert (m.version, m.buckets, len(m.writes)) == (1, 8, 8) and rows(keyed.read(spark, path)) == [(i, "a") for i in range(100)]
    two = spark.createDataFrame([(5, "b", 1), (5, "c", 2), (200, "d", 0)], "k long, v string, o int")
    keyed.upsert(two, path, ["k"], ["o"])
    got = dict(rows(keyed.read(spark, path)))
    assert got[5] == "c" and got[200] == "d" and got[6] == "a" and len(got) == 101
    with pytest.raises(ValueError):
        keyed.upsert(two, path, ["v"])


def test_untouched_buckets_are_neither_read_nor_written(spark, path):
    first = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    before = keyed.upsert(first, path, ["k"], buckets=16)
    one = spark.createDataFrame([(7, "z")], "k long, v string")
    b = keyed.touched(one, ["k"], 16)
    files = keyed.read(spark, path, b).inputFiles()
    assert len(b) == 1 and all(f"bucket={b[0]}/" in f for f in files) and len(files) < len(keyed.read(spark, path).inputFiles())
    after = keyed.upsert(one, path, ["k"])
    assert {k for k in after.writes if after.writes[k] != before.writes[k]} == set(b)


def test_add_missing_builds_only_new_keys(spark, path):
    seen = []
    build = lambda d: (seen.append(d.count()), d.withColumn("v", F.lit(str(len(seen)))))[1]
    ids = lambda n: spark.range(n).select(F.col("id").alias("k"))
    keyed.add_missing(ids(10), path, ["k"], build, buckets=4)
    m = keyed.add_missing(ids(15), path, ["k"], build)
    assert seen == [10, 5] and dict(rows(keyed.read(spark, path))) == {i: "1" if i < 10 else "2" for i in range(15)}
    assert any(len(w) == 2 for w in m.writes.values())  # added beside, nothing rewritten
    keyed.add_missing(ids(15), path, ["k"], build)
    assert seen[-1] == 0 and keyed.read(spark, path).count() == 15


def test_crash_before_the_manifest_leaves_the_old_table(spark, path, monkeypatch):
    keyed.upsert(spark.createDataFrame([(1, "a")], "k long, v string"), path, ["k"])
    with monkeypatch.context() as m:
        m.setattr(keyed, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            keyed.upsert(spark.createDataFrame([(1, "b")], "k long, v string"), path, ["k"])
    assert rows(keyed.read(spark, path)) == [(1, "a")]
    keyed.upsert(spark.createDataFrame([(1, "c")], "k long, v string"), path, ["k"])
    assert rows(keyed.read(spark, path)) == [(1, "c")]


def test_two_writers_from_one_version_conflict(spark, path):
    m = keyed.upsert(spark.createDataFrame([(1, "a")], "k long, v string"), path, ["k"])
    keyed.upsert(spark.createDataFrame([(2, "b")], "k long, v string"), path, ["k"])
    with pytest.raises(keyed.Conflict):
        keyed._commit(spark, path, keyed.Manifest(m.version + 1, m.buckets, m.keys, m.writes))
    assert rows(keyed.read(spark, path)) == [(1, "a"), (2, "b")] and json.dumps(m.note) == "{}"


def test_empty_and_null_keys(spark, path):
    df = spark.createDataFrame([(None, "n"), (1, "a")], "k long, v string")
    keyed.upsert(df.limit(0), path, ["k"])
    assert keyed.read(spark, path) is None or keyed.read(spark, path).count() == 0
    keyed.upsert(df, path, ["k"])
    keyed.upsert(df.where("k IS NULL").withColumn("v", F.lit("m")), path, ["k"])
    assert {tuple(r) for r in keyed.read(spark, path).select("k", "v").collect()} == {(None, "m"), (1, "a")}


def test_bursts_left_open_are_flushed_once(spark, tmp_path):
    from pitpanel.streaming import jobs

    ddl = "u int, ts timestamp"
    src, home = str(tmp_path / "in"), str(tmp_path / "home")
    at = lambda *m: [(u, f"2024-01-01 {x // 60:02d}:{x % 60:02d}:00") for u, x in m]
    put = lambda r: spark.createDataFrame(r, "u int, t string").select("u", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(src)
    put(at((1, 0), (1, 10), (2, 5)))
    run = lambda flush=True: sorted((r.u, r.n) for r in jobs.session_bursts(jobs.file_stream(spark, src, spark.createDataFrame([], ddl).schema), "ts", ["u"], "20 minutes", "1 minute", home, flush).collect())
    assert run() == [(1, 2), (2, 1)]
    put(at((1, 15), (2, 600)))
    assert run() == [(1, 3), (2, 1), (2, 1)]  # the open burst of user 1 went on
