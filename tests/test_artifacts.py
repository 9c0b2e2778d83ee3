"""Contract, sinks, readers, models, projection and streams."""

import os

import pytest
from pyspark.sql import functions as F

from pitpanel import contract, testdata as td
from pitpanel.operators import models as ml, quality as dq
from pitpanel.plans import blocks as fb, project as pj
from pitpanel.sources import sinks, tables
from pitpanel.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    assert contract.buckets_disjoint()
    with pytest.raises(contract.ContractError):
        contract.place("mystery")
    for c in ("off_plays", "def_allowed_plays", "realized_mean_wp", "targets", "temp", "wind", "ngs_efficiency"):
        assert contract.place(c) in contract.OPEN_ONLY_AFTERWARDS
    cols = ["gsis_id", "team_implied_total", "team_spread", "is_home", "rest_days", "roof_type", "div_game", "targets", "off_plays", "temp", "routes_run_proxy"]
    df = contract.annotate(spark.createDataFrame([], ", ".join(f"{c} string" for c in cols)))
    assert contract.columns_in(df.schema) == cols[1:7]
    assert contract.columns_in(df.schema, contract.OPEN_ONLY_AFTERWARDS) == ["targets", "off_plays", "temp", "routes_run_proxy"]
    assert sum(contract.sizes(df.schema).values()) == len(cols)
    serving = spark.createDataFrame([], "gsis_id string, team_implied_total double")
    assert "is_home" in contract.parity_gap(df.schema, serving.schema)
    leak = spark.createDataFrame([], "f_career_routes_run_proxy double, f_career_targets double")
    assert contract.training_only_features(leak.schema) == ["f_career_routes_run_proxy"]


def test_feature_selection(spark):
    cols = "f_career_targets double, f_dvp_targets double, is_home int, roof_type string, depth_rank double, depth_rank_capped double, age double, roof_indoor double, wx_temp double, targets double"
    schema = spark.createDataFrame([], cols).schema
    assert contract.feature_columns(schema, "targets") == ["f_career_targets", "f_dvp_targets", "is_home", "depth_rank_capped", "age"]
    assert contract.feature_columns(schema, "attempts") == ["f_career_targets", "is_home", "depth_rank_capped", "age"]
    cfg = fb.Config(bio=False, venue=True, weather=True, depth_rank=False)
    assert contract.feature_columns(schema, "targets", cfg) == ["f_career_targets", "f_dvp_targets", "is_home", "roof_indoor", "wx_temp"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.guarded_write(a, path)
    assert not sinks.guarded_write(a.limit(0), path)
    sinks.upsert_latest(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), path, ["k"])
    os.makedirs(tmp_path / "t" / "version=9")
    assert sinks.versions(spark, path) == [1, 2]
    assert sorted(map(tuple, sinks.read_latest(spark, path).collect())) == [(1, "a"), (2, "z"), (3, "c")]
    with pytest.raises(ValueError):
        sinks.gate_then_write(a, str(tmp_path / "g"), False, "no")
    assert not (tmp_path / "g").exists()


def test_readers(spark, tmp_path):
    cat = tables.Catalog(spark, str(tmp_path))
    with pytest.raises(tables.MissingTable):
        cat.dimension("schedules")
    assert cat.dimension("players") is None
    ngs = spark.createDataFrame([(2024, 0, "REG", 1.0), (2024, 1, "REG", float("nan")), (2024, 1, "POST", 2.0)], "season int, week int, season_type string, x double")
    ngs.write.parquet(cat.path("ngs_rushing"))
    assert [(r["week"], r["x"]) for r in cat.tracking("rushing").collect()] == [(1, None)]
    with pytest.raises(ValueError):
        cat.tracking("kicking")
    p = spark.createDataFrame([(2015, 1), (2020, 2)], "season int, v int")
    p.write.partitionBy("season").parquet(cat.path("participation"))
    assert [r["v"] for r in cat.fact("participation").collect()] == [2]
    assert cat.fact("participation", [2010, 2015]) is None
    plan = cat.fact("participation", [2020])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    off = spark.createDataFrame([("7", "REG", "Referee", "R"), ("7", "REG", "Umpire", "U")], "game_id string, season_type string, position string, official_name string")
    off.write.parquet(cat.path("officials"))
    assert [tuple(r) for r in cat.officials().collect()] == [("7", "R")]
    (tmp_path / "o.csv").write_text("stadium_id,lat\nA,1.5\nB,oops\n")
    got = tables.csv_overlay(spark, str(tmp_path / "o.csv"), "stadium_id string, lat double").collect()
    assert [tuple(r) for r in got] == [("A", 1.5), ("B", None)]
    assert tables.csv_overlay(spark, str(tmp_path / "none.csv"), "a string").count() == 0


def panel_rows(spark):
    rows = []
    for e in range(12):
        for s in range(3):
            for w in range(8):
                v = float((e + w * s) % 6)
                rows.append((2020 + s, w + 1, f"{2020 + s}_{w}", f"T{e % 2}", f"T{(e + 1) % 2}", f"p{e}", ["WR", "QB"][e % 2], 1.0, v, v * 8 + e % 3, 10.0, 10.0))
    return spark.createDataFrame(rows, "season int, week int, game_id string, team string, opponent_team string, gsis_id string, position string, depth_rank_capped double, targets double, receiving_yards double, off_pass_att double, off_designed_rush double")


def test_walk_forward_protocol(spark):
    p = panel_rows(spark)
    priors = {k: 1.0 for k in ("catch_rate", "yards_per_target", "yards_per_carry", "yards_per_attempt", "completion_rate", "rec_td_per_target", "rush_td_per_carry")}
    h = fb.entity_block(p, priors)
    cols = ["f_career_targets", "f_std_targets", "f_games_prior"]
    h = pj.latest(h, ["gsis_id", "game_id"], ["season"])
    out = ml.walk_forward(lambda era: h.where(F.col("season") <= era), "targets", [2021, 2022], cols, p=ml.Params(rounds=2), min_train=20, min_test=20)
    rows = out.collect()
    assert {r["season"] for r in rows} == {2021, 2022}
    assert all(r["trained_through"] < r["season"] and r["pred"] >= 0 and r["abs_err_model"] == abs(r["pred"] - r["actual"]) for r in rows)
    assert dq.require(dq.out_of_sample(out)).count() == 1
    model = ml.fit(h, "targets", cols, "count")
    with pytest.raises(ml.MissingFeature):
        ml.predict(model, h.drop("f_std_targets"), cols, "pred")
    per = ml.predict(model, h, cols, "pred", ["WR"])
    assert per.where("position = 'QB' AND pred IS NOT NULL").count() == 0


def test_estimand_metadata_refuses_the_wrong_sum(spark):
    df = ml.estimands(spark.createDataFrame([(2.0, 0.5)], "raw double, p_play double"), "targets", "raw")
    assert tuple(df.select("targets", "targets_expected").first()) == (2.0, 1.0)
    with pytest.raises(dq.CheckFailed):
        dq.refuse_wrong_sum(df, "targets")
    dq.refuse_wrong_sum(df, "targets_expected")


def test_projection_equals_history_features(spark):
    """Serving and training build the same numbers for the same rows."""
    p = panel_rows(spark)
    priors = {k: 1.0 for k in ("catch_rate", "yards_per_target", "yards_per_carry", "yards_per_attempt", "completion_rate", "rec_td_per_target", "rush_td_per_carry")}
    team = p.groupBy("season", "week", "game_id", "team").agg(F.first("opponent_team").alias("opponent"), F.sum("targets").alias("off_plays"), F.avg("targets").alias("off_proe"), F.sum("targets").alias("def_allowed_plays"))
    league = p.groupBy("season").agg(F.avg("targets").alias("league_off_proe"))
    full = fb.build(p, team, league, priors)
    outcome = ["targets", "receiving_yards", "off_pass_att", "off_designed_rush"]
    future = p.where("season = 2022 AND week = 5").drop(*outcome)
    live = pj.project(p, future, team, league, priors)
    f = sorted(c for c in full.columns if c.startswith("f_"))
    a = {tuple(r) for r in full.where("season = 2022 AND week = 5").select("gsis_id", *f).collect()}
    b = {tuple(r) for r in live.select("gsis_id", *f).collect()}
    assert a == b and len(a) == 12


def test_unplayed_rows_are_no_history(spark):
    """Several future rows per entity, in one period and over two, all see the same past."""
    p = panel_rows(spark)
    priors = {k: 1.0 for k in ("catch_rate", "yards_per_target", "yards_per_carry", "yards_per_attempt", "completion_rate", "rec_td_per_target", "rush_td_per_carry")}
    team = p.groupBy("season", "week", "game_id", "team").agg(F.first("opponent_team").alias("opponent"), F.sum("targets").alias("off_plays"), F.avg("targets").alias("off_proe"), F.sum("targets").alias("def_allowed_plays"))
    league = p.groupBy("season").agg(F.avg("targets").alias("league_off_proe"))
    last = p.where("season = 2022 AND week = 5").drop("targets", "receiving_yards", "off_pass_att", "off_designed_rush")
    game = dict(last.dtypes)["game_id"]
    twice = last.withColumn("game_id", F.concat(F.col("game_id").cast("string"), F.lit("1" if game != "string" else "b")).cast(game))
    later = last.withColumn("week", F.col("week") + 1)
    live = pj.project(p.where("NOT (season = 2022 AND week >= 5)"), last.union(twice.select(last.columns)).union(later), team.where("NOT (season = 2022 AND week >= 5)"), league, priors)
    f = sorted(c for c in live.columns if c.startswith("f_"))
    rows = live.select("gsis_id", *f)
    assert rows.count() == 3 * last.count() and rows.distinct().count() == last.count()


def test_streams_agree_with_batch(spark, tmp_path):
    from pitpanel.operators.windows import first_seen

    e = td.events(spark, SF)
    src = str(tmp_path / "in")
    for i in range(3):
        e.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    stream = jobs.file_stream(spark, src, e.schema)
    got = jobs.freeze_stream(stream.where("event_type <> 'x'"), ["user_id", "event_type"], ["ts", "event_id"])
    assert got.groupBy("user_id", "event_type").count().where("count > 1").count() == 0
    assert got.count() == first_seen(e, ["user_id", "event_type"], ["ts", "event_id"]).count()
    z = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = jobs.window_counts(z, "ts", ["event_type"], "1 hour", late="60 days")
    assert counts.agg(F.sum("n")).first()[0] == e.count()
    once = jobs.freeze_expiring(z, ["user_id", "event_type"], "ts", "60 days")
    assert once.count() == got.count()
    assert jobs.session_bursts(z, "ts", ["user_id"], "30 minutes").agg(F.sum("n")).first()[0] <= e.count()


def test_a_stopped_stream_goes_on(spark, tmp_path):
    from pitpanel.operators.windows import first_seen

    e = td.events(spark, SF)
    src, home = str(tmp_path / "in"), str(tmp_path / "home")
    for i in range(3):
        e.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
        got = jobs.freeze_stream(jobs.file_stream(spark, src, e.schema), ["user_id", "event_type"], ["ts", "event_id"], home)
        seen = e.where(F.col("event_id") % 3 <= i).select("user_id", "event_type").distinct().count()
        assert got.count() == seen == got.select("user_id", "event_type").distinct().count()
    assert got.count() == first_seen(e, ["user_id", "event_type"], ["ts", "event_id"]).count()


def test_late_schedule_files_are_seen(spark, tmp_path):
    e = td.events(spark, SF).select("event_id", "user_id", "ts")
    src, plan, home = (str(tmp_path / x) for x in ("in", "plan", "home"))
    e.where("event_id % 2 = 0").coalesce(1).write.parquet(src)
    e.limit(0).write.parquet(plan)
    run = lambda: jobs.assign_periods(jobs.file_stream(spark, src, e.schema), lambda: spark.read.parquet(plan), ["user_id"], "ts", "ts", {"event_id": "next_id"}, "event_id", home)
    assert run().where("next_id IS NOT NULL").count() == 0
    e.write.mode("append").parquet(plan)
    e.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    assert run().where("next_id IS NOT NULL").count() == e.where("event_id % 2 = 1").count()


def test_two_writers_get_two_versions(spark, tmp_path):
    from pitpanel.sources import sinks

    path = str(tmp_path / "t")
    first = sinks.claim_version(spark, path)
    assert sinks.write_version(spark.range(3), path) == first + 1 and sinks.versions(spark, path) == [first + 1]


def test_checkpoint_folder_comes_from_the_session(spark):
    from pitpanel.session import scratch_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        assert scratch_dir(spark) == named
    else:
        assert scratch_dir(spark).startswith("/tmp/spark-") and scratch_dir(spark) == scratch_dir(spark)
