import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitpanel.functions import schedule as sc
from pitpanel.operators import joins as jn, shape as sh, windows as wn
from pitpanel.plans import project as pj
from pitpanel.sources.groups import ALIASES, GROUPS, canonical


@pytest.mark.parametrize("spread,total,home,away", [(7.0, 49.5, 28.25, 21.25), (-2.5, 47.5, 22.5, 25.0), (None, 44.0, None, None)])
def test_implied_totals(spark, spread, total, home, away):
    df = spark.createDataFrame([(spread, total)], "spread_line double, total_line double")
    r = sc.implied_totals(df).first()
    assert (r["home_implied_total"], r["away_implied_total"]) == (home, away)


def test_kickoff_time_zones(spark):
    rows = [
        ("2026-09-13", "13:00"), ("2026-09-13", None), ("2026-09-13", ""), ("2026-11-01", "01:30"),
        ("2026-03-08", "02:30"), ("2026-12-13", "20:20"), ("not a day", "13:00"), (None, "13:00"),
    ]
    df = spark.createDataFrame(rows, "d string, t string")
    got = [r[0] for r in df.select(sc.kickoff_utc(F.col("d"), F.col("t"))).collect()]
    want = ["2026-09-13 17:00", "2026-09-13 17:00", "2026-09-13 17:00", "2026-11-01 05:30", "2026-03-08 07:00", "2026-12-14 01:20", None, None]
    assert [g and g.strftime("%Y-%m-%d %H:%M") for g in got] == want


def test_window_labels(spark):
    rows = [
        ("2026-09-10", "20:20", "Thursday night"), ("2026-12-19", "16:30", "Saturday"), ("2026-10-04", "09:30", "Sunday morning"),
        ("2026-09-13", "13:00", "Sunday early"), ("2026-09-13", "16:25", "Sunday late"), ("2026-09-13", "20:20", "Sunday night"),
        ("2026-09-14", "20:15", "Monday night"), ("2026-11-27", "15:00", "Friday"),
    ]
    df = spark.createDataFrame(rows, "d string, t string, want string")
    label = sc.window_label(sc.local_kickoff(F.col("d"), F.col("t")))
    assert df.where(label != F.col("want")).count() == 0
    ranks = [r[0] for r in df.select(sc.window_rank(label)).collect()]
    assert ranks == [1, 3, 4, 5, 6, 7, 8, 2]
    assert df.select(sc.window_rank(F.lit("Tuesday"))).first()[0] == 9


def test_current_era_and_period(spark):
    rows = [(2025, 1, "2025-09-04 20:20"), (2026, 1, "2026-09-10 20:20"), (2026, 2, "2026-09-17 20:20"), (2026, 3, "2026-09-24 20:20")]
    g = spark.createDataFrame(rows, "season int, week int, k string").withColumn("kick", F.col("k").cast("timestamp_ntz"))

    def era(day):
        return wn.current_era(g, "season", "kick", F.expr(f"TIMESTAMP_NTZ '{day}'")).first()[0]

    def period(day):
        return wn.current_period(g.where("season = 2026"), "week", "kick", F.expr(f"TIMESTAMP_NTZ '{day}'")).first()[0]

    assert (era("2026-08-31"), era("2026-03-01"), era("1990-01-01")) == (2026, 2025, 2025)
    assert (period("2026-09-15"), period("2026-12-31")) == (2, 3)


def test_codes(spark):
    df = spark.createDataFrame([("LAR",), ("oak ",), ("SD",), ("JAC",), ("KC",), ("XYZ",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(canonical(F.col("c"))).collect()] == ["LA", "LV", "LAC", "JAX", "KC", "XYZ", None, None]
    assert len(GROUPS) == 32 and len(ALIASES) == 21 and set(ALIASES.values()) <= set(GROUPS)


def test_event_resolution(spark):
    games = spark.createDataFrame([("g1", "NE", "SEA"), ("g2", "LV", "LAC")], "game_id string, away_team string, home_team string")
    asked = spark.createDataFrame([("NE", "SEA"), ("SEA", "NE"), ("OAK", "SD"), ("NE", "KC")], "away string, home string")
    got = {(r["away"], r["home"]): r["game_id"] for r in jn.resolve_event(asked, games, canonical).collect()}
    assert got == {("NE", "SEA"): "g1", ("SEA", "NE"): "g1", ("OAK", "SD"): "g2", ("NE", "KC"): None}


def test_overlay_keeps_structure(spark):
    games = spark.createDataFrame([("ATL97", "Old", ""), ("DAL00", "AT&T", "closed"), ("SEA00", "Lumen", "outdoors"), ("ZZZ", "New", "")], "stadium_id string, stadium string, roof string")
    fixes = spark.createDataFrame([("ATL97", "Mercedes-Benz Stadium", "retractable")], "stadium_id string, stadium string, roof_type string")
    got = {r["stadium_id"]: (r["stadium"], r["roof_type"]) for r in sh.overlay(games, fixes, "stadium_id", {"stadium": F.col("stadium"), "roof_type": sh.feed_roof(F.col("roof"))}).collect()}
    assert got == {"ATL97": ("Mercedes-Benz Stadium", "retractable"), "DAL00": ("AT&T", "retractable"), "SEA00": ("Lumen", "outdoors"), "ZZZ": ("New", None)}


def test_field_corrections(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b")], "id int, x double, y string")
    fixes = spark.createDataFrame([(1, "x", "9.5"), (2, "y", "z")], "id int, field string, value string")
    got = sorted(tuple(r) for r in sh.field_corrections(df, fixes, "id", ["x", "y"]).collect())
    assert got == [(1, 9.5, "a"), (2, 3.0, "z")]


def test_snapshots_never_describe_an_earlier_kickoff(spark):
    kicks = spark.createDataFrame([("KC", w, f"2025-09-{7 * w:02d} 17:00:00") for w in (1, 2, 3)], "team string, week int, k string").withColumn("kick", F.col("k").cast("timestamp_ntz"))
    snaps = spark.createDataFrame([(i, "KC", f"2025-09-{d:02d} 09:00:00") for i, d in enumerate(range(1, 28))] + [(99, "XX", "2025-09-01 00:00:00")], "id int, team string, s string").withColumn("dt", F.col("s").cast("timestamp_ntz"))
    got = jn.asof(snaps, kicks, ["team"], "dt", "kick", {"week": "week", "kick": "kick"}, "week").collect()
    for r in got:
        assert r["kick"] is None or r["kick"] >= r["dt"]
    assert {r["week"] for r in got} == {1, 2, 3, None}
    assert all(r["week"] is None for r in got if r["dt"] > dt.datetime(2025, 9, 21, 17) or r["team"] == "XX")


def test_both_roster_layouts(spark):
    old = spark.createDataFrame([(2024, "OAK", 1, "REG", "1", "a", "QB"), (2024, "OAK", 1, "POST", "2", "b", "QB")], "season int, club_code string, week int, game_type string, depth_team string, gsis_id string, position string")
    new = spark.createDataFrame([(2025, "LV", 1, "2025-09-01", "a", "QB", 1), (2025, "LV", 1, "2025-09-03", "a", "QB", 2), (2025, "LV", 1, "2025-09-03", "c", "LT", 1)], "season int, team string, week int, dt string, gsis_id string, pos_abb string, pos_rank int")
    assert [tuple(r) for r in pj.roster_normalized(old).collect()] == [(2024, 1, "LV", "a", "QB", 1.0)]
    assert [tuple(r) for r in pj.roster_normalized(new).collect()] == [(2025, 1, "LV", "a", "QB", 2.0)]
    assert pj.roster_normalized(spark.createDataFrame([(1,)], "odd int")).count() == 0


def test_strict_map_refuses_unknown(spark):
    df = spark.createDataFrame([("dome",), ("tent",), (None,)], "roof_type string")
    with pytest.raises(sh.MappingError):
        sh.strict_map(df, "roof_type", sc.ROOF_CODE, "roof_indoor", 0.0)
    ok = sh.strict_map(df.where("roof_type = 'dome' OR roof_type IS NULL"), "roof_type", sc.ROOF_CODE, "roof_indoor", 0.0)
    assert sorted(r["roof_indoor"] for r in ok.collect()) == [0.0, 2.0]


def test_status(spark):
    now = F.expr("TIMESTAMP_NTZ '2026-09-13 18:00:00'")
    df = spark.createDataFrame([(1.0, 2.0, None), (None, None, "2026-09-13 17:00:00"), (None, 3.0, "2026-09-14 17:00:00"), (None, None, None)], "h double, a double, k string")
    got = [r[0] for r in df.select(sc.game_status(F.col("h"), F.col("a"), F.col("k").cast("timestamp_ntz"), now)).collect()]
    assert got == ["final", "live", "upcoming", "upcoming"]
