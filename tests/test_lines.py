import math

import pytest
from pyspark.sql import functions as F

from pitpanel.functions import prob as pr
from pitpanel.operators import lines as ln
from pitpanel.operators.aggregates import paired_errors
from pitpanel.session import constant_table

LINE = "id int, name string, stat_type string, line double, direction string, odds_type string"


def lines(spark, rows):
    return spark.createDataFrame([(i, n, s, v, d, o) for i, (n, s, v, d, o) in enumerate(rows)], LINE)


def projections(spark):
    rows = [
        ("a1", "Quill Marsten II", "QB", "KC", 1.0, 230.8, 0.35, 0.34, None, 1.9, None, 2.0, "model", "baseline", 40.0, 0.97),
        ("k1", "Ned Farrow", "K", "KC", 1.0, None, None, None, 2.0, None, 3.0, None, "model", "model", 2.0, 0.9),
        ("a2", "Quill Marsten", "QB", "ZZ", 1.0, 1.0, 0.1, 0.1, None, 0.1, None, 0.1, "model", "model", 9.0, 0.5),
    ]
    return spark.createDataFrame(
        rows,
        "gsis_id string, player_display_name string, position string, team string, depth_rank double, passing_yards double, rushing_tds double, "
        "receiving_tds double, fg_made double, passing_tds double, pat_att double, targets double, passing_yards_source string, rushing_tds_source string, f_games_prior double, p_play double",
    )


def compared(spark, rows, **kw):
    return {r["id"]: r for r in ln.compare(lines(spark, rows), projections(spark), **kw).collect()}


def test_comparison_cases(spark):
    rows = [
        ("Quill Marsten", "Pass Yards", 245.5, "both", "standard"),
        ("Quill Marsten", "Longest Completion", 30.5, "", "standard"),
        ("Nobody Known", "Pass Yards", 245.5, "", "standard"),
        ("Quill Marsten", "Player Touchdowns", 0.5, "", "standard"),
        ("Ned Farrow", "Kicking Points", 7.5, "", "standard"),
        ("Quill Marsten", "Kicking Points", 7.5, "", "standard"),
        ("Quill Marsten", "Shoe Size", 7.5, "", "standard"),
        ("Quill Marsten", "Fantasy Score", 10.0, "", "standard"),
        ("Quill Marsten", "Pass Yards", 230.8, "less", "demon"),
        ("Quill Marsten", "Pass Yards", 0.0, "", None),
    ]
    got = compared(spark, rows)
    assert (got[0]["lean"], got[0]["diff"], got[0]["disposition"], got[0]["source"]) == ("Less", -14.7, "matched", "model")
    assert (got[1]["disposition"], got[1]["reason"]) == ("refused", "the best single play of a game; a game total says nothing of it")
    assert got[2]["disposition"] == "unmatched"
    p = 1 - math.exp(-0.69)
    assert (got[3]["kind"], got[3]["model"], got[3]["lean"], got[3]["source"]) == ("probability", round(p, 2), "Less", "baseline")
    assert (got[4]["model"], got[4]["lean"]) == (9.0, "More")
    assert got[5]["disposition"] == "unprojected"
    assert got[6]["disposition"] == "unmapped"
    want = 230.8 * 0.04 + 0.35 * 6 + 0.34 * 6 + 1.9 * 4
    assert (got[7]["model"], got[7]["source"]) == (round(want, 2), "composite")
    assert (got[8]["lean"], got[8]["sides"]) == ("Even", "less")
    assert (got[9]["diff_pct"], got[9]["sides"]) == (None, "both")
    # The first projection in (team, position, rank) order owns a shared name.
    assert got[0]["gsis_id"] == "a1"


def test_every_posted_line_is_accounted_for(spark):
    rows = [(n, s, 0.5, "", "standard") for n in ("Quill Marsten", "Nobody Known") for s in [*ln.STAT_RULES, *ln.REFUSED, *ln.FANTASY_LABELS, "odd", None]]
    a = ln.accounting(ln.compare(lines(spark, rows), projections(spark))).collect()
    assert sum(r["n"] for r in a) == len(rows)
    assert {r["disposition"] for r in a} == {"refused", "unmapped", "unmatched", "unprojected", "matched"}


def test_tiers_follow_the_weakest_part(spark):
    rel = constant_table(
        spark,
        [{"stat": "passing_yards", "tier": "strong", "side_edge_pts": 8.4, "pos": 0}, {"stat": "rushing_yards", "tier": "weak", "side_edge_pts": 2.4, "pos": 1},
         {"stat": "passing_tds", "tier": "weak", "side_edge_pts": None, "pos": 2}],
        "stat:string,tier:string,side_edge_pts:double,pos:int",
    )
    t = {r["label"]: (r["tier"], r["tier_edge"]) for r in ln.rule_tiers(ln.stat_rules(spark), rel).collect()}
    assert t["pass yards"] == ("strong", 8.4)
    assert t["pass+rush yards"] == ("weak", 2.4)
    assert t["pass tds"][0] == "unmeasured"
    assert "targets" not in t


def test_board_split_and_rank(spark):
    rows = [
        ("Quill Marsten", "Pass Yards", 245.5, "more", "standard"),
        ("Quill Marsten", "Pass Yards", 245.5, "less", "standard"),
        ("Ned Farrow", "Kicking Points", 7.5, "", "standard"),
    ]
    b = {r["id"]: r["withheld_reason"] for r in ln.board_rows(ln.compare(lines(spark, rows), projections(spark))).collect()}
    assert b == {0: "side_not_offered", 1: None, 2: "thin_history"}


def test_ladder_keeps_the_newest_standard(spark):
    rows = [("A B", "Rush Yards", 50.5, "", "demon"), ("A B", "Rush Yards", 40.5, "", "standard"), ("a b", " rush yards ", 44.5, "", "standard"), ("A B", "Targets", 3.5, "", "goblin")]
    got = sorted((r["id"], r["line"]) for r in ln.collapse_alternates(lines(spark, rows), ["id"]).collect())
    assert got == [(2, 44.5), (3, 3.5)]


def test_first_seen_wins_even_when_the_line_moves(spark):
    schema = "season int, week int, player string, stat string, line double, model double, at string"
    old = ln.freeze(spark.createDataFrame([(2026, 1, "p", "s", 85.5, 250.0, "2026-09-01")], schema), None, F.col("at"), "old", tie=["at"])
    rows = [(1, "p", 88.5, "03"), (1, "q", 1.5, "03"), (1, "q", 2.5, "02"), (2, "p", 90.5, "09")]
    new = spark.createDataFrame([(2026, w, p, "s", x, 2.0, f"2026-09-{d}") for w, p, x, d in rows], schema)
    added = ln.freeze(new, old, F.col("at"), "new", tie=["at"]).collect()
    assert sorted((r["week"], r["player"], r["line"], r["model_version"]) for r in added) == [(1, "q", 2.5, "new"), (2, "p", 90.5, "new")]


def test_two_weeks_give_two_frozen_and_two_graded_rows(spark):
    rows = [(2026, 1, "A B", "x", "Pass Yards", 200.5, "More", "1"), (2026, 2, "A B", "x", "Pass Yards", 210.5, "More", "8")]
    t = spark.createDataFrame(rows, "season int, week int, player string, gsis_id string, stat string, line double, lean string, at string")
    frozen = ln.freeze(t, None, F.col("at"), "v", tie=["at"])
    a = spark.createDataFrame([(2026, 1, "x", "A B", 250.0), (2026, 2, "x", "A B", 150.0)], "season int, week int, gsis_id string, player_display_name string, passing_yards double")
    assert sorted((r["week"], r["actual"], r["model_correct"]) for r in ln.grade(frozen, a).collect()) == [(1, 250.0, True), (2, 150.0, False)]


def test_grading(spark):
    t = spark.createDataFrame(
        [(0, "Quill Marsten", "a1", "Pass Yards", 245.5, "Less"), (1, "Quill Marsten", "a1", "Pass Yards", 283.0, "More"), (2, "Wrong Name", "a1", "Pass TDs", 0.5, "More"),
         (3, "Quill Marsten", None, "Kicking Points", 7.5, "More"), (4, "Quill Marsten", "zz", "Fantasy Score", 10.0, "More"), (5, "Ghost", "no", "Pass Yards", 1.5, "More")],
        "id int, player string, gsis_id string, stat string, line double, lean string",
    )
    a = spark.createDataFrame([("a1", "Quill Marsten II", 283.0, 2.0, 1.0, None, None)], "gsis_id string, player_display_name string, passing_yards double, passing_tds double, rushing_fumbles_lost double, receiving_fumbles_lost double, sack_fumbles_lost double")
    g = {r["id"]: (r["actual"], r["result"], r["model_correct"]) for r in ln.grade(t, a, periods=()).collect()}
    assert g == {0: (283.0, "More", False), 1: (283.0, "Exact", None), 2: (2.0, "More", True), 4: (283 * 0.04 + 8 - 1, "More", True)}


def test_record_needs_to_beat_the_common_side(spark):
    rows = [(True, "More")] * 55 + [(False, "Less")] * 45 + [(None, "Exact")] * 3
    r = ln.record(spark.createDataFrame(rows, "model_correct boolean, result string")).first()
    assert (r["n"], r["decided"], r["hits"], r["ties"], r["hit_rate"], r["baseline"], r["beats_coin"]) == (103, 100, 55, 3, 55.0, 55.0, False)
    assert (r["ci_low"], r["ci_high"]) == (45.2, 64.4)
    easy = [(True, "More")] * 45 + [(True, "Less")] * 45 + [(False, "More")] * 5 + [(False, "Less")] * 5
    assert ln.record(spark.createDataFrame(easy, "model_correct boolean, result string")).first()["beats_coin"]


def test_probabilities(spark):
    df = spark.createDataFrame([(0.69, 1, 1 - math.exp(-0.69)), (1.44, 2, 1 - math.exp(-1.44) * 2.44), (0.0, 1, 0.0), (3.0, 101, 0.0), (3.0, 0, 1.0), (-1.0, 1, None), (float("inf"), 1, None), (None, 2, None)], "lam double, k int, want double")
    for r in df.select("want", pr.poisson_at_least(F.col("lam"), F.col("k")).alias("p")).collect():
        assert r["p"] == (None if r["want"] is None else pytest.approx(r["want"], abs=1e-12))
    th = spark.createDataFrame([(0.5,), (1.5,), (2.0,)], "l double").select(pr.threshold_for_line(F.col("l"))).collect()
    assert [r[0] for r in th] == [1, 2, 3]


def test_paired_errors_ignore_unpaired_rows(spark):
    df = spark.createDataFrame([("t", 1.0, 2.0), ("t", 3.0, None), ("t", 1.0, 2.0)], "target string, abs_err_model double, abs_err_b2 double")
    r = paired_errors(df, ["target"]).first()
    assert (r["n"], r["model_mae"], r["edge_pct"]) == (2, 1.0, 50.0)


def test_every_priced_line_has_a_row(spark):
    """All matched lines; single-target means have a probability, and receiving targets the one of the checked query."""
    from pitpanel.queries import lines as q, load_all

    sf = "/root/testdata/sf0.001"
    got = {r.event_id: r for r in load_all()["probability_over_every_line"].run(spark, sf).collect()}
    priced = ln.compare(q.lines(spark, sf), q.projections(spark, sf)).where("disposition = 'matched'")
    assert {r.event_id for r in priced.select("event_id").collect()} == set(got)
    labels = {r.label for r in got.values()}
    assert {r.label for r in got.values() if r.p_over is not None} == {"rec targets", "receiving yards"} < labels
    old = {r.event_id: r.p_over for r in load_all()["probability_over_line"].run(spark, sf).collect()}
    mine = {k: r.p_over for k, r in got.items() if r.label == "rec targets"}
    assert set(old) == set(mine) and len(old) < len(got)
    for k, p in old.items():
        assert (p is None) == (mine[k] is None) and (p is None or abs(p - mine[k]) < 1e-4)
