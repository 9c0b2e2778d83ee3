"""Steps of the round's findings: the same results by less work."""

from pyspark.sql import functions as F


def test_folding_asks_no_class_of_hundreds_of_characters(spark):
    """A class of all characters that fold to several is walked through for each character of a text."""
    from pitpanel.functions import names

    *_, many = names.fold_tables()
    df = spark.createDataFrame([("ﬁn Ǆx Jr.",), ("ÉÀÇü",), ("plain",), (None,)], "t string")
    out = df.select(names.normalize_name(F.col("t")).alias("k"))
    assert "[" + "".join(many)[:50] not in out._jdf.queryExecution().analyzed().toString()
    assert [r.k for r in out.collect()] == ["fin dzx", "eacu", "plain", ""]


def test_asks_are_answered_by_the_rows_before_their_period(spark):
    """Asks between, at, before and after a key's rows, with several rows of a period; only the windows' own exchange carries history."""
    from pitpanel.operators.ordered import Spec
    from pitpanel.plans import project as pj
    from pitpanel.roles import PLAYER_PANEL

    rows = [(k, s, w, f"g{e}", float(s % 7 + w + e)) for k in "ab" for s in (2000, 2002) for w in (2, 4, 5) for e in range(2) if (k, w) != ("b", 5)]
    history = spark.createDataFrame(rows, "gsis_id string, season long, week long, game_id string, y double")
    asks = spark.createDataFrame([(k, s, w) for k in "abc" for s in (1999, 2000, 2001, 2002, 2003) for w in (1, 2, 3, 5, 9)], "gsis_id string, season long, week long")
    specs = [Spec("n", "count"), Spec("s", "sum", "y"), Spec("r", "rolling", "y", 3)]
    for hot in (None, 4):
        found = pj._states_at(asks, history, ["gsis_id"], specs, ["n", "s", "r"], PLAYER_PANEL, hot)
        got = {(r.gsis_id, r.season, r.week): (r.n, r.s, r.r) for r in found.collect()}
        assert len(got) == 75
        for (k, s, w), v in got.items():
            past = [r[4] for r in sorted(rows, key=lambda r: r[1:4]) if r[0] == k and (r[1], r[2]) < (s, w)]
            assert v == (len(past), sum(past), sum(past[-3:]) / len(past[-3:]) if past else None)
    inner = [Spec("n", "count", within=("season",))]
    era = pj._states_at(asks, history, ["gsis_id"], inner, ["n"], PLAYER_PANEL, within_era=True).collect()
    assert len(era) == 75
    for r in era:
        assert r.n == sum(x[0] == r.gsis_id and x[1] == r.season and x[2] < r.week for x in rows)


SF = "/root/testdata/sf0.001"


def test_the_panel_is_dealt_by_entity_once(spark):
    """Windows per entity follow the sums in the same tasks; totals of the counts need no panel."""
    from pitpanel import testdata as td
    from pitpanel.queries import load_all

    plan = load_all()["entity_history_block"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(gsis_id") == 1 and "Exchange hashpartitioning(season" not in plan
    sums = [F.sum(c).alias(c) for c in ("targets", "receiving_yards", "off_snaps") if td.BOX[c].startswith("sum(")]
    want = td.panel(spark, SF).groupBy("season").agg(*sums)
    got = td.box_totals(spark, SF, ["season"]).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_observations_and_compared_lines_are_stored(spark):
    from pitpanel.queries import calibration as c, lines as q

    assert not any("lineitem" in f for f in c.with_availability(spark, SF).inputFiles())
    assert not any("lineitem" in f or "events" in f for f in q.graded(spark, SF).inputFiles())


def test_only_targets_that_lines_are_priced_by_are_calibrated(spark):
    from pitpanel.operators import lines as ln

    posted = spark.createDataFrame([(" Receiving Yards",), ("rush+rec yds",), ("Rec Targets",), ("Player Touchdowns",), ("tackles",), (None,)], "stat_type string")
    assert ln.single_targets(posted) == {"receiving_yards", "targets"}


def test_a_known_place_among_the_knots_gives_the_same_value(spark):
    from pitpanel.functions import prob as pr

    df = spark.createDataFrame([(x / 4,) for x in range(-2, 20)] + [(None,)], "x double")
    df = df.withColumns({"xs": F.array(*map(F.lit, (0.0, 1.0, 1.0, 3.0))), "ys": F.array(*map(F.lit, (0.1, 0.2, 0.4, 0.9)))})
    args = F.col("x"), F.col("xs"), F.col("ys"), F.lit(0.0), F.lit(1.0)
    both = df.select(pr.interp(*args).alias("a"), pr.interp(*args, pr.knots_below(F.col("x"), F.col("xs"))).alias("b")).collect()
    assert all(r.a == r.b for r in both)


def test_a_key_of_many_runs_is_cut_in_levels(spark, monkeypatch):
    """No row walks over a list as long as its key has runs: lists stay short, runs stay small and in order, results stay the same (F10)."""
    from pitpanel.operators import ordered

    df = spark.range(0, 520).selectExpr(
        "IF(id < 480, 'hot', IF(id < 500, 'warm', 'cold')) AS k", "id AS i", "CAST(id % 7 AS DOUBLE) AS v",
        "IF(id % 97 = 0, NULL, CAST(IF(id BETWEEN 100 AND 140, 100, id) AS DOUBLE)) AS at",
    )
    specs = [ordered.Spec("m", "mean", "v"), ordered.Spec("r", "rolling", "v", 3), ordered.Spec("n", "count"), ordered.Spec("s", "sum", "v")]
    shown = lambda d: sorted((r.k, r.i, r.n, r.s, *[None if x is None else round(x, 9) for x in (r.m, r.r)]) for r in d.collect())
    plain = shown(ordered.prior(df, ["k"], ["at", "i"], F.col("at"), specs, 10**9))
    monkeypatch.setattr(ordered, "FANOUT", 4)
    for values in (1 << 22, 0):
        monkeypatch.setattr(ordered, "BROADCAST_CUTS", values)
        levels, n = ordered.find_hot(df, ["k"], F.col("at"), 5)
        assert n == 3 and len(levels) == 4
        assert max(r.n for cuts, _ in levels for r in cuts.select(F.size("__cuts").alias("n")).collect()) <= 3
        runs = ordered.assign_runs(df, ["k"], F.col("at"), (levels, n)).where("k = 'hot' AND at IS NOT NULL").groupBy(ordered.RUN).agg(
            F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b")).orderBy(ordered.RUN).collect()
        assert len(runs) >= 60 and all(r.n <= 10 or r.a <= 100 <= r.b for r in runs)
        assert all(x.b < y.a for x, y in zip(runs, runs[1:]))
        assert shown(ordered.prior(df, ["k"], ["at", "i"], F.col("at"), specs, 5)) == plain


def test_features_are_ordered_by_one_exchange_of_wide_rows(spark):
    """Stretches are dealt while rows are narrow: no range exchange samples the finished features, no join moves them, the order is whole (F15)."""
    from pitpanel.queries import load_all

    out = load_all()["feature_build_all"].run(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("Exchange hashpartitioning(gsis_id") == 1 and plan.count("shufflepartitionidpassthrough") == 1
    keys = [tuple(r) for r in out.select("season", "week", "game_id", "gsis_id").collect()]
    assert keys == sorted(keys) and len(keys) == len(set(keys)) > 2000


def test_totals_of_a_frame_are_summed_once(spark):
    """Means, sums and rolling means of a column share their totals and the frame's count; values stay those of the plain averages (F15)."""
    from pitpanel.operators.ordered import Spec, prior

    rows = [(k, s, i, None if (s + i) % 5 == 0 else s * 0.1 + i * 0.7) for k in "ab" for s in range(3) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, era long, i long, v double")
    specs = [Spec("n", "count"), Spec("s", "sum", "v"), Spec("m", "mean", "v"), Spec("e", "mean", "v", within=("era",)), Spec("r", "rolling", "v", 3), Spec("p", "mean_present", "v")]
    out = prior(df, ["k"], ["era", "i"], F.lit(0.0), specs)
    assert out.columns == [*df.columns, *[s.name for s in specs]]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("count(1) windowspecdefinition(k") == 2 and plan.count("Sort") == 0
    past = lambda r, era: [x[3] for x in rows if x[0] == r.k and (x[1], x[2]) < (r.era, r.i) and (not era or x[1] == r.era)]
    mean = lambda v: sum(v) / len(v) if v else None
    zeros = lambda v: [x or 0.0 for x in v]
    for r in out.collect():
        a, e = past(r, False), past(r, True)
        want = (len(a), sum(zeros(a)), mean(zeros(a)), mean(zeros(e)), mean(zeros(a[-3:])), mean([x for x in a if x is not None]))
        assert [None if x is None else round(x, 9) for x in (r.n, r.s, r.m, r.e, r.r, r.p)] == [None if x is None else round(x, 9) for x in want]
