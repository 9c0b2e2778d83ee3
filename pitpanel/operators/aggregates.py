"""Grouped aggregates. Sums over nothing are 0 and null keys are dropped, as the data model asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitpanel.operators.ordered import quantiles_of_counts, sized
from pitpanel.session import materialise, small_side
from pitpanel.operators.shape import attempts, explode_list, scrimmage, zero, zone_flags


def total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def mean_where(value: Column, mask: Column) -> Column:
    """Mean over masked rows; null when none carries a value."""
    return F.avg(F.when(mask, value))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def majority_label(df: DataFrame, keys: list[str], label: str, out: str) -> DataFrame:
    """Most frequent label per key, smallest on ties. Counts first, so hot keys combine."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("__n"), F.col(label))).alias(out))


def team_side(plays: DataFrame) -> DataFrame:
    """One row per (event, group) with every offensive measure, in one grouped pass."""
    p = attempts(scrimmage(plays))
    scrim = F.col("is_scrimmage")
    neutral = F.col("neutral") & scrim
    drop = F.col("is_dropback")

    def n(mask):
        return total(mask.cast("double"))

    def zone(mark):
        return scrim & (F.col("yardline_100") <= mark)

    plays_n, drops, n_plays = n(scrim), n(drop), n(neutral)
    g = p.groupBy("season", "week", "game_id", F.col("posteam").alias("team"))
    return g.agg(
        F.mode("defteam", True).alias("opponent"),
        F.max((F.col("home_team") == F.col("posteam")).cast("bigint")).alias("is_home"),
        plays_n.alias("off_plays"),
        drops.alias("off_dropbacks"),
        total(F.col("off_pass_att")).alias("off_pass_att"),
        total(F.col("off_rush_att")).alias("off_rush_att"),
        total(F.col("off_designed_rush")).alias("off_designed_rush"),
        total(F.col("off_scramble")).alias("off_scrambles"),
        total(F.col("off_sack")).alias("off_sacks"),
        ratio(drops, plays_n).alias("off_pass_rate"),
        ratio(n(neutral & drop), n_plays).alias("off_neutral_pass_rate"),
        mean_where(F.col("pass_oe"), scrim).alias("off_proe"),
        mean_where(F.col("pass_oe"), neutral).alias("off_neutral_proe"),
        mean_where(F.col("xpass"), scrim).alias("off_xpass"),
        n_plays.alias("off_neutral_plays"),
        mean_where(F.col("epa"), scrim).alias("off_epa_play"),
        mean_where(F.col("epa"), scrim & drop).alias("off_pass_epa"),
        mean_where(F.col("epa"), scrim & (F.col("off_designed_rush") > 0)).alias("off_rush_epa"),
        mean_where(F.col("success"), scrim).alias("off_success_rate"),
        total(F.when(scrim, F.col("yards_gained"))).alias("off_yards"),
        mean_where(F.col("play_clock"), neutral).alias("off_sec_per_play"),
        F.count_distinct(F.when(scrim, F.col("drive"))).cast("double").alias("off_drives"),
        n(zone(20)).alias("off_rz_plays"),
        n(zone(10)).alias("off_i10_plays"),
        n(zone(5)).alias("off_i5_plays"),
        total(F.when(zone(20), F.col("off_rush_att"))).alias("off_rz_rush"),
        total(F.when(zone(20), F.col("off_pass_att"))).alias("off_rz_pass"),
        total(F.when(scrim, zero("pass_touchdown"))).alias("off_pass_td"),
        total(F.when(scrim, zero("rush_touchdown"))).alias("off_rush_td"),
        mean_where(F.col("wp"), scrim).alias("realized_mean_wp"),
        mean_where(F.col("score_differential"), scrim).alias("realized_mean_score_diff"),
        mean_where((F.col("score_differential") > 0).cast("double"), scrim).alias("realized_frac_leading"),
        mean_where((F.col("score_differential") < 0).cast("double"), scrim).alias("realized_frac_trailing"),
    )


def with_rival_side(team: DataFrame, event="game_id", group="team", rival="opponent") -> DataFrame:
    """Self join to the other side of the event: what the rival did is what this side allowed."""
    off = [c for c in team.columns if c.startswith("off_")]
    other = team.select(
        event,
        F.col(group).alias(rival),
        *[F.col(c).alias(c.replace("off_", "def_allowed_", 1)) for c in off],
    )
    return team.join(other, [event, rival], "left")


def league_context(team: DataFrame, era="season", columns: list[str] | None = None) -> DataFrame:
    """Era means of the group table and the number of group rows."""
    cols = columns or [
        "off_plays", "off_dropbacks", "off_pass_att", "off_designed_rush", "off_pass_rate",
        "off_neutral_pass_rate", "off_proe", "off_neutral_proe", "off_epa_play",
        "off_rz_plays", "off_drives", "off_pass_td", "off_rush_td",
    ]
    return team.groupBy(era).agg(
        *[F.avg(c).alias(f"league_{c}") for c in cols],
        F.count(F.lit(1)).alias("league_team_games"),
    )


def crosswalk(players: DataFrame, source: str, target: str) -> DataFrame:
    """source id -> target id, one target per source (the smallest), nulls dropped."""
    return (
        players.where(F.col(source).isNotNull() & F.col(target).isNotNull())
        .groupBy(source)
        .agg(F.min(target).alias(target))
    )


def snaps(counts: DataFrame, xwalk: DataFrame, source: str) -> DataFrame:
    """Largest snap count per (event, entity), keyed through the crosswalk."""
    return (
        counts.join(xwalk, source)
        .groupBy("game_id", "gsis_id")
        .agg(F.max("offense_snaps").alias("off_snaps"), F.max("offense_pct").alias("off_pct"))
    )


def on_field(plays: DataFrame, participation: DataFrame) -> DataFrame:
    """Plays and dropbacks each entity was on the field for."""
    p = plays.where(F.col("play_type").isin("pass", "run")).select("game_id", "play_id", "qb_dropback")
    j = p.join(participation.where(F.col("offense_players").isNotNull()), ["game_id", "play_id"])
    return (
        explode_list(j, "offense_players", "gsis_id")
        .groupBy("game_id", "gsis_id")
        .agg(
            F.count("play_id").alias("off_snaps_pbp"),
            total(zero("qb_dropback")).alias("routes_run_proxy"),
        )
        .withColumn("pass_snaps", F.col("routes_run_proxy"))
    )


def opportunity(plays: DataFrame, rusher: str, receiver: str) -> DataFrame:
    """Where each entity's rushes and targets happened; full outer join of the two sides."""
    p = attempts(plays.where(F.col("posteam").isNotNull()))
    p = zone_flags(p).withColumn("neu", F.col("neutral").cast("double"))
    zones = {"rz": "rz", "i10": "i10", "i5": "i5", "neutral": "neu"}

    def side(rows, who, count, prefix, extra):
        return (
            rows.where(F.col(who).isNotNull())
            .groupBy("game_id", F.col(who).alias("gsis_id"))
            .agg(
                F.sum(count).alias(f"pbp_{prefix}"),
                *[F.sum(z).alias(f"{prefix}_{n}") for n, z in zones.items()],
                *extra,
            )
        )

    rush = side(
        p.where("off_rush_att > 0"), rusher, "off_rush_att", "carries", [F.avg("epa").alias("rush_epa")]
    )
    rec = side(
        p.where("off_pass_att > 0"), receiver, "off_pass_att", "targets",
        [F.avg("air_yards").alias("adot"), F.avg("epa").alias("target_epa")],
    )
    return rush.join(rec, ["game_id", "gsis_id"], "full_outer")


def allowed_totals(panel: DataFrame, measures: list[str]) -> DataFrame:
    """What each rival allowed to each cohort in each event."""
    return (
        panel.where(F.col("opponent_team").isNotNull() & F.col("position").isNotNull())
        .groupBy("season", "week", "game_id", F.col("opponent_team").alias("def_team"), "position")
        .agg(*[total(F.col(m)).alias(m) for m in measures])
    )


def scheme_rates(plays: DataFrame) -> DataFrame:
    """Per (era, defence) rates, each over its own denominator, with the sample sizes."""
    zone_type = F.col("defense_man_zone_type")
    classified = zone_type.isin("MAN_COVERAGE", "ZONE_COVERAGE")
    is_pass, is_rush = F.col("qb_dropback") == 1, F.col("rush_attempt") == 1
    rushers, box = F.col("number_of_pass_rushers"), F.col("defenders_in_box")

    def over(mask):
        return F.count_if(mask)

    def at_least(value, k):
        return F.coalesce((value >= k).cast("double"), F.lit(0.0))

    return (
        plays.where(F.col("defteam").isNotNull())
        .groupBy("season", F.col("defteam").alias("def_team"))
        .agg(
            mean_where((zone_type == "MAN_COVERAGE").cast("double"), classified).alias("man_rate"),
            mean_where(F.col("was_pressure"), is_pass).alias("pressure_rate"),
            mean_where(at_least(rushers, 5), is_pass).alias("blitz_rate"),
            mean_where(at_least(box, 8), is_rush).alias("box8_rate"),
            mean_where(box, is_rush).alias("box_avg"),
            over(classified).alias("n_classified"),
            over(is_pass).alias("n_pass"),
            over(is_rush).alias("n_rush"),
        )
    )


def crew_rates(plays: DataFrame, crew: str) -> DataFrame:
    """Penalties per event and crew, then averaged per (era, crew)."""
    dpi = F.contains(F.lower(F.coalesce("penalty_type", F.lit(""))), F.lit("defensive pass interference"))
    games = plays.groupBy("season", crew, "game_id").agg(
        total(zero("penalty")).alias("pen"),
        total(zero("penalty_yards")).alias("yds"),
        total(dpi.cast("double")).alias("dpi"),
    )
    return games.groupBy("season", crew).agg(
        F.avg("pen").alias("ref_pen_per_game"),
        F.avg("yds").alias("ref_pen_yards_per_game"),
        F.avg("dpi").alias("ref_dpi_per_game"),
        F.count(F.lit(1)).alias("n_games"),
    )


# Prior name -> (numerator, denominator, literal used without evidence).
LEAGUE_PRIORS = {
    "catch_rate": ("receptions", "targets", 0.64),
    "yards_per_target": ("receiving_yards", "targets", 7.9),
    "yards_per_carry": ("rushing_yards", "carries", 4.3),
    "yards_per_attempt": ("passing_yards", "attempts", 7.1),
    "completion_rate": ("completions", "attempts", 0.64),
    "rec_td_per_target": ("receiving_tds", "targets", 0.055),
    "rush_td_per_carry": ("rushing_tds", "carries", 0.023),
}


def league_priors(panel: DataFrame, before_era: int, era="season", compat=False) -> DataFrame:
    """One row of ratio-of-sums priors from eras strictly before ``before_era``.

    Without earlier eras the literals apply; ``compat`` uses the whole panel there instead.
    """
    past = F.col(era) < before_era
    has_past = F.count_if(past)

    def summed(c):
        inside = F.sum(F.when(past, F.col(c)))
        return F.when(has_past > 0, inside).otherwise(F.sum(c)) if compat else inside

    return panel.agg(
        *[
            F.coalesce(ratio(summed(n), summed(d)), F.lit(lit)).alias(name)
            for name, (n, d, lit) in LEAGUE_PRIORS.items()
        ]
    )


def with_era_priors(panel: DataFrame, era="season", prefix="__prior_") -> DataFrame:
    """Each row with the ratio-of-sums priors of the eras before its own; the literals where there is none.

    A row's prior never depends on its own era or later ones, so one feature table serves every fold.
    """
    known = {name: (n, d, lit) for name, (n, d, lit) in LEAGUE_PRIORS.items() if {n, d} <= set(panel.columns)}
    sums = panel.groupBy(era).agg(*[F.sum(x).alias(f"__{x}") for x in sorted({c for n, d, _ in known.values() for c in (n, d)})])
    before = Window.orderBy(era).rowsBetween(Window.unboundedPreceding, -1)  # a row per era
    priors = [
        F.coalesce(ratio(F.sum(f"__{n}").over(before), F.sum(f"__{d}").over(before)), F.lit(lit)).alias(prefix + name)
        for name, (n, d, lit) in known.items()
    ]
    return panel.join(sums.select(era, *priors), era, "left")


def era_share(df: DataFrame, era: str, columns: list[str], prefix="rel_") -> DataFrame:
    """Value over its era mean; the mean is an aggregate joined back."""
    means = df.groupBy(era).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    j = df.join(small_side(means), era)
    return j.select(
        *df.columns, *[ratio(F.col(c), F.col(f"__m_{c}")).alias(prefix + c) for c in columns]
    )


def weighted_sum(terms: list[tuple[str, float]], skip_null: bool) -> Column:
    """Linear combination; a null term is skipped or makes the result null."""
    out = F.lit(0.0)
    for c, w in terms:
        out = out + (zero(c) if skip_null else F.col(c)) * F.lit(w)
    return out


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Join two sources on their keys and report, per pair, equal keys, all keys and worst gap."""
    j = a.join(b, keys, "inner")
    gaps = [F.abs(F.col(x) - F.col(y)) for x, y in pairs]
    one = j.agg(
        *[F.count_if(g == 0).alias(f"eq_{i}") for i, g in enumerate(gaps)],
        *[F.max(g).alias(f"worst_{i}") for i, g in enumerate(gaps)],
        F.count(F.lit(1)).alias("n"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{x}={y}").alias("check"),
                F.col(f"eq_{i}").alias("equal"),
                F.col("n").alias("joined"),
                F.col(f"worst_{i}").alias("worst"),
            )
            for i, (x, y) in enumerate(pairs)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def paired_errors(history: DataFrame, by: list[str], model="abs_err_model", base="abs_err_b2") -> DataFrame:
    """Paired rows only: n, both MAEs and the edge in percent per group."""
    paired = history.where(F.col(model).isNotNull() & F.col(base).isNotNull())
    g = paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(model).alias("model_mae"), F.avg(base).alias("base_mae")
    )
    return g.withColumn("edge_pct", 100 * (1 - ratio(F.col("model_mae"), F.col("base_mae"))))


def edge_summary(per_target: DataFrame, by: list[str]) -> DataFrame:
    """Targets, targets with a positive edge, and the mean of the per-target edges."""
    aggs = [
        F.count(F.lit(1)).alias("stats"),
        F.count_if(F.col("edge_pct") > 0).alias("better"),
        F.avg("edge_pct").alias("mean_edge"),
    ]
    return per_target.groupBy(*by).agg(*aggs) if by else per_target.agg(*aggs)


def error_profile(df: DataFrame, keys: list[str], pred: str, actual: str, hot_rows=None) -> DataFrame:
    """MAE, MAE as a share of the mean, p50 and p90 error, hits within 20 % and within 1 sd."""
    # Pairs of values with how often each occurs: the rows are read once, whatever the number of measures.
    pairs = df.groupBy(*keys, F.col(pred).alias("p"), F.col(actual).alias("a")).agg(F.count(F.lit(1)).cast("double").alias("__m"))
    e = materialise(pairs, "pairs").withColumn("__d", F.col("a") - F.col("p")).withColumn("err", F.abs("__d"))
    mean = lambda c: F.sum(c * F.col("__m")) / F.nullif(F.sum(F.when(c.isNotNull(), F.col("__m"))), F.lit(0.0))
    centre = materialise(e.groupBy(*keys).agg(mean(F.col("__d")).alias("__c")), "centre")
    few = centre.count()
    sd = e.join(sized(centre, few), keys).groupBy(*keys).agg(F.sqrt(mean((F.col("__d") - F.col("__c")) * (F.col("__d") - F.col("__c")))).alias("sd"))
    base = e.join(sized(sd, few), keys).groupBy(*keys).agg(
        mean(F.col("a")).alias("mean"),
        mean(F.col("err")).alias("mae"),
        mean((F.col("err") <= 0.2 * F.greatest(F.col("p"), F.lit(1e-9))).cast("double")).alias("within20"),
        mean((F.col("err") <= F.col("sd")).cast("double")).alias("within1sd"),
        F.first("sd").alias("sd"),
    )
    errors = materialise(e.where("err IS NOT NULL").groupBy(*keys, F.col("err").cast("double").alias("__v")).agg(F.sum("__m").alias("__m")), "errors")
    q = quantiles_of_counts(errors, keys, [0.5, 0.9], "q", hot_rows)
    return base.join(q, keys).select(
        *keys, "n", "mean", "mae",
        (100 * ratio(F.col("mae"), F.col("mean"))).alias("mae_pct"),
        F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"),
        (100 * F.col("within20")).alias("within20"), (100 * F.col("within1sd")).alias("within1sd"), "sd",
    )


def concentration(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of the largest entity and the effective number of entities (inverse Simpson)."""
    v = F.when(F.col(value) > 0, F.col(value))
    return df.groupBy(*keys).agg(
        ratio(F.max(value), F.sum(value)).alias("top_share"),
        F.coalesce(ratio(F.pow(F.sum(v), F.lit(2.0)), F.sum(v * v)), F.lit(0.0)).alias("effective_n"),
    )


def estimand_totals(df: DataFrame, keys: list[str], pred: str, expected: str, actual: str, played: str) -> DataFrame:
    """Conditional, expected and played-only totals beside the actual one, with their ratios."""
    t = df.groupBy(*keys).agg(
        total(F.col(pred)).alias("conditional"),
        total(F.col(expected)).alias("expected"),
        total(F.when(F.col(played), F.col(pred))).alias("played_only"),
        total(F.col(actual)).alias("actual"),
    )
    return t.select(
        "*", *[ratio(F.col(c), F.col("actual")).alias(f"{c}_ratio") for c in ("conditional", "expected", "played_only")]
    )


def slate_summary(games: DataFrame, keys: list[str]) -> DataFrame:
    """Games, games with a line, finals and the date span."""
    return games.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"),
        F.count("total_line").alias("with_line"),
        F.count_if(F.col("home_score").isNotNull()).alias("finals"),
        F.min("gameday").alias("first_day"),
        F.max("gameday").alias("last_day"),
    )


def groups_idle(legs: DataFrame, era: str, period: str, group: str) -> DataFrame:
    """(era, period, group) without an event: byes. Period sets are bounded by the calendar."""
    every = legs.groupBy(era).agg(F.collect_set(period).alias("__every"))
    played = legs.groupBy(era, group).agg(F.collect_set(period).alias("__played"))
    idle = F.explode(F.array_except("__every", "__played"))
    return played.join(every, era).select(era, group, idle.alias(period))


def drift_report(team: DataFrame, era: str, means: list[str]) -> DataFrame:
    """Per-era mean, min and max of each measure."""
    return team.groupBy(era).agg(
        *[f(c).alias(f"{n}_{c}") for c in means for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    )


#: Size of a quantile sketch: with 400, the rank of a returned value is off by more than 0.9 % of the rows in one case of a hundred.
SKETCH_K, SKETCH_ERROR = 400, 0.009


def quantile_states(df: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """keys, n and a mergeable quantile sketch of the non-null values: a few kilobytes per key, whatever its rows.

    States of parts, such as eras, are kept and merged later without reading the rows again; ``quantiles`` is the exact way.
    """
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("state")
    )


def merged_states(states: DataFrame, keys: list[str], k: int = SKETCH_K) -> DataFrame:
    """States of finer keys put together per coarser key."""
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("state", F.lit(k)).alias("state"))


def state_quantiles(states: DataFrame, probs: list[float], out: str = "quantiles") -> DataFrame:
    """Values whose ranks are near the wanted ones (see SKETCH_ERROR); each is a value of the data."""
    values = F.array(*[F.kll_sketch_get_quantile_double("state", F.lit(p)) for p in probs])
    return states.withColumn(out, values).drop("state")
