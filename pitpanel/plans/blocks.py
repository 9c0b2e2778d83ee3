"""Feature blocks and the one entry point that training and serving share.

Every entity-keyed block contributes window specs to a single pass, so the whole entity block
costs one exchange. Group and rival blocks run on the group table, cohort blocks on aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitpanel.functions.prob import posterior
from pitpanel.operators.additive import Plan
from pitpanel.operators.aggregates import LEAGUE_PRIORS, allowed_totals, era_share
from pitpanel.operators.joins import lagged_era, latest_prior_era
from pitpanel.operators.models import TARGETS
from pitpanel.operators.ordered import Spec, prior
from pitpanel.operators.packs import Packs, era_levels, packed_history, unpacked_rows
from pitpanel.operators.shape import mask_when
from pitpanel.operators.windows import expanding_era_prior, history
from pitpanel.roles import PLAYER_PANEL, Roles
from pitpanel.session import SIDE_ROWS, SLICE, SLICE_ROWS, dealt_in_order, in_order, materialise, small_side, stored_side

# Evidence at which own rate and prior weigh the same.
SHRINK_K = {
    "yards_per_target": 60.0,
    "catch_rate": 50.0,
    "yards_per_carry": 200.0,
    "yards_per_attempt": 200.0,
    "completion_rate": 100.0,
    "target_share": 25.0,
    "rush_share": 20.0,
    "td_rate": 150.0,
}

# Counts with full history, zone counts, tracking and advanced rates.
VOLUME_STATS = [
    "targets", "receptions", "receiving_yards", "receiving_tds", "carries", "rushing_yards",
    "rushing_tds", "attempts", "completions", "passing_yards", "passing_tds",
    "passing_interceptions", "sacks_suffered", "fg_att", "fg_made", "pat_att", "off_snaps",
]
ZONE_STATS = ["carries_rz", "carries_i10", "carries_i5", "targets_rz", "targets_i10", "targets_i5"]
TRACKING_STATS = [
    "ngs_avg_cushion", "ngs_avg_separation", "ngs_avg_intended_air_yards",
    "ngs_percent_share_of_intended_air_yards", "ngs_avg_yac_above_expectation", "ngs_efficiency",
    "ngs_percent_attempts_gte_eight_defenders", "ngs_avg_time_to_los",
    "ngs_rush_yards_over_expected_per_att", "ngs_avg_time_to_throw", "ngs_avg_air_yards_differential",
    "ngs_aggressiveness", "ngs_avg_air_yards_to_sticks", "ngs_completion_percentage_above_expectation",
]
ADVANCED_STATS = [
    "pfr_receiving_broken_tackles", "pfr_receiving_drop", "pfr_receiving_drop_pct",
    "pfr_receiving_rat", "pfr_rushing_broken_tackles", "pfr_passing_drops", "pfr_passing_drop_pct",
]
BIO_FEATURES = ["age", "experience", "draft_round", "height", "weight"]
VENUE_FEATURES = [
    "roof_indoor", "is_turf", "altitude_m", "rest_diff", "opp_rest_days", "is_primetime", "week_of_season",
]
WEATHER_FEATURES = ["wx_temp", "wx_wind", "wx_gust", "wx_wind_max", "wx_gust_max", "wx_precip"]
COHORT_STATS = ["targets", "carries", "attempts", "receptions", "off_snaps"]
ALLOWED_STATS = ["targets", "receiving_yards", "carries", "rushing_yards"]
TEAM_STATS = [
    "off_plays", "off_pass_rate", "off_proe", "off_dropbacks", "off_designed_rush", "off_epa_play", "off_pass_att",
]
RIVAL_STATS = [
    "def_allowed_epa_play", "def_allowed_pass_att", "def_allowed_designed_rush", "def_allowed_plays",
]
SCHEME_RATES = ["man_rate", "pressure_rate", "blitz_rate", "box8_rate", "box_avg"]
CREW_RATES = ["ref_pen_per_game", "ref_pen_yards_per_game", "ref_dpi_per_game"]

# Posterior name -> (numerator, denominator, prior, evidence).
EFFICIENCY = {
    "f_shrunk_catch_rate": ("receptions", "targets", "catch_rate", "catch_rate"),
    "f_shrunk_ypt": ("receiving_yards", "targets", "yards_per_target", "yards_per_target"),
    "f_shrunk_ypc": ("rushing_yards", "carries", "yards_per_carry", "yards_per_carry"),
    "f_shrunk_ypa": ("passing_yards", "attempts", "yards_per_attempt", "yards_per_attempt"),
    "f_shrunk_comp_rate": ("completions", "attempts", "completion_rate", "completion_rate"),
    "f_shrunk_rec_td_rate": ("receiving_tds", "targets", "rec_td_per_target", "td_rate"),
    "f_shrunk_rush_td_rate": ("rushing_tds", "carries", "rush_td_per_carry", "td_rate"),
}
SHARES = {
    "f_shrunk_target_share": ("targets", "off_pass_att", 0.12, "target_share"),
    "f_shrunk_rush_share": ("carries", "off_designed_rush", 0.25, "rush_share"),
}

# Weights of the priors, the mark of a promotion, targets of one cohort.
DEFENCE_K = 12.0
COHORT_K = 6.0
PROMOTED_BELOW = 0.6
DEFENCE_PREFIX = "f_dvp_"
PASSING_TARGETS = frozenset(
    {"attempts", "completions", "passing_yards", "passing_tds", "passing_interceptions", "sacks_suffered"}
)


@dataclass(frozen=True)
class Config:
    """Block switches; the defaults are the blocks that passed their gate."""

    windows: tuple[int, ...] = (3, 8)
    team_window: int = 4
    zone: bool = False
    tracking: bool = False
    advanced: bool = False
    cohort_volume: bool = False
    rival_cohort: bool = True
    role_change: bool = False
    weather: bool = False
    scheme: bool = False
    crew: bool = False
    depth_rank: bool = True
    bio: bool = True
    venue: bool = False
    bio_excluded_for: frozenset = frozenset()
    rival_cohort_excluded_for: frozenset = PASSING_TARGETS
    compat: bool = False
    hot_rows: int | None = None
    extra: dict = field(default_factory=dict)


def entity_specs(columns: list[str], cfg: Config, era: str) -> list[Spec]:
    """Games played, and per stat: career, rolling and era-to-date means; rates only career."""
    specs = [Spec("f_games_prior", "count"), Spec("f_games_prior_season", "count", within=(era,))]
    counts = VOLUME_STATS + (ZONE_STATS if cfg.zone else [])
    for c in [c for c in counts if c in columns]:
        specs.append(Spec(f"f_career_{c}", "mean", c))
        specs += [Spec(f"f_r{w}_{c}", "rolling", c, w) for w in cfg.windows]
        specs.append(Spec(f"f_std_{c}", "mean", c, within=(era,)))
    rates = (TRACKING_STATS if cfg.tracking else []) + (ADVANCED_STATS if cfg.advanced else [])
    specs += [Spec(f"f_career_{c}", "mean_present", c) for c in rates if c in columns]
    return specs


def posterior_specs(columns: list[str]) -> list[Spec]:
    """Prior totals behind the shrunk efficiencies and shares."""
    need = {c for n, d, *_ in [*EFFICIENCY.values(), *SHARES.values()] for c in (n, d)}
    return [Spec(f"__t_{c}", "sum", c) for c in sorted(need) if c in columns]


def posterior_columns(columns: list[str], priors: dict[str, float]) -> list[Column]:
    out = []
    for name, (n, d, p, k) in {**EFFICIENCY, **SHARES}.items():
        if n in columns and d in columns:
            level = priors[p] if isinstance(p, str) else p
            out.append(posterior(F.col(f"__t_{n}"), F.col(f"__t_{d}"), F.lit(level), SHRINK_K[k]).alias(name))
    return out


def entity_block(df: DataFrame, priors: dict[str, float], cfg: Config = Config(), roles: Roles = PLAYER_PANEL) -> DataFrame:
    """Entity history, shrunk efficiency and shrunk shares in one pass over the entity key."""
    specs = entity_specs(df.columns, cfg, roles.era) + posterior_specs(df.columns)
    h = history(df, roles, specs, None, cfg.hot_rows)
    kept = [c for c in h.columns if not c.startswith("__t_")]
    return h.select(*kept, *posterior_columns(df.columns, priors))


def history_plan(columns: list[str], cfg: Config = Config(), roles: Roles = PLAYER_PANEL) -> Plan:
    """The features of ``entity_block`` on a panel with these columns, with the capped rank, and its targets."""
    windows = [s.name for s in entity_specs(columns, cfg, roles.era) if s.name.startswith("f_")]
    rates = [name for name, (n, d, *_) in {**EFFICIENCY, **SHARES}.items() if n in columns and d in columns]
    return Plan((*windows, *rates, *[c for c in ("depth_rank_capped",) if c in columns]), tuple(t for t in TARGETS if t in columns), roles.era, roles.cohort)


def history_packs(df: DataFrame, cfg: Config = Config(), keep: tuple[str, ...] = (), roles: Roles = PLAYER_PANEL) -> tuple[Plan, Packs, list]:
    """(plan, packs, the fields they carry besides) of ``entity_block``; posteriors lean on the priors of the eras before the row's own.

    All rows of an entity must be in one partition of df, as ``testdata.panel`` leaves them: no further exchange is made, and no
    feature is written by rows. The sums behind the priors are taken on the way.
    """
    plan = history_plan(df.columns, cfg, roles)
    rates = {f: (n, d, p, SHRINK_K[k]) for f, (n, d, p, k) in {**EFFICIENCY, **SHARES}.items() if f in plan.features}
    priors = {name: v for name, v in LEAGUE_PRIORS.items() if {v[0], v[1]} <= set(df.columns)}
    own = sorted({c for n, d, _ in priors.values() for c in (n, d)})
    cohorts = {t: (TARGETS[t][0], plan.link(t) == "log") for t in plan.targets}
    found, late = packed_history(df, plan, entity_specs(df.columns, cfg, roles.era), rates, own, cohorts, list(keep), roles.entity, roles.order)
    packs = materialise(found, "packs")
    late = replace(late, levels=era_levels(packs, own, priors))
    return plan, Packs(packs, plan.features, plan.targets, late), [f for f in df.schema.fields if f.name in keep and f.name not in (roles.era, roles.cohort)]


def cohort_volume(df: DataFrame, roles: Roles = PLAYER_PANEL) -> DataFrame:
    """Career volume regressed to the cohort's mean of earlier eras, by games played."""
    stats = [c for c in COHORT_STATS if f"f_career_{c}" in df.columns]
    rank = F.coalesce(F.col("depth_rank_capped"), F.lit(9.0)).cast("int") if "depth_rank_capped" in df.columns else F.lit(9)
    keyed = df.withColumn("__rank", rank)
    by = [roles.cohort, "__rank"]
    p = expanding_era_prior(keyed, by, roles.era, stats, "__p_")
    j = keyed.join(small_side(p), [*by, roles.era], "left")
    n = F.coalesce(F.col("f_games_prior").cast("double"), F.lit(0.0))
    zero = F.lit(0.0)
    cols = []
    for c in stats:
        own = F.col(f"f_career_{c}")
        level = F.coalesce(F.col(f"__p_{c}"), own, zero)
        cols.append(((F.coalesce(own, zero) * n + level * COHORT_K) / (n + COHORT_K)).alias(f"f_marcel_{c}"))
    return j.select(*df.columns, *cols)


def role_change(df: DataFrame, roles: Roles = PLAYER_PANEL) -> DataFrame:
    """Own usage against the norm of the same cohort and rank in earlier eras."""
    keyed = df.withColumn("__rank", F.coalesce(F.col("depth_rank_capped"), F.lit(-1.0)).cast("int"))
    usage = keyed.where("f_career_off_snaps IS NOT NULL")
    by = [roles.cohort, "__rank"]
    norm = expanding_era_prior(usage, by, roles.era, ["f_career_off_snaps"], "__p_")
    j = keyed.join(small_side(norm), [*by, roles.era], "left")
    rel = F.col("f_career_off_snaps") / F.nullif(F.col("__p_f_career_off_snaps"), F.lit(0.0))
    return j.select(
        *df.columns, rel.alias("f_usage_vs_rank"),
        F.coalesce((rel < PROMOTED_BELOW).cast("double"), F.lit(0.0)).alias("f_role_promoted"),
    )


def rival_cohort_block(df: DataFrame, cfg: Config = Config(), roles: Roles = PLAYER_PANEL) -> DataFrame:
    """What the rival allowed this cohort before, shrunk to the cohort's level of earlier eras.

    In a cohort's first era there is no earlier level and the feature is null; ``compat`` uses
    the mean over every era there instead.
    """
    return df.join(rival_cohort_side(df, cfg, roles), [roles.era, roles.period, roles.event, roles.cohort, roles.rival], "left")


def rival_cohort_side(df: DataFrame, cfg: Config = Config(), roles: Roles = PLAYER_PANEL) -> DataFrame:
    """The columns of ``rival_cohort_block``, a row per (era, period, event, cohort, rival)."""
    stats = [c for c in ALLOWED_STATS if c in df.columns]
    allowed = allowed_totals(df, stats)
    specs = [Spec(f"__s_{c}", "sum", c) for c in stats] + [Spec("__n", "count")]
    h = prior(allowed, ["def_team", roles.cohort], roles.order, roles.clock, specs, cfg.hot_rows)
    level = expanding_era_prior(allowed, [roles.cohort], roles.era, stats, "__p_")
    h = h.join(small_side(level), [roles.cohort, roles.era], "left")
    if cfg.compat:
        every = allowed.groupBy(roles.cohort).agg(*[F.avg(c).alias(f"__e_{c}") for c in stats])
        h = h.join(small_side(every), roles.cohort, "left")
    cols = []
    for c in stats:
        p = F.coalesce(f"__p_{c}", f"__e_{c}") if cfg.compat else F.col(f"__p_{c}")
        cols.append(((F.col(f"__s_{c}") + p * DEFENCE_K) / (F.col("__n") + DEFENCE_K)).alias(DEFENCE_PREFIX + c))
    keys = [roles.era, roles.period, roles.event, roles.cohort]
    return stored_side(h.select(*keys, F.col("def_team").alias(roles.rival), *cols), "allowed")


def team_block(df: DataFrame, team: DataFrame, league: DataFrame, cfg: Config = Config(), roles: Roles = PLAYER_PANEL) -> DataFrame:
    """Own group's tendency and the rival's defence from strictly earlier events.

    ``team``: one row per (event, group) with off_* and def_allowed_* and the opponent;
    ``league``: era and league_off_proe of completed eras.
    Default: the rival's own defensive rows. ``compat``: rows relabelled by opponent.
    """
    mine, other = team_sides(team, league, cfg, roles)
    return df.join(mine, [roles.event, roles.group], "left").join(other, [roles.event, roles.rival], "left")


def team_sides(team: DataFrame, league: DataFrame, cfg: Config = Config(), roles: Roles = PLAYER_PANEL) -> tuple[DataFrame, DataFrame]:
    """The columns of ``team_block``: a row per (event, group), and per (event, rival)."""
    specs = []
    for c in [c for c in TEAM_STATS if c in team.columns]:
        specs += [Spec(f"f_team_prior_{c}", "mean", c), Spec(f"f_team_r4_{c}", "rolling", c, cfg.team_window)]
    rival = [c for c in RIVAL_STATS if c in team.columns]
    rival_specs = [Spec(f"f_opp_prior_{c}", "mean", c) for c in rival]
    own = [] if cfg.compat else rival_specs
    t = prior(team, [roles.group], roles.order, roles.clock, specs + own, cfg.hot_rows)
    if "f_team_prior_off_proe" in t.columns:
        t = latest_prior_era(t, league, roles.era, "league_off_proe", "__league")
        t = t.withColumn("f_team_proe_centered", F.col("f_team_prior_off_proe") - F.col("__league"))
    mine = t.select(roles.event, roles.group, *[c for c in t.columns if c.startswith("f_team_")])
    if cfg.compat:
        r = prior(team, ["opponent"], roles.order, roles.clock, rival_specs, cfg.hot_rows)
        other = r.select(roles.event, F.col("opponent").alias(roles.rival), *[s.name for s in rival_specs])
    else:
        other = t.select(roles.event, F.col(roles.group).alias(roles.rival), *[s.name for s in rival_specs])
    return stored_side(mine, "group-side"), stored_side(other, "rival-side")


def reference_block(df: DataFrame, table: DataFrame, rates: list[str], on: dict[str, str], prefix: str, roles: Roles = PLAYER_PANEL) -> DataFrame:
    """Rates relative to their era's mean, seen one era later (scheme by rival, crew by official)."""
    rates = [c for c in rates if c in table.columns]
    rel = _relative(table, roles.era, list(on.values()), rates)
    return lagged_era(df, rel, roles.era, on, rates, prefix)


def _relative(table: DataFrame, era: str, keys: list[str], rates: list[str]) -> DataFrame:
    shares = era_share(table, era, rates, "__rel_")
    return shares.select(era, *keys, *[F.col(f"__rel_{c}").alias(c) for c in rates])


def build(
    df: DataFrame,
    team: DataFrame,
    league: DataFrame,
    priors: dict[str, float],
    cfg: Config = Config(),
    roles: Roles = PLAYER_PANEL,
    scheme: DataFrame | None = None,
    crew: DataFrame | None = None,
) -> DataFrame:
    """Every enabled block, in one order, for training and serving alike."""
    out = entity_block(df, priors, cfg, roles)
    if cfg.cohort_volume:
        out = cohort_volume(out, roles)
    if cfg.rival_cohort:
        out = rival_cohort_block(out, cfg, roles)
    if cfg.role_change:
        out = role_change(out, roles)
    if cfg.weather:
        out = mask_when(out, F.col("roof_indoor") > 0, WEATHER_FEATURES)
    if cfg.scheme:
        _need(scheme, "scheme")
        out = reference_block(out, scheme, SCHEME_RATES, {roles.rival: "def_team"}, "f_sch_", roles)
    if cfg.crew:
        _need(crew, "crew")
        out = reference_block(out, crew, CREW_RATES, {"referee": "referee"}, "f_", roles)
    return team_block(out, team, league, cfg, roles)


#: Bytes of rows that wait in a task to be packed by their place in the order.
IN_ORDER_WAITING = 128 << 20


def build_in_order(panel: DataFrame, team: DataFrame, league: DataFrame, priors: dict[str, float], cfg: Config = Config(), roles: Roles = PLAYER_PANEL, finish=None) -> DataFrame:
    """Keys and every default block's features of a stored panel, in the order of era, period, event, entity.

    ``finish``: what is made of the columns that are no exact window (posteriors, group and rival columns), such as a rounding; it is
    applied to the small sides before they are joined.

    Rows are put in order while their windows are packs of small whole numbers, a tenth of the wide rows; the columns of the group
    and rival blocks, broadcast, are joined after that. The order's slices are stretches of whole events. Where the events or the
    sides are too many for a broadcast, or one event is too large for a slice, the wide rows are put in order instead.
    """
    order, event = [*roles.order, roles.entity], [roles.era, roles.period, roles.event]
    finish = finish or (lambda c: c)
    done = lambda side: side.select(*[finish(F.col(c)).alias(c) if c.startswith("f_") else c for c in side.columns])
    spark = panel.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = materialise(panel.groupBy(*event, roles.rival, roles.cohort).agg(F.count(F.lit(1)).alias("__n")), "cells")
    events = cells.groupBy(*event).agg(F.sum("__n").alias("__n"))
    rows, most = cells.agg(F.sum("__n"), F.lit(0)).first()[0] or 0, events.agg(F.max("__n")).first()[0] or 0
    if cells.count() > SIDE_ROWS or most > SLICE_ROWS or cfg.compat or cfg.cohort_volume or cfg.role_change or cfg.weather or cfg.scheme or cfg.crew or not cfg.rival_cohort:
        dealt, slices = dealt_in_order(panel, order, "panel")
        wide = build(dealt, team, league, priors, cfg, roles)
        kept = [c for c in wide.columns if c.startswith("f_")]
        exact = {s.name for s in entity_specs(panel.columns, cfg, roles.era)}
        return in_order(wide.select(SLICE, *order, *[F.col(c) if c in exact else finish(F.col(c)).alias(c) for c in kept]), order, slices)
    slices = max(least, -(-rows // SLICE_ROWS))
    before = F.sum("__n").over(Window.orderBy(*event).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")  # at most SIDE_ROWS events
    places = events.select(*event, F.floor(before * slices / max(rows, 1)).cast("int").alias(SLICE))
    plan = history_plan(panel.columns, cfg, roles)
    rates = {f: (n, d, priors[p] if isinstance(p, str) else p, SHRINK_K[k]) for f, (n, d, p, k) in {**EFFICIENCY, **SHARES}.items() if f in plan.features}
    keep = list(dict.fromkeys([*order, roles.group, roles.rival, roles.cohort]))
    dealt = panel.join(F.broadcast(materialise(places, "slices")), event).repartition(roles.entity)
    found, late = packed_history(dealt, replace(plan, targets=()), entity_specs(panel.columns, cfg, roles.era), rates, [], {}, keep, roles.entity, roles.order, SLICE, IN_ORDER_WAITING)
    packs = Packs(found.repartitionById(slices, F.col("era").cast("int")), plan.features, (), late)
    wide = unpacked_rows(packs, [panel.schema[c] for c in keep], {"f_games_prior", "f_games_prior_season"})
    wide = wide.select(*[finish(F.col(c)).alias(c) if c in rates else c for c in wide.columns])
    wide = wide.join(F.broadcast(done(rival_cohort_side(panel, cfg, roles))), [*event, roles.cohort, roles.rival], "left")
    mine, other = (F.broadcast(done(side)) for side in team_sides(team, league, cfg, roles))
    wide = wide.join(mine, [roles.event, roles.group], "left").join(other, [roles.event, roles.rival], "left")
    return wide.select(*order, *[c for c in wide.columns if c.startswith("f_")]).sortWithinPartitions(*order)


def _need(table, name: str) -> None:
    if table is None:
        raise ValueError(f"the {name} block is on but its table is missing")


def priors_dict(row) -> dict[str, float]:
    """The single row of league priors as plain numbers."""
    return {k: float(v) for k, v in row.asDict().items()}
