"""Panel build and projection of future periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitpanel.functions import schedule as sc
from pitpanel.operators import aggregates as ag
from pitpanel.operators import shape as sh
from pitpanel.operators.joins import latest_prior_era, majority_or_own
from pitpanel.operators.ordered import Spec, prior, sized
from pitpanel.operators.windows import era_means, latest, rows_at_latest
from pitpanel.plans import blocks as fb
from pitpanel.roles import PLAYER_PANEL, Roles
from pitpanel.session import materialise
from pitpanel.sources.groups import canonical

# Roster label -> cohort.
COHORT_OF = {"QB": "QB", "RB": "RB", "FB": "FB", "WR": "WR", "TE": "TE", "PK": "K", "K": "K"}
COHORT_ORDER = ["QB", "RB", "FB", "WR", "TE", "K"]


def team_table(plays: DataFrame) -> DataFrame:
    """Group x event table with both sides."""
    return ag.with_rival_side(ag.team_side(plays))


def roster_normalized(snapshots: DataFrame, era: str = "season") -> DataFrame:
    """(era, week, team, entity, position, depth_rank): latest snapshot per (team, week, entity).

    Both source layouts are recognised by their columns; an unknown layout gives no rows.
    """
    cols = set(snapshots.columns)
    if {"club_code", "depth_team", "position"} <= cols:
        d = snapshots.where(F.col("game_type") == "REG") if "game_type" in cols else snapshots
        d = d.withColumnsRenamed({"club_code": "team", "depth_team": "depth_rank"})
        label, stamp = F.col("position"), F.lit(None).cast("string")
    elif {"team", "pos_rank", "pos_abb"} <= cols:
        d = snapshots.withColumnsRenamed({"pos_rank": "depth_rank"})
        label, stamp = F.col("pos_abb"), F.col("dt")
    else:
        d = snapshots.limit(0).withColumns(
            {c: F.lit(None).cast("string") for c in ("team", "gsis_id", "depth_rank", "week", era)}
        )
        label, stamp = F.lit(None).cast("string"), F.lit(None).cast("string")
    r = d.select(
        era, F.col("week").cast("int").alias("week"), canonical(F.col("team")).alias("team"), "gsis_id",
        sc.lookup(label, COHORT_OF).alias("position"), F.col("depth_rank").try_cast("double").alias("depth_rank"),
        stamp.alias("__dt"),
    ).where("position IS NOT NULL AND gsis_id IS NOT NULL AND week IS NOT NULL")
    return latest(r, [era, "team", "week", "gsis_id"], ["__dt", "depth_rank"]).drop("__dt")


def latest_roster(snapshots: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Every roster row of each group's newest snapshot."""
    return rows_at_latest(snapshots, keys, stamp)


def roster_order(label: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(p) for p in COHORT_ORDER]), label)
    return F.when(place > 0, place).otherwise(F.lit(len(COHORT_ORDER) + 1))


def inference_rows(games: DataFrame, roster: DataFrame, injuries: DataFrame | None, bio: DataFrame | None) -> DataFrame:
    """Rows for events still to come, derived exactly as in history.

    games: game_id, home_team, away_team, spread_line, total_line, home_rest, away_rest, gameday
    and any pass-through columns; roster: team, gsis_id, position, depth_rank.
    """
    legs = sh.home_away_legs(sc.implied_totals(games))
    at_home = F.col("is_home") == 1
    g = sc.perspective(
        legs, at_home,
        {
            "team_implied_total": ("home_implied_total", "away_implied_total"),
            "opp_implied_total": ("away_implied_total", "home_implied_total"),
            "rest_days": ("home_rest", "away_rest"),
            "opp_rest_days": ("away_rest", "home_rest"),
        },
        [("team_spread", "spread_line")],
    ).drop("home_implied_total", "away_implied_total", "home_rest", "away_rest", "home_team", "away_team")
    rows = sh.rank_cap(g.join(roster, "team"))
    if injuries is not None:
        rep = injuries.where("gsis_id IS NOT NULL").select("gsis_id", "report_status", "practice_status")
        one = rep.groupBy("gsis_id").agg(F.max_by(F.struct("report_status", "practice_status"), F.struct("report_status", "practice_status")).alias("r"))
        rows = rows.join(one.select("gsis_id", "r.*"), "gsis_id", "left")
    else:
        none = F.lit(None).cast("string")
        rows = rows.withColumn("report_status", none).withColumn("practice_status", none)
    rows = sh.injury_codes(rows)
    if bio is not None:
        rows = sh.bio(rows.join(bio, "gsis_id", "left"))
    return latest(rows, ["gsis_id", "game_id"], ["depth_rank"])


#: An era after all others, and a period after all of an era: where a made-up row closes a timeline.
END_ERA, END_PERIOD = 9_999, 99


def _closed(history: DataFrame, asks: DataFrame, keys: list[str], roles: Roles, within_era: bool = False) -> DataFrame:
    """History plus one row per asked key after all its rows (or after all of an asked era). Nothing comes behind it, so it adds nothing to a row."""
    kinds = dict(history.dtypes)
    end = asks.select(*keys, *([roles.era] if within_era else [])).distinct()
    if not within_era:
        end = end.withColumn(roles.era, F.lit(END_ERA).cast(kinds[roles.era]))
    return sh.union_ragged(history, end.withColumn(roles.period, F.lit(END_PERIOD).cast(kinds[roles.period])))


def _states_at(asks: DataFrame, history: DataFrame, keys: list[str], specs: list[Spec], columns, roles: Roles, hot_rows=None, within_era: bool = False) -> DataFrame:
    """asks (keys, era, period) with ``columns`` of the first state at or after the asked period.

    A state row holds what was known strictly before it, and no row lies between the asked period and it. A state answers the
    asks that lie behind the row before it and not behind itself; the asks of a key are a list, one for each of its periods, that
    is joined on the exchange of the windows. Only answers are carried on, so no state crosses the network.
    """
    when = [roles.era, roles.period]
    at = roles.clock.cast("double")
    closed = _closed(history, asks, keys, roles, within_era).withColumn("__when", at)
    states = prior(closed, keys, roles.order, F.col("__when"), [*specs, Spec("__prev", "rolling", "__when", 1)], hot_rows)
    of = [*keys, roles.era] if within_era else keys
    asked = asks.select(*keys, *when, at.alias("__at")).distinct()
    lists = asked.groupBy(*of).agg(F.collect_list(F.struct(*[F.col(c).alias(f"__a_{c}") for c in when], "__at")).alias("__asks"))
    mine = F.filter("__asks", lambda a: (a["__at"] <= F.col("__when")) & (F.col("__prev").isNull() | (a["__at"] > F.col("__prev"))))
    found = states.join(lists, of).withColumn("__a", F.explode(mine))
    return found.select(*keys, *[F.col(f"__a.__a_{c}").alias(c) for c in when], *columns)


def _asked(rows: DataFrame, keys: dict[str, str], when: list[str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(k) for k, c in keys.items()], *when).where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).distinct()


def project(
    history: DataFrame, future: DataFrame, team: DataFrame, league: DataFrame, priors: dict[str, float],
    cfg: fb.Config = fb.Config(), roles: Roles = PLAYER_PANEL,
) -> DataFrame:
    """Features of all future rows in one plan, whatever the number of periods.

    Future rows ask and never contribute: each sees the history strictly before its own (era, period). States before every
    event are worked out once per entity, per (rival, cohort) and per group, with one closing row each, and the first state at
    or after an asking (key, era, period) answers it. History is reduced to the entities that are projected; that
    is safe because entity windows never look across entities.
    """
    when = [roles.era, roles.period]
    rows = materialise(majority_or_own(future, history, roles.entity, roles.cohort, "chart_position"), "future")
    entity, *others = (_entity(history, rows, priors, cfg, roles), _rival_cohort(history, rows, cfg, roles), *_groups(team, league, rows, cfg, roles))
    out = rows
    for found, on in others:  # a row per asking group, or rival and cohort: joined while the rows are narrow
        known = materialise(found, "states")
        out = out.join(sized(known, known.count()), [*on, *when], "left")
    found, on = entity
    out = out.join(found, [*on, *when], "left")
    named = [c for found, on in (entity, *others) for c in found.columns if c not in (*on, *when)]
    return out.select(*rows.columns, *named)


def _entity(history, rows, priors, cfg, roles):
    key = [roles.entity]
    asks = _asked(rows, {roles.entity: roles.entity}, [roles.era, roles.period])
    slim = history.join(asks.select(*key).distinct(), key, "left_semi")
    specs = fb.entity_specs(history.columns, cfg, roles.era)
    inner = [s for s in specs if s.within]
    totals = fb.posterior_specs(history.columns)
    posteriors = fb.posterior_columns(history.columns, priors)
    always = [s.name for s in specs if not s.within]
    ever = _states_at(asks, slim, key, [*[s for s in specs if not s.within], *totals], [*always, *posteriors], roles, cfg.hot_rows)
    per = [roles.entity, roles.era]
    same = slim.join(asks.select(*per).distinct(), per, "left_semi")
    of_era = _states_at(asks, same, key, inner, [s.name for s in inner], roles, cfg.hot_rows, within_era=True)
    both = ever.join(of_era, [*key, roles.era, roles.period])
    names = [s.name for s in specs] + [c for c in ever.columns if c not in (*per, roles.period, *always)]
    return both.select(*key, roles.era, roles.period, *names), key


def _rival_cohort(history, rows, cfg, roles):
    keys = ["def_team", roles.cohort]
    asks = _asked(rows, {"def_team": roles.rival, roles.cohort: roles.cohort}, [roles.era, roles.period])
    stats = [c for c in fb.ALLOWED_STATS if c in history.columns]
    allowed = ag.allowed_totals(history, stats)
    specs = [Spec(f"__s_{c}", "sum", c) for c in stats] + [Spec("__n", "count")]
    found = _states_at(asks, allowed, keys, specs, [s.name for s in specs], roles, cfg.hot_rows)
    # The cohort's level: the mean of the means of all earlier eras; rows are (cohort, era) pairs only.
    means = era_means(allowed, [roles.cohort], roles.era, stats).select(F.col(roles.cohort).alias("__c"), F.col(roles.era).alias("__e"), *[F.col(c).alias(f"__m_{c}") for c in stats])
    eras = asks.select(roles.cohort, roles.era).distinct()
    level = eras.join(means, (F.col(roles.cohort) == F.col("__c")) & (F.col("__e") < F.col(roles.era)), "left").groupBy(roles.cohort, roles.era)
    found = found.join(level.agg(*[F.avg(f"__m_{c}").alias(f"__p_{c}") for c in stats]), [roles.cohort, roles.era], "left")
    if cfg.compat:  # where no era is over yet, the mean of all earlier events of the cohort
        by = [roles.cohort]
        any_rival = asks.select(*by, roles.era, roles.period).distinct()
        every = [Spec(f"__a_{c}", "mean", c) for c in stats]
        found = found.join(_states_at(any_rival, allowed, by, every, [s.name for s in every], roles, cfg.hot_rows), [*by, roles.era, roles.period], "left")
    cols = []
    for c in stats:
        p = F.coalesce(f"__p_{c}", f"__a_{c}") if cfg.compat else F.col(f"__p_{c}")
        cols.append(((F.col(f"__s_{c}") + p * fb.DEFENCE_K) / (F.col("__n") + fb.DEFENCE_K)).alias(fb.DEFENCE_PREFIX + c))
    return found.select(F.col("def_team").alias(roles.rival), roles.cohort, roles.era, roles.period, *cols), [roles.rival, roles.cohort]


def _groups(team, league, rows, cfg, roles):
    when = [roles.era, roles.period]
    mine = [c for c in fb.TEAM_STATS if c in team.columns]
    own = [s for c in mine for s in (Spec(f"f_team_prior_{c}", "mean", c), Spec(f"f_team_r4_{c}", "rolling", c, cfg.team_window))]
    rival = [Spec(f"f_opp_prior_{c}", "mean", c) for c in fb.RIVAL_STATS if c in team.columns]
    asks = _asked(rows, {roles.group: roles.group}, when)
    other = _asked(rows, {roles.group: roles.rival}, when)
    key = [roles.group]
    mixed = [] if cfg.compat else rival
    states = _states_at(asks.union(other).distinct(), team, key, own + mixed, [s.name for s in own + mixed], roles, cfg.hot_rows)
    states = materialise(states, "group-states")
    found = states.select(*key, *when, *[s.name for s in own])
    if any(s.name == "f_team_prior_off_proe" for s in own):
        found = latest_prior_era(found, league, roles.era, "league_off_proe", "__league")
        found = found.withColumn("f_team_proe_centered", F.col("f_team_prior_off_proe") - F.col("__league")).drop("__league")
    if cfg.compat:  # rows relabelled by opponent
        by = ["opponent"]
        other = other.withColumnRenamed(roles.group, "opponent")
        theirs = _states_at(other, team, by, rival, [s.name for s in rival], roles, cfg.hot_rows).withColumnRenamed("opponent", roles.rival)
    else:
        theirs = states.select(F.col(roles.group).alias(roles.rival), *when, *[s.name for s in rival])
    return (found, key), (theirs, [roles.rival])
