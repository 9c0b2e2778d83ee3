"""Posted lines against projections: resolve, compare, rank, split, freeze, grade, record.

Projections travel as one map per entity, so a stat made of several parts is evaluated inside
the row. The comparison is two equi joins (stat rules, entity) and no grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitpanel.functions.names import normalize_name
from pitpanel.functions.prob import (
    CEIL, FLOOR, knots_below, median_ratio, poisson_at_least, prob_over, threshold_for_line, times_ratio, wilson,
)
from pitpanel.operators.joins import bin_lookup, first_per_key, id_then_name
from pitpanel.operators.ordered import fenced, lookup_join, ranked
from pitpanel.operators.windows import first_seen
from pitpanel.session import constant_table

# Board label -> kind and weighted projection columns.
STAT_RULES = {
    "pass yards": ("mean", {"passing_yards": 1.0}),
    "passing yards": ("mean", {"passing_yards": 1.0}),
    "pass tds": ("prob", {"passing_tds": 1.0}),
    "pass touchdowns": ("prob", {"passing_tds": 1.0}),
    "pass attempts": ("mean", {"attempts": 1.0}),
    "pass completions": ("mean", {"completions": 1.0}),
    "completions": ("mean", {"completions": 1.0}),
    "interceptions thrown": ("prob", {"passing_interceptions": 1.0}),
    "int": ("prob", {"passing_interceptions": 1.0}),
    "sacks taken": ("prob", {"sacks_suffered": 1.0}),
    "rush yards": ("mean", {"rushing_yards": 1.0}),
    "rushing yards": ("mean", {"rushing_yards": 1.0}),
    "rush attempts": ("mean", {"carries": 1.0}),
    "carries": ("mean", {"carries": 1.0}),
    "receiving yards": ("mean", {"receiving_yards": 1.0}),
    "rec yards": ("mean", {"receiving_yards": 1.0}),
    "receptions": ("mean", {"receptions": 1.0}),
    "targets": ("mean", {"targets": 1.0}),
    "rec targets": ("mean", {"targets": 1.0}),
    "receiving targets": ("mean", {"targets": 1.0}),
    "rush+rec yds": ("mean", {"rushing_yards": 1.0, "receiving_yards": 1.0}),
    "pass+rush yds": ("mean", {"passing_yards": 1.0, "rushing_yards": 1.0}),
    "rec+rush yds": ("mean", {"receiving_yards": 1.0, "rushing_yards": 1.0}),
    "rush+rec yards": ("mean", {"rushing_yards": 1.0, "receiving_yards": 1.0}),
    "rush + rec yards": ("mean", {"rushing_yards": 1.0, "receiving_yards": 1.0}),
    "pass+rush yards": ("mean", {"passing_yards": 1.0, "rushing_yards": 1.0}),
    "pass + rush yards": ("mean", {"passing_yards": 1.0, "rushing_yards": 1.0}),
    "rec+rush yards": ("mean", {"receiving_yards": 1.0, "rushing_yards": 1.0}),
    "player touchdowns": ("prob", {"rushing_tds": 1.0, "receiving_tds": 1.0}),
    "anytime td": ("prob", {"rushing_tds": 1.0, "receiving_tds": 1.0}),
    "anytime touchdown": ("prob", {"rushing_tds": 1.0, "receiving_tds": 1.0}),
    "pass+rush+rec tds": ("prob", {"rushing_tds": 1.0, "receiving_tds": 1.0, "passing_tds": 1.0}),
    "rush tds": ("prob", {"rushing_tds": 1.0}),
    "rec tds": ("prob", {"receiving_tds": 1.0}),
    "receiving tds": ("prob", {"receiving_tds": 1.0}),
    "fg made": ("prob", {"fg_made": 1.0}),
    "field goals made": ("prob", {"fg_made": 1.0}),
    "kicking points": ("wsum", {"fg_made": 3.0, "pat_att": 1.0}),
}

# Board labels that are refused. The reasons are explanations for a reader.
REFUSED = {
    "longest reception": "the best single play of a game; a game total says nothing of it",
    "longest rush": "the best single play of a game; a game total says nothing of it",
    "longest completion": "the best single play of a game; a game total says nothing of it",
    "longest passing completion": "the best single play of a game; a game total says nothing of it",
    "longest field goal": "the best single play of a game; a game total says nothing of it",
    "rush yards in first 5 attempts": "counts the opening plays only; totals cover the whole game",
    "receiving yards in first 2 receptions": "counts the opening plays only; totals cover the whole game",
    "first td scorer": "depends on who scores earlier than others",
    "tackles": "no target of this kind is modelled",
    "sacks": "no target of this kind is modelled",
}

# Composite score weights and the labels that ask for it.
FANTASY_LABELS = ["fantasy score", "fantasy points"]
FANTASY_WEIGHTS = {
    "passing_yards": 0.04, "rushing_yards": 0.10, "receiving_yards": 0.10, "receptions": 1.0,
    "passing_tds": 4.0, "rushing_tds": 6.0, "receiving_tds": 6.0,
    "passing_interceptions": -1.0, "fumbles_lost": -1.0,
}
FUMBLE_PARTS = ["rushing_fumbles_lost", "receiving_fumbles_lost", "sack_fumbles_lost"]

# Reliability tiers from best to worst, and sources from best to worst.
TIERS = ["strong", "moderate", "weak", "none", "negative"]
SOURCES = ["model", "model_low_confidence", "baseline"]
MIN_GAMES = 3
PERIOD = ("season", "week")
FREEZE_KEYS = [*PERIOD, "player", "stat"]

_COMPONENTS = "array<struct<col:string,w:double>>"


def stat_rules(spark: SparkSession) -> DataFrame:
    """The rule dimension: label, action, reason, kind, components."""
    def row(label, action, reason=None, kind=None, parts=()):
        comps = [{"col": c, "w": w} for c, w in dict(parts).items()]
        return {"label": label, "action": action, "reason": reason, "kind": kind, "comps": comps}

    rows = [row(k, "refuse", why) for k, why in REFUSED.items()]
    rows += [row(k, "price", None, kind, parts) for k, (kind, parts) in STAT_RULES.items() if k not in REFUSED]
    rows += [row(k, "price", None, "fantasy", FANTASY_WEIGHTS) for k in FANTASY_LABELS]
    return constant_table(
        spark, rows, f"label:string,action:string,reason:string,kind:string,comps:{_COMPONENTS}"
    )


def tier_rank(tier: Column) -> Column:
    """0 for the best tier; unknown tiers rank with 'weak'."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)
    return F.when(place > 0, place - 1).otherwise(F.lit(2)).cast("int")


def rule_tiers(rules: DataFrame, reliability: DataFrame) -> DataFrame:
    """Weakest-link tier per label: worst measured component, unmeasured if any lacks an edge.

    reliability: stat, tier, side_edge_pts, pos (file order).
    """
    parts = rules.where("kind <> 'fantasy'").select("label", F.explode("comps.col").alias("stat"))
    hit = parts.join(reliability, "stat").groupBy("label").agg(
        F.max_by(F.struct("tier", "side_edge_pts"), F.struct(tier_rank(F.col("tier")), -F.col("pos"))).alias("w"),
        F.bool_or(F.col("side_edge_pts").isNull()).alias("open"),
    )
    return hit.select(
        "label", F.when(F.col("open"), "unmeasured").otherwise(F.col("w.tier")).alias("tier"),
        F.col("w.side_edge_pts").alias("tier_edge"),
    )


def pack(df: DataFrame, columns: list[str], suffix: str = "") -> Column:
    """Named columns as a map; columns the frame lacks are absent from it."""
    have = [c for c in columns if c + suffix in df.columns]
    if not have:
        return F.create_map().cast("map<string,string>" if suffix else "map<string,double>")
    return F.create_map(*[x for c in have for x in (F.lit(c), F.col(c + suffix))])


def all_columns() -> list[str]:
    return sorted({c for _, parts in STAT_RULES.values() for c in parts} | set(FANTASY_WEIGHTS))


def component_sum(comps: Column, vals: Column) -> Column:
    """Weighted sum over present components."""
    return F.aggregate(
        comps, F.lit(0.0), lambda acc, c: acc + F.coalesce(F.try_element_at(vals, c["col"]) * c["w"], F.lit(0.0))
    )


def any_missing(comps: Column, vals: Column) -> Column:
    return F.exists(comps, lambda c: F.try_element_at(vals, c["col"]).isNull())


def any_present(comps: Column, vals: Column) -> Column:
    return F.exists(comps, lambda c: F.try_element_at(vals, c["col"]).isNotNull())


def offered_sides(direction: Column, odds_type: Column) -> Column:
    """An explicit direction wins; every known odds type falls back to both, as does an unknown one."""
    d = F.lower(F.trim(F.coalesce(direction, F.lit(""))))
    return F.when(d.isin("both", "more", "less"), d).otherwise(F.lit("both"))


def pickable(lean: Column, sides: Column) -> Column:
    side = F.lower(F.trim(F.coalesce(lean, F.lit(""))))
    offered = F.lower(F.trim(F.coalesce(sides, F.lit("both"))))
    return side.isin("more", "less") & ((offered == "both") | (offered == side))


def lean_from(x: Column, middle: Column) -> Column:
    return F.when(x > middle, "More").when(x < middle, "Less").otherwise("Even")


def source_rollup(comps: Column, sources: Column, registry: Column) -> Column:
    """Worst provenance over the components: per-row source, else the registry's, else model."""
    ranks = F.transform(
        comps,
        lambda c: F.array_position(
            F.array(*[F.lit(s) for s in SOURCES]),
            F.coalesce(F.try_element_at(sources, c["col"]), F.try_element_at(registry, c["col"]), F.lit("model")),
        ),
    )
    return F.element_at(F.array(*[F.lit(s) for s in SOURCES]), F.greatest(F.array_max(ranks), F.lit(1)).cast("int"))


def compare(
    lines: DataFrame,
    projections: DataFrame,
    calibration: DataFrame | None = None,
    reliability: DataFrame | None = None,
    registry: dict[str, str] | None = None,
    order: tuple[str, ...] = ("team", "position", "depth_rank"),
    hot_rows: int | None = None,
) -> DataFrame:
    """Every posted line with a disposition; priced ones carry the full comparison.

    disposition is one of refused, unmapped, unmatched, unprojected, matched, and the five add
    up to the lines posted. ``calibration``: target, lo, hi, quantiles, q_grid.
    """
    spark = lines.sparkSession
    rules = stat_rules(spark)
    if reliability is not None:
        rules = rules.join(rule_tiers(rules, reliability), "label", "left")
    else:
        rules = rules.withColumn("tier", F.lit(None).cast("string")).withColumn("tier_edge", F.lit(None).cast("double"))
    # The rule table is a constant of about fifty rows.
    tagged = lines.withColumn("label", F.lower(F.trim(F.coalesce("stat_type", F.lit(""))))).join(
        F.broadcast(rules), "label", "left"
    )
    names = all_columns()
    order_cols = [c for c in order if c in projections.columns] + ["gsis_id"]
    ident = ["gsis_id", "player_display_name", "team", "position", "opponent_team", "game_id"]
    p = projections.select(
        normalize_name(F.col("player_display_name")).alias("name_key"),
        *[F.col(c) if c in projections.columns else F.lit(None).cast("string").alias(c) for c in ident],
        *[c for c in order_cols if c not in ident],
        (F.col("f_games_prior") if "f_games_prior" in projections.columns else F.lit(None)).cast("double").alias("f_games_prior"),
        (F.col("p_play") if "p_play" in projections.columns else F.lit(None)).cast("double").alias("p_play"),
        pack(projections, names).alias("vals"),
        pack(projections, names, "_source").alias("srcs"),
    )
    held = [c for c in p.columns if c != "name_key" and c not in ("vals", "srcs")]
    best = p.groupBy("name_key").agg(
        F.min_by(F.struct(*held, "vals", "srcs"), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\U0010ffff")) if dict(p.dtypes)[c] == "string" else F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))) for c in order_cols])).alias("p")
    )
    key = normalize_name(F.col("name"))
    j = lookup_join(
        tagged.withColumn("name_key", key), best, ["name_key"], "left", hot_rows, probe=lines.select(key.alias("name_key"))
    )
    comps = F.col("comps")
    j = fenced(
        j, __total=component_sum(comps, F.col("p.vals")), __missing=any_missing(comps, F.col("p.vals"))
    )
    total = F.col("__total")
    lacking = (
        F.when(F.col("kind") == "prob", total <= 0)
        .when(F.col("kind") == "fantasy", F.lit(False))
        .otherwise(F.col("__missing"))
    )
    disposition = (
        F.when(F.col("action") == "refuse", "refused")
        .when(F.col("action").isNull(), "unmapped")
        .when(F.col("p").isNull(), "unmatched")
        .when(lacking, "unprojected")
        .otherwise("matched")
    )
    reg = F.create_map(*[F.lit(x) for kv in (registry or {"": "model"}).items() for x in kv])
    is_prob = F.col("kind") == "prob"
    chance = F.least(F.lit(CEIL), F.greatest(F.lit(FLOOR), poisson_at_least(total, threshold_for_line(F.col("line")))))
    raw = (
        F.when(is_prob, chance).when(F.col("kind") == "fantasy", F.round(total, 2)).otherwise(total)
    )
    single = (F.col("kind") == "mean") & (F.size(comps) == 1)
    v = fenced(j.withColumn("disposition", disposition), __raw=raw)
    matched = F.col("disposition") == "matched"
    source = F.when(F.col("kind") == "fantasy", "composite").otherwise(source_rollup(comps, F.col("p.srcs"), reg))
    v = v.select(
        *lines.columns, "label", "kind", "reason", "tier", "tier_edge", "disposition",
        F.when(matched, F.col("p")).alias("p"),
        F.when(matched, F.col("__raw")).alias("raw"),
        F.when(matched, source).alias("source"),
        F.when(matched & single, comps[0]["col"]).alias("target"),
    )
    if calibration is not None:
        # Targets are those of the rules. The median ratio is of the bin, and the place of a row among its knots is found once.
        mid = calibration.withColumn("__mid", median_ratio(F.col("quantiles"), F.col("q_grid")))
        v = bin_lookup(v, mid, "target", "raw", ["quantiles", "q_grid", "__mid"], few=True)
    else:
        none = F.lit(None).cast("array<double>")
        v = v.withColumns({"quantiles": none, "q_grid": none, "__mid": F.lit(None).cast("double")})
    v = fenced(v, __k=knots_below(F.col("line") / F.col("raw"), F.col("quantiles")))
    v = fenced(
        v, p_raw=prob_over(F.col("raw"), F.col("line"), F.col("quantiles"), F.col("q_grid"), F.col("__k")), __median=times_ratio(F.col("raw"), F.col("__mid"))
    )
    has_p = F.col("p_raw").isNotNull()
    is_prob = F.col("kind") == "prob"
    against = F.when(is_prob, F.lit(0.5)).otherwise(F.col("line"))
    v = v.withColumn("__model", F.when(has_p, F.coalesce("__median", "raw")).otherwise(F.col("raw")))
    v = v.withColumn("__diff", F.col("__model") - against)
    lean = F.when(has_p, lean_from(F.col("p_raw"), F.lit(0.5))).otherwise(lean_from(F.col("__diff"), F.lit(0.0)))
    return v.select(
        *[c for c in lines.columns if c not in ("position", "team")],
        "disposition", "reason",
        F.col("p.player_display_name").alias("player"), F.col("p.team").alias("team"),
        F.col("p.position").alias("position"), F.col("p.opponent_team").alias("opponent"),
        F.when(matched, F.col("stat_type")).alias("stat"),
        F.round("__model", 2).alias("model"), F.round("__diff", 2).alias("diff"),
        F.when(matched, F.when(is_prob, "probability").otherwise("mean")).alias("kind"),
        F.when(is_prob, F.round(100 * F.col("__diff"), 1))
        .when(F.col("line") != 0, F.round(100 * F.col("__diff") / F.col("line"), 1))
        .alias("diff_pct"),
        F.when(matched, lean).alias("lean"),
        F.round("p_raw", 4).alias("p_over"),
        F.when(matched, offered_sides(F.col("direction"), F.col("odds_type"))).alias("sides"),
        "source", F.col("p.gsis_id").alias("gsis_id"), F.col("p.game_id").alias("game_id"),
        F.when(matched, F.coalesce("tier", F.lit("unmeasured"))).alias("tier"), "tier_edge",
        F.when(matched, F.coalesce(F.col("p.f_games_prior"), F.lit(0.0))).alias("games_prior"),
        F.col("p.p_play").alias("p_play"),
    )


def single_targets(lines: DataFrame) -> set[str]:
    """Targets that posted lines are priced by one at a time: the only ones whose calibration is read. At most one per rule."""
    single = {k: next(iter(parts)) for k, (kind, parts) in STAT_RULES.items() if kind == "mean" and len(parts) == 1 and k not in REFUSED}
    label = F.lower(F.trim("stat_type"))
    return {single[r[0]] for r in lines.select(label.alias("label")).where(F.col("label").isin(list(single))).distinct().collect()}


def accounting(compared: DataFrame) -> DataFrame:
    """Counts by disposition, stat, source and tier: the reasons an empty board is empty."""
    return compared.groupBy(
        "disposition", "stat_type", "reason", "source", "tier"
    ).agg(F.count(F.lit(1)).alias("n"))


def confidence(df: DataFrame) -> Column:
    """Distance from a coin flip where a probability exists, else the relative gap scaled down."""
    gap = F.coalesce(F.abs("diff_pct") / 400.0, F.lit(0.0))
    p = F.when(F.col("kind") == "probability", F.abs(F.col("model") - 0.5)).otherwise(F.abs(F.col("p_over") - 0.5))
    return F.coalesce(p, gap)


def rank_board(df: DataFrame, tie: list[str]) -> DataFrame:
    """Best tier first, then most confident; a stable tie-break last."""
    return df.orderBy(tier_rank(F.col("tier")), confidence(df).desc(), *tie)


def board_rows(compared: DataFrame) -> DataFrame:
    """The one definition of what a reader sees: withheld_reason is null for shown rows."""
    can = pickable(F.col("lean"), F.col("sides"))
    informed = F.coalesce(F.col("games_prior"), F.lit(0.0)) >= MIN_GAMES
    return compared.where("disposition = 'matched'").withColumn(
        "withheld_reason", F.when(~can, "side_not_offered").when(~informed, "thin_history")
    )


def collapse_alternates(lines: DataFrame, arrival: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """One line per (player, stat) and ``within``: the standard one first, then the newest arrival."""
    from pitpanel.operators.windows import collapse_ladder

    keyed = lines.withColumn("__name", normalize_name(F.col("name"))).withColumn(
        "__stat", F.lower(F.trim("stat_type"))
    )
    alt = F.coalesce(F.col("odds_type") != "standard", F.lit(True))
    return collapse_ladder(keyed, [*within, "__name", "__stat"], alt, arrival).drop("__name", "__stat")


def freeze(
    compared: DataFrame, frozen: DataFrame | None, frozen_at: Column, model_version: str,
    keys: list[str] = FREEZE_KEYS, tie: list[str] | None = None,
) -> DataFrame:
    """Rows to append to the frozen record: keys not frozen before, one row each, stamped."""
    new = first_seen(compared, keys, tie or compared.columns[:1])
    if frozen is not None:
        new = new.join(frozen.select(*keys).distinct(), keys, "left_anti")
    return new.withColumn("frozen_at", frozen_at).withColumn("model_version", F.lit(model_version))


def actual_values(actuals: DataFrame) -> DataFrame:
    """Box score rows as id, name key and a map of values; lost fumbles come from their parts."""
    parts = [c for c in FUMBLE_PARTS if c in actuals.columns]
    a = actuals
    if parts:
        some = F.lit(False)
        lost = F.lit(0.0)
        for c in parts:
            some, lost = some | F.col(c).isNotNull(), lost + F.coalesce(F.col(c), F.lit(0.0))
        a = a.withColumn("fumbles_lost", F.when(some, lost))
    keep = [c for c in (*PERIOD, "game_id") if c in a.columns]
    return a.select(
        *keep, "gsis_id", normalize_name(F.col("player_display_name")).alias("name_key"), pack(a, all_columns()).alias("vals")
    )


def grade(table: DataFrame, actuals: DataFrame, hot_rows: int | None = None, periods: tuple[str, ...] = PERIOD) -> DataFrame:
    """Add actual, result (More, Less, Exact) and model_correct (null on Exact).

    A line is graded by the actuals of its own period. The id decides the match, the name only when
    the id is missing or unknown in that period; of several events of one period the first one
    counts. Rows without a complete actual value are left out.
    """
    rules = stat_rules(table.sparkSession).where("action = 'price'").select("label", F.col("kind").alias("rule_kind"), "comps")
    t = table.withColumn("label", F.lower(F.trim("stat"))).join(F.broadcast(rules), "label")
    t = t.withColumn("name_key", normalize_name(F.col("player")))
    a = actual_values(actuals)

    def in_period(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.to_json(F.struct(*[F.col(p).cast("string").alias(p) for p in periods], F.col(c).cast("string").alias("of"))))

    t, a = (x.withColumn("__id", in_period("gsis_id")).withColumn("__name", in_period("name_key")) for x in (t, a))
    tie = [c for c in ("game_id",) if c in a.columns] + ["gsis_id"]
    j = id_then_name(t, a, "__id", "__name", tie, ["vals"], hot_rows)
    comps, vals = F.col("comps"), F.col("vals")
    fantasy = F.col("rule_kind") == "fantasy"
    j = fenced(
        j.where("matched"), __sum=component_sum(comps, vals),
        __whole=F.when(fantasy, any_present(comps, vals)).otherwise(~any_missing(comps, vals)),
    )
    value = F.round("__sum", 2)
    exact_value = F.when(fantasy, value).otherwise(F.col("__sum"))
    result = F.when(exact_value > F.col("line"), "More").when(exact_value < F.col("line"), "Less").otherwise("Exact")
    g = j.where("__whole").withColumn("actual", value).withColumn("result", result)
    return g.select(
        *table.columns, "actual", "result",
        F.when(F.col("result") != "Exact", F.col("result") == F.col("lean")).alias("model_correct"),
    )


def eligible_record(graded: DataFrame, era: str, trained_through: int) -> DataFrame:
    """Frozen, out-of-sample rows only."""
    return graded.where((F.col("basis") == "frozen") & (F.col(era) > trained_through))


def in_sample(era: Column, trained_through) -> Column:
    return F.coalesce(era <= F.lit(trained_through), F.lit(False))


def record(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Decided picks, hits, interval, ties, and whether the lower bound beats the common side."""
    decided = F.col("model_correct").isNotNull()
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count("model_correct").alias("decided"),
        F.count_if("model_correct").alias("hits"),
        F.count_if(~decided).alias("ties"),
        F.avg(F.when(decided, (F.col("result") == "More").cast("double"))).alias("over"),
    ]
    r = graded.groupBy(*by).agg(*aggs) if by else graded.agg(*aggs)
    lo, hi = wilson(F.col("hits"), F.col("decided"))
    base = F.greatest(F.col("over"), 1.0 - F.col("over"))
    return r.select(
        *(by or []), "n", "decided", "hits", "ties",
        F.round(100 * F.col("hits") / F.nullif("decided", F.lit(0)), 1).alias("hit_rate"),
        F.round(100 * lo, 1).alias("ci_low"), F.round(100 * hi, 1).alias("ci_high"),
        F.round(100 * base, 1).alias("baseline"), (lo > base).alias("beats_coin"),
    )


def scorecard(graded: DataFrame, by: list[str]) -> DataFrame:
    """Per period: decided, ties, hit rate and the two mean absolute errors."""
    return graded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("model_correct").alias("decided"),
        F.count_if(F.col("result") == "Exact").alias("exact_ties"),
        F.count_if("model_correct").alias("hits"),
        F.round(100 * F.count_if("model_correct") / F.nullif(F.count("model_correct"), F.lit(0)), 1).alias("hit_rate"),
        F.round(F.avg(F.abs(F.col("model") - F.col("actual"))), 2).alias("mae"),
        F.round(F.avg(F.abs(F.col("line") - F.col("actual"))), 2).alias("line_mae"),
    )


def entity_pages(df: DataFrame, key: str, order: list[str], clock: Column, fields: list[str], size: int = 500, hot_rows=None) -> DataFrame:
    """Rows per entity as lists of at most ``size`` structs; long entities get several pages."""
    n = ranked(df, [key], order, clock, "__rn", hot_rows)
    paged = n.withColumn("page", F.floor((F.col("__rn") - 1) / size))
    return paged.groupBy(key, "page").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__rn", *fields))),
            lambda s: F.struct(*[s[f].alias(f) for f in fields]),
        ).alias("rows")
    )


def line_counts(board: DataFrame, event: str = "game_id") -> DataFrame:
    """Shown lines per event."""
    return board.where(F.col("withheld_reason").isNull() & F.col(event).isNotNull()).groupBy(event).agg(
        F.count(F.lit(1)).alias("lines")
    )


def weak_evidence(board: DataFrame) -> DataFrame:
    """Rows leaning on stats without a measured edge, per stat."""
    return board.where(F.col("tier").isin("none", "negative")).groupBy("stat").agg(
        F.count(F.lit(1)).alias("n"), F.min("tier_edge").alias("edge")
    )
