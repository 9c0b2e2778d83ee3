"""Projections, filters and reshapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitpanel.functions.schedule import lookup

# Play types that count as scrimmage plays.
SCRIMMAGE_TYPES = ["pass", "run", "qb_kneel", "qb_spike"]
NEUTRAL_WP = (0.05, 0.95)

# Injury report and practice labels, from healthy to out.
REPORT_SEVERITY = {"Questionable": 1.0, "Doubtful": 2.0, "Out": 3.0}
PRACTICE_LIMITATION = {
    "Full Participation in Practice": 0.0,
    "Limited Participation in Practice": 1.0,
    "Did Not Participate In Practice": 2.0,
}
UNDRAFTED_ROUND = 8.0


class MappingError(ValueError):
    """A value has no entry in a table that must be complete."""


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one concept; keep only null."""
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def scrimmage(plays: DataFrame) -> DataFrame:
    return plays.where(
        F.col("posteam").isNotNull() & F.col("play_type").isin(SCRIMMAGE_TYPES)
    )


def attempts(plays: DataFrame) -> DataFrame:
    """Exact attempt definitions: conversions excluded, scrambles kept apart from designed runs."""
    counts = (zero("two_point_attempt") == 0).cast("double")
    att = plays.select(
        "*",
        ((zero("complete_pass") + zero("incomplete_pass") + zero("interception")) * counts).alias("off_pass_att"),
        (zero("rush_attempt") * counts).alias("off_rush_att"),
        zero("sack").alias("off_sack"),
        zero("qb_scramble").alias("off_scramble"),
    )
    passed, rushed = F.col("off_pass_att") > 0, F.col("off_rush_att") > 0
    sacked, scrambled = F.col("off_sack") > 0, F.col("off_scramble") > 0
    return att.select(
        "*",
        F.greatest(F.col("off_rush_att") - F.col("off_scramble"), F.lit(0.0)).alias("off_designed_rush"),
        (passed | sacked | scrambled).alias("is_dropback"),
        (passed | rushed | sacked).alias("is_scrimmage"),
        F.coalesce(F.col("wp").between(*NEUTRAL_WP), F.lit(False)).alias("neutral"),
    )


def zone_flags(df: DataFrame, column: str = "yardline_100", marks=((20, "rz"), (10, "i10"), (5, "i5"))) -> DataFrame:
    """1.0 inside each mark; an unknown position is outside."""
    return df.select(
        "*",
        *[F.coalesce((F.col(column) <= m).cast("double"), F.lit(0.0)).alias(n) for m, n in marks],
    )


def zero_fill(df: DataFrame, counts: list[str]) -> DataFrame:
    """Missing counts become 0; rates are left alone."""
    return df.fillna(0.0, subset=[c for c in counts if c in df.columns])


def injury_codes(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        lookup(F.col("report_status"), REPORT_SEVERITY, 0.0).alias("injury_severity"),
        lookup(F.col("practice_status"), PRACTICE_LIMITATION, 0.0).alias("practice_limitation"),
        F.col("report_status").isNotNull().cast("double").alias("on_injury_report"),
    )


def unmapped(df: DataFrame, column: str, table: dict) -> DataFrame:
    """Non-null values without an entry, with their counts."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(table)))
        .groupBy(column)
        .count()
    )


def strict_map(df: DataFrame, column: str, table: dict, out: str, default=None) -> DataFrame:
    """Map through a table that must cover every non-null value."""
    bad = [r[0] for r in unmapped(df, column, table).select(column).limit(20).collect()]
    if bad:
        raise MappingError(f"{column}: no code for {sorted(map(str, bad))}")
    return df.withColumn(out, lookup(F.col(column), table, default))


def rank_cap(df: DataFrame, column: str = "depth_rank", cap: int = 3) -> DataFrame:
    """Capped rank (null stays null) and a starter flag (null is not a starter)."""
    capped = F.when(F.col(column).isNotNull(), F.least(F.col(column), F.lit(float(cap))))
    return df.withColumn("depth_rank_capped", capped).withColumn(
        "is_starter", F.coalesce((capped == 1).cast("double"), F.lit(0.0))
    )


def bio(df: DataFrame, era="season", rookie="rookie_season", born="birth_date", day="gameday") -> DataFrame:
    exp = F.when(F.col(rookie).isNotNull(), F.greatest(F.col(era) - F.col(rookie), F.lit(0)))
    return df.select(
        *[c for c in df.columns if c != "draft_round"],
        exp.cast("double").alias("experience"),
        F.coalesce(F.col("draft_round").cast("double"), F.lit(UNDRAFTED_ROUND)).alias("draft_round"),
        (F.datediff(F.col(day), F.col(born)) / 365.25).alias("age"),
    )


def mask_when(df: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """Blank the listed columns where the condition holds (weather under a roof)."""
    hide = F.coalesce(condition, F.lit(False))
    return df.select(
        *[F.when(~hide, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def overlay(df: DataFrame, fixes: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Curated values win over the feed's; ``fields`` maps a column to its feed-side fallback."""
    fix = fixes.select(F.col(key), *[F.col(c).alias(f"__fix_{c}") for c in fields])
    joined = df.join(fix, key, "left")
    keep = [c for c in df.columns if c not in fields]
    return joined.select(
        *keys_first(keep, key),
        *[F.coalesce(F.col(f"__fix_{c}"), fb).alias(c) for c, fb in fields.items()],
    )


def keys_first(columns: list[str], key: str) -> list[str]:
    return [key, *[c for c in columns if c != key]]


def feed_roof(roof: Column) -> Column:
    """Per-game roof state to structure: open and closed both mean retractable."""
    return F.when(roof.isin("closed", "open"), "retractable").otherwise(
        F.nullif(F.nullif(roof, F.lit("")), F.lit("nan"))
    )


def field_corrections(df: DataFrame, fixes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Apply (key, field, value) corrections to any table; the newest entry per field wins."""
    one = fixes.groupBy(key).agg(
        *[
            F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"__fix_{f}")
            for f in fields
        ]
    )
    types = dict(df.dtypes)
    joined = df.join(one, key, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"__fix_{c}").cast(types[c]), F.col(c)).alias(c) if c in fields else F.col(c)
            for c in df.columns
        ]
    )


def eligible(df: DataFrame, target: str, cohort: str, cohorts: list[str]) -> DataFrame:
    return df.where(F.col(target).isNotNull() & F.col(cohort).isin(cohorts))


def enough_rows(df: DataFrame, minimum: int) -> bool:
    """Counts no further than the minimum."""
    return df.limit(minimum).count() >= minimum


def union_ragged(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def home_away_legs(games: DataFrame, home="home_team", away="away_team") -> DataFrame:
    """Two rows per game from a single scan."""
    legs = F.array(
        F.struct(F.col(home).alias("team"), F.col(away).alias("opponent_team"), F.lit(1).alias("is_home")),
        F.struct(F.col(away).alias("team"), F.col(home).alias("opponent_team"), F.lit(0).alias("is_home")),
    )
    return games.withColumn("__leg", F.explode(legs)).select("*", "__leg.*").drop("__leg")


def to_long(df: DataFrame, ids: list[str], measures: list[str], name="target", value="value") -> DataFrame:
    return df.unpivot(ids, measures, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, labels: list[str]) -> DataFrame:
    """Pivot with a stated label list, so no job is needed to discover it."""
    return df.groupBy(*ids).pivot(name, labels).agg(F.first(value, ignorenulls=True))


def explode_list(df: DataFrame, column: str, out: str, sep: str = ";") -> DataFrame:
    """One row per non-empty element of a delimited string."""
    parts = F.filter(F.split(F.col(column), sep), lambda p: F.length(p) > 0)
    return df.withColumn(out, F.explode(parts))
