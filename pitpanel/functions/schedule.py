"""Kickoff time, slate labels, market and venue expressions. Row-local, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EASTERN = "America/New_York"
LOCK_LEAD_MINUTES = 90

# Slate windows in the order a week unfolds; anything else sorts last.
WINDOW_ORDER = [
    "Wednesday",
    "Thursday night",
    "Friday",
    "Saturday",
    "Sunday morning",
    "Sunday early",
    "Sunday late",
    "Sunday night",
    "Monday night",
]


def local_kickoff(gameday: Column, gametime: Column) -> Column:
    """Wall-clock kickoff; a missing time counts as 13:00, an unreadable date gives null."""
    clock = F.coalesce(F.nullif(F.trim(gametime), F.lit("")), F.lit("13:00"))
    text = F.concat_ws(" ", gameday, clock)
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}$")
    return F.when(gameday.isNotNull() & shaped, text).try_cast("timestamp_ntz")


def kickoff_utc(gameday: Column, gametime: Column, zone: str = EASTERN, repeated: str = "first") -> Column:
    """Kickoff in UTC: the repeated autumn hour reads as daylight time (``repeated='second'``: as
    standard time, an hour later), the skipped spring hour moves to the first valid instant."""
    if repeated not in ("first", "second"):
        raise ValueError("repeated is 'first' or 'second'")
    local = local_kickoff(gameday, gametime)
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    if repeated == "second":
        later = utc + F.expr("INTERVAL 1 HOUR")
        utc = F.when(F.convert_timezone(F.lit("UTC"), F.lit(zone), later) == local, later).otherwise(utc)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.when(back == local, utc).otherwise(F.date_trunc("hour", utc).cast("timestamp_ntz"))


def lock_at(kickoff: Column) -> Column:
    return kickoff - F.expr(f"INTERVAL {LOCK_LEAD_MINUTES} MINUTES")


def window_label(local: Column) -> Column:
    day = F.date_format(local, "EEEE")
    hour = F.hour(local) + F.minute(local) / 60.0
    sunday = (
        F.when(hour < 12, "Sunday morning")
        .when(hour < 15.5, "Sunday early")
        .when(hour < 19, "Sunday late")
        .otherwise("Sunday night")
    )
    return (
        F.when(local.isNull(), "Time to be confirmed")
        .when(day.isin("Thursday", "Monday"), F.concat(day, F.lit(" night")))
        .when(day == "Sunday", sunday)
        .otherwise(day)
    )


def window_rank(label: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(w) for w in WINDOW_ORDER]), label)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(WINDOW_ORDER))).cast("bigint")


def game_status(home_score: Column, away_score: Column, kickoff: Column, now: Column) -> Column:
    """final once both scores exist, live once kickoff has passed, else upcoming."""
    return (
        F.when(home_score.isNotNull() & away_score.isNotNull(), "final")
        .when(kickoff <= now, "live")
        .otherwise("upcoming")
    )


def implied_totals(df: DataFrame, total: str = "total_line", spread: str = "spread_line") -> DataFrame:
    """Home total/2 + spread/2, away total/2 - spread/2; a missing line stays missing."""
    half_total, half_spread = F.col(total) / 2.0, F.col(spread) / 2.0
    return df.withColumn("home_implied_total", half_total + half_spread).withColumn(
        "away_implied_total", half_total - half_spread
    )


def perspective(df: DataFrame, is_home: Column, pairs: dict[str, tuple[str, str]], signed=()) -> DataFrame:
    """Turn home/away columns into own/rival ones.

    ``pairs`` maps an output to (value when home, value when away); ``signed`` maps
    (output, column) whose sign flips for the home side.
    """
    cols = [F.when(is_home, F.col(h)).otherwise(F.col(a)).alias(o) for o, (h, a) in pairs.items()]
    cols += [F.when(is_home, -F.col(c)).otherwise(F.col(c)).alias(o) for o, c in signed]
    return df.select("*", *cols)


def is_turf(surface: Column) -> Column:
    """1 unless the trimmed label says grass or says nothing."""
    label = F.lower(F.trim(F.coalesce(surface, F.lit(""))))
    return (~label.isin("grass", "nan", "none", "")).cast("double")


def is_primetime(weekday: Column) -> Column:
    return F.coalesce(weekday.isin("Thursday", "Monday"), F.lit(False)).cast("double")


# Metres above sea level of the venues where altitude matters.
ALTITUDE_M = {"DEN00": 1610.0, "MEX00": 2240.0}

# Structural roof codes.
ROOF_CODE = {"outdoors": 0.0, "retractable": 1.0, "dome": 2.0}


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small literal table, null (or the default) when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def rest_diff(own: Column, rival: Column) -> Column:
    return F.coalesce(own - rival, F.lit(0.0))
