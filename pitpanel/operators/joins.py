"""As-of, interval, bin, lagged and fallback joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitpanel.operators.aggregates import majority_label
from pitpanel.operators.ordered import Spec, fill, fill_both, lookup_join, prior
from pitpanel.session import materialise, small_side

MICROS_HOUR = 3_600_000_000


def micros(c: str | Column) -> Column:
    """Microseconds of a zone-free or zoned timestamp, as a double."""
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp")).cast("double")


def _stacked(left, right, by, left_on, right_on, left_kind, right_kind, tie):
    """Both sides in one frame: by, __at, __kind, __tie, and each side's row as a struct."""
    lrow = F.struct(*left.columns)
    rrow = F.struct(*right.columns)
    lt = left.select(
        *by, F.col(left_on).alias("__at"), F.lit(left_kind).alias("__kind"),
        F.lit(None).cast(dict(right.dtypes)[tie]).alias("__tie"),
        lrow.alias("__l"),
    )
    rt = right.select(
        *by, F.col(right_on).alias("__at"), F.lit(right_kind).alias("__kind"),
        F.col(tie).alias("__tie"), rrow.alias("__r"),
    ).where(F.col("__at").isNotNull())
    return lt.unionByName(rt, allowMissingColumns=True)


def _clock(df: DataFrame) -> Column:
    t = dict(df.dtypes)["__at"]
    return micros("__at") if t.startswith("timestamp") else F.col("__at").cast("double")


def asof(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    take: dict[str, str],
    tie: str,
    direction: str = "forward",
    strict: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Left rows plus ``take`` (right column -> output name) of the nearest right row.

    forward: earliest right row at or after the left one; backward: latest at or before;
    ``strict`` excludes equality. No match, or a null left stamp, leaves nulls. Both sides
    travel through one exchange on ``by``.
    """
    forward = direction == "forward"
    # Equal stamps: the row to be found must come after the asker when looking forward
    # inclusively, before it when looking backward inclusively.
    left_first = forward != strict
    both = _stacked(left, right, by, left_on, right_on, 0 if left_first else 1, 1 if left_first else 0, tie)
    found = fill(
        both, by, ["__at", "__kind", "__tie"], _clock(both), "__r", "__hit",
        "next" if forward else "last", hot_rows,
    )
    valid = F.col("__at").isNotNull()
    return found.where(F.col("__l").isNotNull()).select(
        "__l.*", *[F.when(valid, F.col("__hit")[c]).alias(o) for c, o in take.items()]
    )


def asof_nearest(
    left, right, by, left_on, right_on, take, tie, tolerance_micros, hot_rows=None
) -> DataFrame:
    """Nearest right row in either direction within the tolerance; the earlier one on a draw. Both sides cross one exchange, once."""
    slim = right.select(*by, tie, *[c for c in dict.fromkeys([right_on, *take]) if c not in (*by, tie)])
    # A right row of the same stamp stands before the asker: looking back finds it, and nothing ahead is nearer.
    both = _stacked(left, slim, by, left_on, right_on, 1, 0, tie)
    found = fill_both(both, by, ["__at", "__kind", "__tie"], _clock(both), "__r", "__back", "__ahead", hot_rows)
    sides = found.where(F.col("__l").isNotNull()).select("__l.*", "__back", "__ahead")
    at = micros(left_on)
    gap_b = at - micros(F.col("__back")[right_on])
    gap_f = micros(F.col("__ahead")[right_on]) - at
    use_back = F.coalesce(gap_b <= F.coalesce(gap_f, gap_b), F.lit(False))
    gap = F.when(use_back, gap_b).otherwise(gap_f)
    one = F.when(gap <= tolerance_micros, F.when(use_back, F.col("__back")).otherwise(F.col("__ahead")))
    return sides.select(*left.columns, *[one[c].alias(o) for c, o in take.items()])


def modal_period_within(
    lines: DataFrame, games: DataFrame, start: str, kick: str, period: str, out: str,
    half_width_micros: int = 6 * MICROS_HOUR, hot_rows: int | None = None,
) -> DataFrame:
    """Most common period among kickoffs strictly within the half width of each start.

    Ties give the smallest period, no kickoff gives null. Counts come from running totals of
    kickoffs per period read at both ends of the interval, so no (line, kickoff) pairs are
    formed; each distinct start is resolved once.
    """
    day = 24 * MICROS_HOUR
    # Counting, cutting, windows and carries each read the points again; what they are made of is written once.
    starts = materialise(lines.where(F.col(start).isNotNull()).select(micros(start).alias("__s")).distinct(), "starts")
    kicks = materialise(games.where(F.col(kick).isNotNull()).groupBy(period, micros(kick).alias("__k")).agg(
        F.count(F.lit(1)).cast("double").alias("__n")
    ), "kicks")
    # A period that recurs is near a start only around its own kickoffs: candidates are found by equality on the days
    # that a kickoff's interval touches, so a start meets the periods of its days, however many eras use their names.
    by_day = kicks.groupBy(period, F.floor(F.col("__k") / day).alias("__d")).agg((F.min("__k") - half_width_micros).alias("__a"), (F.max("__k") + half_width_micros).alias("__b"))
    touched = by_day.withColumn("__day", F.explode(F.sequence(F.floor(F.col("__a") / day), F.floor(F.col("__b") / day))))
    days = touched.groupBy(period, "__day").agg(F.min("__a").alias("__from"), F.max("__b").alias("__to"))
    cand = (
        starts.withColumn("__day", F.floor(F.col("__s") / day))
        .join(small_side(days), "__day")
        .where((F.col("__s") > F.col("__from")) & (F.col("__s") < F.col("__to")))
        .select(period, "__s")
    )
    probe = cand.select(
        period, "__s",
        F.explode(
            F.array(
                F.struct((F.col("__s") + half_width_micros).alias("at"), F.lit(0).alias("kind"), F.lit(1.0).alias("sign")),
                F.struct((F.col("__s") - half_width_micros).alias("at"), F.lit(2).alias("kind"), F.lit(-1.0).alias("sign")),
            )
        ).alias("p"),
    ).select(period, "__s", "p.*", F.lit(0.0).alias("__n"))
    points = probe.unionByName(
        kicks.select(
            period, F.lit(None).cast("double").alias("__s"), F.col("__k").alias("at"), F.lit(1).alias("kind"),
            F.lit(0.0).alias("sign"), "__n",
        )
    )
    run = prior(points, [period], ["at", "kind", "__s"], F.col("at"), [Spec("__below", "sum", "__n")], hot_rows)
    counted = (
        run.where(F.col("__s").isNotNull())
        .groupBy("__s", period)
        .agg(F.sum(F.col("sign") * F.col("__below")).alias("__c"))
        .where(F.col("__c") > 0)
    )
    best = counted.groupBy("__s").agg(F.min_by(period, F.struct(-F.col("__c"), F.col(period))).alias(out))
    keyed = lines.withColumn("__s", micros(start))
    return lookup_join(keyed, best, ["__s"], "left", hot_rows).drop("__s")


def hourly_window(
    games: DataFrame, hours: DataFrame, venue: str, kick: str, hour: str, span: int,
    first: dict[str, str], peak: dict[str, str], summed: dict[str, str],
) -> DataFrame:
    """Aggregate hourly readings over [floor(kick), +span hours); a game needs its first hour.

    Each game asks for ``span`` hours by equality on (venue, hour).
    """
    asked = games.withColumn("__off", F.explode(F.sequence(F.lit(0), F.lit(span - 1)))).withColumn(
        hour, F.date_trunc("hour", F.col(kick)).cast("timestamp_ntz") + F.make_interval(hours=F.col("__off"))
    )
    j = asked.join(hours, [venue, hour])
    start = F.col("__off") == 0
    out = j.groupBy(*games.columns).agg(
        F.max(start).alias("__started"),
        *[F.max(F.when(start, F.col(c))).alias(o) for o, c in first.items()],
        *[F.max(c).alias(o) for o, c in peak.items()],
        *[F.sum(c).alias(o) for o, c in summed.items()],
    )
    return out.where("__started").drop("__started")


def lagged_era(facts: DataFrame, table: DataFrame, era: str, on: dict[str, str], columns: list[str], prefix="f_", lag=1) -> DataFrame:
    """Attach a reference table so a row sees only the values of ``lag`` eras ago.

    ``on`` maps a fact column to the table's key column.
    """
    keys = list(on)
    shifted = table.select(
        (F.col(era) + lag).alias(era), *[F.col(v).alias(k) for k, v in on.items()],
        *[F.col(c).alias(prefix + c) for c in columns],
    )
    return facts.join(small_side(shifted), [era, *keys], "left")


def latest_prior_era(facts: DataFrame, table: DataFrame, era: str, value: str, out: str) -> DataFrame:
    """Value of the most recent era strictly before the row's, even across missing eras.

    Resolved once per distinct era, then attached by equality.
    """
    one = F.lit(0).alias("__one")
    eras = facts.select(era, one).distinct()
    league = table.where(F.col(value).isNotNull()).select(F.col(era).alias("__era"), value, one)
    got = asof(eras, league, ["__one"], era, "__era", {value: out}, "__era", "backward", strict=True)
    return facts.join(small_side(got.drop("__one")), era, "left")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__b"))
    return best.select(key, "__b.*")


def id_then_name(left: DataFrame, right: DataFrame, id_col: str, name_col: str, order: list[str], take: list[str], hot_rows=None) -> DataFrame:
    """Match by id; rows whose id is missing or unknown match by name. First right row wins."""
    by_id = first_per_key(right.where(F.col(id_col).isNotNull()), id_col, order).select(
        id_col, F.struct(*take).alias("__i")
    )
    by_name = first_per_key(right, name_col, order).select(name_col, F.struct(*take).alias("__n"))
    # Hot keys are counted on the left rows themselves: a join to at most one row per key leaves the counts as they are.
    j = lookup_join(left, by_id, [id_col], "left", hot_rows)
    j = lookup_join(j, by_name, [name_col], "left", hot_rows, probe=left)
    hit = F.coalesce("__i", "__n")
    return j.select(*left.columns, *[hit[c].alias(c) for c in take], hit.isNotNull().alias("matched"))


def packed_bins(bins: DataFrame, target: str, lo: str, hi: str, payload: list[str]) -> DataFrame:
    """One row per target with its bins as an array sorted by lower edge (bins are few per target)."""
    return bins.groupBy(target).agg(
        F.array_sort(F.collect_list(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), *payload))).alias("__bins")
    )


def bin_lookup(df: DataFrame, bins: DataFrame, target: str, x: str, payload: list[str], lo="lo", hi="hi", few=False) -> DataFrame:
    """Bin with lo <= x <= hi, the lowest on a shared edge; below all the lowest, above the highest.

    ``few``: the targets are a bounded list, so their bins are broadcast and rows are not gathered by target.
    """
    packed = packed_bins(bins, target, lo, hi, payload)
    joined = df.join(F.broadcast(packed) if few else small_side(packed), target, "left")
    hit = f"""coalesce(
        try_element_at(filter(__bins, b -> b.lo <= {x} AND {x} <= b.hi), 1),
        CASE WHEN {x} < element_at(__bins, 1).lo THEN element_at(__bins, 1)
             WHEN {x} IS NOT NULL THEN array_max(transform(__bins,
                  b -> struct(b.hi AS hi, b AS bin))).bin END)"""
    return joined.withColumn("__hit", F.expr(hit)).select(
        *df.columns, *[F.col("__hit")[c].alias(c) for c in payload]
    )


def grid_lookup(df: DataFrame, grid: DataFrame, keys: list[str], columns: list[str], default: float) -> DataFrame:
    """Attach grid cells with a default for absent ones."""
    j = df.join(small_side(grid.select(*keys, *columns)), keys, "left")
    return j.select(*df.columns, *[F.coalesce(c, F.lit(default)).alias(c) for c in columns])


def majority_or_own(df: DataFrame, history: DataFrame, key: str, label: str, keep: str) -> DataFrame:
    """Replace a label by the one its key carried most often before; the original is kept aside."""
    modal = majority_label(history.where(F.col(key).isNotNull()), [key], label, "__modal")
    j = df.withColumn(keep, F.col(label)).join(modal, key, "left")
    return j.withColumn(label, F.coalesce("__modal", label)).drop("__modal")


def resolve_event(asked: DataFrame, games: DataFrame, canon, event="game_id") -> DataFrame:
    """Match (away, home) through canonical codes, else the reversed pair."""
    a = asked.withColumn("__a", canon(F.col("away"))).withColumn("__h", canon(F.col("home")))
    g = games.select(
        event, canon(F.col("away_team")).alias("__a"), canon(F.col("home_team")).alias("__h")
    ).groupBy("__a", "__h").agg(F.min(event).alias(event))
    rev = g.select(F.col("__h").alias("__a"), F.col("__a").alias("__h"), F.col(event).alias("__rev"))
    j = a.join(g, ["__a", "__h"], "left").join(rev, ["__a", "__h"], "left")
    return j.select(*asked.columns, F.coalesce(event, "__rev").alias(event))


def future_rows(games: DataFrame, roster: DataFrame, own: list[str]) -> DataFrame:
    """Rows that do not exist yet: both sides of each scheduled event x the side's latest roster."""
    from pitpanel.operators.shape import home_away_legs

    return home_away_legs(games).join(roster, own)
