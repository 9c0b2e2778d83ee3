"""Ordered computations per key that stay parallel when one key holds most of the rows.

A window over PARTITION BY key puts a whole key in one task. Here a key with more rows than
``hot_rows`` is cut into consecutive runs along a numeric clock. Windows run inside
(key, run); a carry table, one row per run of a hot key, brings in what earlier runs
contribute and is joined back. The list of hot keys is a table in the shared folder, however
long it is; up to BROADCAST_KEYS keys it is broadcast, beyond that joined like any other table.
A key of more than FANOUT runs is cut in levels; a level's cuts are broadcast up to BROADCAST_CUTS values.
With no hot key the plan is the plain window: one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitpanel.session import input_bytes, materialise, small_side

RUN = "__run"
CLOCK = "__clock"
HOT_ROWS_CONF = "spark.pitpanel.hotRows"
DEFAULT_HOT_ROWS = 4_000_000
BROADCAST_KEYS = 4096
BROADCAST_CUTS = 1 << 22
FANOUT = 256


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, so later filters and projections read the values
    instead of being rewritten into copies of long expressions."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def hot_limit(df: DataFrame, hot_rows: int | None) -> int:
    return hot_rows or int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def surely_small(df: DataFrame, rows: int) -> bool:
    """True when all files behind the frame together hold fewer than 8 bytes per allowed row."""
    return input_bytes(df) < rows * 8


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None):
    """Keys above the row limit as a table (keys, __n) and its row count; or None.

    One light job: per-key counts, combined map-side, over the key columns only. Skipped when
    the input files are too small to hold a hot key.
    """
    limit = hot_limit(df, hot_rows)
    if surely_small(df, limit):
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = materialise(counts.where(F.col("__n") > limit), "hot")
    n = hot.count()
    return (hot, n) if n else None


def sized(side: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a counted table of few rows; longer ones are joined by shuffle."""
    return F.broadcast(side) if rows <= BROADCAST_KEYS else side


def find_hot(
    df: DataFrame, keys: list[str], clock: Column, hot_rows: int | None = None
) -> tuple[list[tuple[DataFrame, int]], int] | None:
    """Hot keys with the clock values at which to cut them, level by level, and their number; None if there are none.

    A key of many runs is cut into at most FANOUT pieces, each piece that is still too large into as many again, and so on. A row
    looks its run up in a few short lists, however many runs its key has, and neither a list nor a summary grows with the key.
    """
    found = hot_keys(df, keys, hot_rows)
    if found is None:
        return None
    hot, n = found
    limit = hot_limit(df, hot_rows)
    # The largest key decides how many levels there are, and how wide they are.
    grid = max(2, -(-hot.agg(F.max("__n")).first()[0] // limit))
    depth, fan = 1, 2
    while FANOUT**depth < grid:
        depth += 1
    while fan**depth < grid:
        fan += 1
    side = sized(hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys]), n)
    rows = df.select(*keys, clock.cast("double").alias(CLOCK), F.lit(0).cast("long").alias(RUN)).join(side, _same(keys), "left_semi")
    if depth > 1:
        rows = materialise(rows, "hot-rows")
    fine = 4 * fan
    probs = [i / fine for i in range(1, fine)]
    levels = []
    for level in range(depth):
        pieces = rows.groupBy(*keys, RUN).agg(
            F.count(F.lit(1)).alias("__n"), F.percentile_approx(CLOCK, probs, max(10_000, 10 * fine)).alias("__p")
        ).where(F.col("__n") > limit)
        cuts = pieces.withColumn("__runs", F.least(F.lit(fan), F.ceil(F.col("__n") / F.lit(limit))).cast("int")).select(
            *[F.col(k).alias(f"__h_{k}") for k in [*keys, RUN]],
            F.expr(f"array_distinct(transform(sequence(1, __runs - 1), i -> element_at(__p, CAST(floor(i * {fine} / __runs) AS INT))))").alias("__cuts"),
        )
        cuts = materialise(cuts, "cuts")
        total = n if level == 0 else cuts.agg(F.coalesce(F.sum(F.size("__cuts")), F.lit(0))).first()[0]
        if not total:
            break
        few = n <= BROADCAST_KEYS if level == 0 else total <= BROADCAST_CUTS
        levels.append((F.broadcast(cuts) if few else cuts, fan))
        if level + 1 < depth:
            rows = _one_level(rows, keys, *levels[-1]).drop("__cuts")
    return levels, n


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
    return cond


def _one_level(rows: DataFrame, keys: list[str], cuts: DataFrame, fan: int) -> DataFrame:
    """RUN refined by one level: the number of cuts below the clock, found by halving; ``__cuts`` stays for the caller."""
    joined = rows.join(cuts, _same([*keys, RUN]), "left").drop(*[f"__h_{k}" for k in [*keys, RUN]])
    steps = ", ".join(str(1 << i) for i in reversed(range(fan.bit_length())))
    below = f"aggregate(array({steps}), 0, (p, s) -> IF(try_element_at(__cuts, p + s) < {CLOCK}, p + s, p))"
    return joined.withColumn(RUN, F.expr(f"{RUN} * {fan} + IF(__cuts IS NULL OR {CLOCK} IS NULL, 0, {below})"))


def assign_runs(df: DataFrame, keys: list[str], clock: Column, found: tuple[list[tuple[DataFrame, int]], int]) -> DataFrame:
    """Add RUN: 0 for cold keys, for hot ones a number that grows with the clock.

    Equal clocks share a run, so run order agrees with any order that starts with the clock.
    """
    tagged = df.withColumns({CLOCK: clock.cast("double"), RUN: F.lit(0).cast("long")})
    for level, (cuts, fan) in enumerate(found[0]):
        tagged = _one_level(tagged, keys, cuts, fan)
        if level == 0:
            tagged = tagged.withColumn("__is_hot", F.col("__cuts").isNotNull())
        tagged = tagged.drop("__cuts")
    return tagged.drop(CLOCK)


@dataclass(frozen=True)
class Spec:
    """One prior window.

    kind: count, sum (null counts as 0), mean (null counts as 0), mean_present (nulls skipped),
    rolling (mean of the last ``width`` prior rows, null counts as 0).
    within: extra partition columns, such as the era.
    """

    name: str
    kind: str
    column: str | None = None
    width: int = 0
    within: tuple[str, ...] = ()


def prior(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    clock: Column,
    specs: list[Spec],
    hot_rows: int | None = None,
) -> DataFrame:
    """Add every spec, computed from rows strictly before the current one."""
    hot = find_hot(df, keys, clock, hot_rows)
    if hot is None:
        return _in_one_pass(df, keys, order, specs)
    return _prior_in_runs(df, keys, order, clock, specs, hot)


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def _windows(s: Spec, keys: list[str], order: list[str], extra: list[str]):
    # Inside an era the era orders nothing; without it every window of a key is served by one sort.
    base = Window.partitionBy(*keys, *s.within, *extra).orderBy(*[o for o in order if o not in s.within] or order)
    return base.rowsBetween(Window.unboundedPreceding, -1), (
        base.rowsBetween(-s.width, -1) if s.width else None
    )


def _in_one_pass(df: DataFrame, keys: list[str], order: list[str], specs: list[Spec]) -> DataFrame:
    """All specs from their distinct counts and sums: a column's total is summed once, the rows of a frame are counted once."""
    parts, names = {}, {}

    def part(key, value: Column) -> Column:
        if key not in parts:
            names[key] = f"__w{len(parts)}"
            parts[key] = value.alias(names[key])
        return F.col(names[key])

    out = []
    for s in specs:
        before, last = _windows(s, keys, order, [])
        if s.kind == "mean_present":
            out.append(part((s.kind, s.column, s.within), F.avg(F.col(s.column).cast("double")).over(before)).alias(s.name))
            continue
        if s.kind not in ("count", "sum", "mean", "rolling"):
            raise ValueError(f"unknown window kind {s.kind!r}")
        total = None
        if s.kind == "rolling":
            total = part((s.kind, s.column, s.width, s.within), F.sum(_value(s.column)).over(last))
        elif s.kind != "count":
            total = part(("sum", s.column, s.within), F.sum(_value(s.column)).over(before))
        if s.kind == "sum":
            out.append(F.coalesce(total, F.lit(0.0)).alias(s.name))
            continue
        n = part(("count", s.within), F.count(F.lit(1)).over(before))
        if s.kind == "rolling":
            n = F.least(n, F.lit(s.width).cast("long"))
        out.append((n if total is None else total / F.nullif(n, F.lit(0))).alias(s.name))
    return df.select("*", *parts.values()).select(*df.columns, *out)


def _prior_in_runs(df, keys, order, clock, specs, hot) -> DataFrame:
    tagged = assign_runs(df, keys, clock, hot)
    local, partial = [], {}
    for i, s in enumerate(specs):
        before, last = _windows(s, keys, order, [RUN])
        names = partial[s.name] = (f"__a{i}", f"__b{i}")
        if s.kind == "rolling":
            local += [
                F.coalesce(F.sum(_value(s.column)).over(last), F.lit(0.0)).alias(names[0]),
                F.count(F.lit(1)).over(last).alias(names[1]),
            ]
        elif s.kind == "count":
            local.append(F.count(F.lit(1)).over(before).alias(names[1]))
        else:
            counted = F.col(s.column) if s.kind == "mean_present" else F.lit(1)
            local += [
                F.coalesce(F.sum(_value(s.column)).over(before), F.lit(0.0)).alias(names[0]),
                F.count(counted).over(before).alias(names[1]),
            ]
    out = tagged.select("*", *local)
    for within in sorted({s.within for s in specs}):
        mine = [s for s in specs if s.within == within]
        side, by = _carry(tagged.where("__is_hot"), keys, order, within, mine, partial)
        out = out.join(side, _match(by, out), "left").drop(*[f"__c_{k}" for k in by])
    final = [_combine(s, *partial[s.name]).alias(s.name) for s in specs]
    return out.select(*df.columns, *final)


def _match(by: list[str], left: DataFrame) -> Column:
    cond = F.lit(True)
    for k in by:
        cond = cond & left[k].eqNullSafe(F.col(f"__c_{k}"))
    return cond


def _carry(hot_rows_df, keys, order, within, specs, partial):
    """Per run of a hot key: totals over all earlier runs, and the last rows before the run."""
    by = [*keys, *within]
    aggs, seen = [], set()
    for s in specs:
        a, b = partial[s.name]
        if s.kind != "rolling":
            if s.column:
                aggs.append(F.sum(_value(s.column)).alias(f"__s{a}"))
            counted = F.col(s.column) if s.kind == "mean_present" else F.lit(1)
            aggs.append(F.count(counted).alias(f"__n{b}"))
        seen.add(s.name)
    totals = hot_rows_df.groupBy(*by, RUN).agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    across = Window.partitionBy(*by).orderBy(RUN)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    cols = []
    for s in specs:
        a, b = partial[s.name]
        if s.kind != "rolling":
            if s.column:
                cols.append(F.sum(f"__s{a}").over(before).alias(f"__c{a}"))
            cols.append(F.sum(f"__n{b}").over(before).alias(f"__c{b}"))
    rolling = [s for s in specs if s.kind == "rolling"]
    base = totals
    if rolling:
        width = max(s.width for s in rolling)
        columns = sorted({s.column for s in rolling})
        newest = Window.partitionBy(*by, RUN).orderBy(*[F.col(o).desc() for o in order])
        tail = (
            hot_rows_df.withColumn("__rn", F.row_number().over(newest))
            .where(F.col("__rn") <= width)
            .groupBy(*by, RUN)
            .agg(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            (-F.col("__rn")).alias("pos"),
                            *[_value(c).alias(f"v{j}") for j, c in enumerate(columns)],
                        )
                    )
                ).alias("__tail")
            )
        )
        tail = tail.select(
            *[F.col(k).alias(f"__t_{k}") for k in [*by, RUN]], "__tail"
        )
        cond = F.lit(True)
        for k in [*by, RUN]:
            cond = cond & totals[k].eqNullSafe(F.col(f"__t_{k}"))
        base = totals.join(tail, cond, "left").drop(*[f"__t_{k}" for k in [*by, RUN]])
        # Each earlier run holds at least one row, so `width` runs are enough.
        recent = across.rowsBetween(-width, -1)
        cols.append(F.flatten(F.collect_list("__tail").over(recent)).alias("__recent"))
        side = base.select(*by, RUN, *cols)
        for s in rolling:
            a, _ = partial[s.name]
            j = columns.index(s.column)
            side = side.withColumn(f"__c{a}", F.expr(f"transform(__recent, r -> r.v{j})"))
        side = side.drop("__recent")
    else:
        side = base.select(*by, RUN, *cols)
    match = [*by, RUN]
    return side.select(
        *[F.col(k).alias(f"__c_{k}") for k in match],
        *[c for c in side.columns if c not in match],
    ), match


def _combine(s: Spec, a: str, b: str) -> Column:
    if s.kind == "rolling":
        tail = f"coalesce(__c{a}, array())"
        need = f"least(CAST({s.width} - {b} AS INT), size({tail}))"
        taken = (
            f"CASE WHEN {need} <= 0 THEN array() ELSE slice({tail}, size({tail}) - {need} + 1, {need}) END"
        )
        total = f"({a} + aggregate({taken}, CAST(0 AS DOUBLE), (x, y) -> x + y))"
        return F.expr(f"{total} / nullif({b} + greatest({need}, 0), 0)")
    n = F.col(b) + F.coalesce(F.col(f"__c{b}"), F.lit(0))
    if s.kind == "count":
        return n
    total = F.col(a) + F.coalesce(F.col(f"__c{a}"), F.lit(0.0))
    if s.kind == "sum":
        return total
    return total / F.nullif(n, F.lit(0))


def fill(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    clock: Column,
    value: str,
    out: str,
    direction: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Nearest non-null ``value`` at or after (``next``) or at or before (``last``) each row.

    ``order`` is ascending and its first column must agree with ``clock``. Looking forward is
    done by looking back over the reversed order, so every frame grows by one row at a time.
    """
    if direction not in ("next", "last"):
        raise ValueError("direction is 'next' or 'last'")
    forward = direction == "next"
    towards = [F.col(c).desc() if forward else F.col(c).asc() for c in order]

    def near(extra):
        w = Window.partitionBy(*keys, *extra).orderBy(*towards)
        seen = w.rowsBetween(Window.unboundedPreceding, 0)
        return F.last(F.col(value), ignorenulls=True).over(seen)

    hot = find_hot(df, keys, clock, hot_rows)
    if hot is None:
        return df.withColumn(out, near([]))
    tagged = assign_runs(df, keys, clock, hot)
    ends = F.min_by if forward else F.max_by
    runs = (
        tagged.where("__is_hot")
        .groupBy(*keys, RUN)
        .agg(
            ends(
                F.col(value),
                F.when(F.col(value).isNotNull(), F.struct(*order)),
            ).alias("__edge")
        )
    )
    step = F.col(RUN).desc() if forward else F.col(RUN).asc()
    across = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    side = runs.select(
        *[F.col(k).alias(f"__c_{k}") for k in [*keys, RUN]],
        F.last(F.col("__edge"), ignorenulls=True).over(across).alias("__beyond"),
    )
    local = tagged.withColumn("__near", near([RUN]))
    joined = local.join(side, _match([*keys, RUN], local), "left")
    return joined.select(
        *df.columns, F.coalesce(F.col("__near"), F.col("__beyond")).alias(out)
    )


def fill_both(df: DataFrame, keys: list[str], order: list[str], clock: Column, value: str, last: str, next_: str, hot_rows: int | None = None) -> DataFrame:
    """The nearest non-null ``value`` at or before each row and at or after it: ``fill`` in both directions at once.

    One exchange serves both: inside a task the rows are sorted once for each direction, and the carries of cut keys are joined together.
    """
    up, down = [F.col(c).asc() for c in order], [F.col(c).desc() for c in order]

    def near(extra, towards):
        w = Window.partitionBy(*keys, *extra).orderBy(*towards)
        return F.last(F.col(value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    hot = find_hot(df, keys, clock, hot_rows)
    if hot is None:
        return df.withColumns({last: near([], up), next_: near([], down)})
    tagged = assign_runs(df, keys, clock, hot)
    there = F.when(F.col(value).isNotNull(), F.struct(*order))
    runs = tagged.where("__is_hot").groupBy(*keys, RUN).agg(F.max_by(F.col(value), there).alias("__end"), F.min_by(F.col(value), there).alias("__begin"))

    def beyond(edge, step):
        w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(F.col(edge), ignorenulls=True).over(w)

    side = runs.select(
        *[F.col(k).alias(f"__c_{k}") for k in [*keys, RUN]],
        beyond("__end", F.col(RUN).asc()).alias("__before"), beyond("__begin", F.col(RUN).desc()).alias("__after"),
    )
    local = tagged.withColumns({"__last": near([RUN], up), "__next": near([RUN], down)})
    joined = local.join(side, _match([*keys, RUN], local), "left")
    return joined.select(*df.columns, F.coalesce("__last", "__before").alias(last), F.coalesce("__next", "__after").alias(next_))


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    clock: Column,
    out: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Row number per key, from 1, split into runs when a key is hot."""
    counted = prior(df, keys, order, clock, [Spec("__before", "count")], hot_rows)
    return counted.withColumn(out, F.col("__before") + 1).drop("__before")


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    out: str = "quantiles",
    hot_rows: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key: keys, n, out array.

    Small keys use the built-in percentile. When a key is hot its values are counted per
    distinct value first, the counts are accumulated in runs, and only the values that sit on
    a wanted rank leave their task.
    """
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    if not keys:
        data, keys, dummy = data.withColumn("__all", F.lit(1)), ["__all"], True
    else:
        dummy = False
    if hot_keys(data, keys, hot_rows) is None:
        res = data.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.percentile("__v", F.array(*[F.lit(p) for p in probs])).alias(out)
        )
        return res.drop("__all") if dummy else res
    counts = data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).cast("double").alias("__m"))
    res = quantiles_of_counts(counts, keys, probs, out, hot_rows)
    return res.drop("__all") if dummy else res


def quantiles_of_counts(counts: DataFrame, keys: list[str], probs: list[float], out: str = "quantiles", hot_rows: int | None = None) -> DataFrame:
    """``quantiles`` from counted values: keys, __v (distinct values, not null) and __m (how often, as a double).

    Only the values that sit on a wanted rank leave their task.
    """
    cum = prior(counts, keys, ["__v"], F.col("__v"), [Spec("__lo", "sum", "__m")], hot_rows)
    totals = counts.groupBy(*keys).agg(F.sum("__m").cast("long").alias("n"))
    grid = "array(" + ", ".join(f"CAST({p!r} AS DOUBLE)" for p in probs) + ")"
    # Most values are single and on no wanted rank; a look into the key's list of ranks spares them the walk over all of probs.
    ranks = F.expr(f"flatten(transform({grid}, p -> array(floor((n - 1) * p), floor((n - 1) * p) + 1)))").alias("__ranks")
    near = cum.join(small_side(totals.select("*", ranks)), keys).where("__m > 1 OR array_contains(__ranks, CAST(__lo AS BIGINT))").drop("__ranks")
    want = near.withColumn(
        "__hits",
        F.expr(
            f"flatten(transform({grid}, (p, i) -> filter(array("
            "named_struct('i', i, 'side', 0, 'rank', floor((n - 1) * p), 'w', 1 - ((n - 1) * p - floor((n - 1) * p))), "
            "named_struct('i', i, 'side', 1, 'rank', floor((n - 1) * p) + 1, 'w', (n - 1) * p - floor((n - 1) * p))), "
            "h -> h.w > 0 AND h.rank >= __lo AND h.rank < __lo + __m)))"
        ),
    )
    hits = want.where(F.size("__hits") > 0).select(*keys, "n", "__v", F.explode("__hits").alias("h"))
    # Between two equal values there is nothing to weigh, and no rounding either.
    low, high = F.min("__v"), F.max("__v")
    step = F.coalesce(F.max(F.when(F.col("h.side") == 1, F.col("h.w"))), F.lit(0.0))
    points = hits.groupBy(*keys, "n", F.col("h.i").alias("i")).agg(F.when(low == high, low).otherwise(low + (high - low) * step).alias("q"))
    return points.groupBy(*keys, "n").agg(
        F.expr("transform(array_sort(collect_list(struct(i, q))), s -> s.q)").alias(out)
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    hot_rows: int | None = None,
    salts: int = 64,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Join to a side with at most one row per key; hot left keys and null keys are salted.

    The salt is a hash of the whole left row, so a retried task repeats it. Only the right
    rows of hot keys are copied, ``salts`` times each. ``probe``: a leaner frame with the same
    key values, for counting.
    """
    found = hot_keys(left if probe is None else probe, keys, hot_rows)
    if found is None:
        return left.join(right, keys, how)
    hot = sized(found[0].select(*keys, F.lit(True).alias("__hot")), found[1])
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    # A null key matches nothing, so its rows may go to any partition.
    salted = left.join(hot, keys, "left").withColumn(
        "__salt",
        F.when(F.col("__hot") | missing, F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)),
    )
    copies = right.join(hot, keys, "left").withColumn(
        "__salt",
        F.explode(
            F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return (
        salted.drop("__hot")
        .withColumn("__salt", F.col("__salt").cast("int"))
        .join(copies.drop("__hot"), [*keys, "__salt"], how)
        .drop("__salt")
    )
