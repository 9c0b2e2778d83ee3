"""Data quality, reconciliation and coherence checks. Each returns rows: check, ok, detail columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitpanel.operators.aggregates import ratio

TOTAL_TOLERANCE = 0.20
CONCENTRATION_TOLERANCE = 0.25
APPEARANCE_BAND = (10.0, 14.0)

# Concentration of a right conditional mean over the realised one.
ORACLE_TOP_SHARE = {"carries": 0.528 / 0.577, "targets": 0.228 / 0.296}


class CheckFailed(ValueError):
    """A hard check did not hold."""


def require(checks: DataFrame) -> DataFrame:
    """Raise with the number of failing checks and the distinct names of a few of them."""
    failed = checks.where("NOT ok")
    n = failed.count()
    if n:
        names = sorted(str(r["check"]) for r in failed.select("check").distinct().limit(50).collect())
        raise CheckFailed(f"{n} check(s) failed, among them: {names}")
    return checks


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return duplicates(df, keys).agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check"), (F.col("violations") == 0).alias("ok"), "violations"
    )


def row_count(df: DataFrame, expected: DataFrame, factor: int, name: str) -> DataFrame:
    """Rows against factor times the expected frame's rows, in one pass over both."""
    both = df.select(F.lit(1).alias("got"), F.lit(0).alias("want")).unionByName(
        expected.select(F.lit(0).alias("got"), F.lit(factor).alias("want"))
    )
    return both.agg(F.sum("got").alias("rows"), F.sum("want").alias("expected")).select(
        F.lit(name).alias("check"), (F.col("rows") == F.col("expected")).alias("ok"), "rows", "expected"
    )


def orphans(df: DataFrame, parent: DataFrame, keys: list[str], name: str) -> DataFrame:
    lost = df.join(parent.select(*keys).distinct(), keys, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check"), (F.col("violations") == 0).alias("ok"), "violations"
    )


def reconciled(report: DataFrame, min_rates: dict[str, float]) -> DataFrame:
    """Reconciliation rows (check, equal, joined, worst) against their pass-rate thresholds."""
    limit = F.lit(1.0)
    for check, rate in min_rates.items():
        limit = F.when(F.col("check") == check, F.lit(rate)).otherwise(limit)
    rate = ratio(F.col("equal"), F.col("joined"))
    return report.select("check", F.coalesce(rate >= limit, F.lit(False)).alias("ok"), rate.alias("rate"), "worst")


def bounds(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of each rule (a condition that must hold), counted in one aggregate."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(f"v{i}") for i, c in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(rules)])
    return one.select(F.explode(rows).alias("r")).select(
        "r.check", (F.col("r.violations") == 0).alias("ok"), "r.violations"
    )


def count_rules(counts: list[str], parts: list[tuple[str, str]]) -> dict[str, Column]:
    """Non-negative counts, and part <= whole with missing read as 0."""
    rules = {f"{c} >= 0": F.col(c) >= 0 for c in counts}
    for part, whole in parts:
        rules[f"{part} <= {whole}"] = F.coalesce(F.col(part), F.lit(0.0)) <= F.coalesce(F.col(whole), F.lit(0.0))
    return rules


def varies(df: DataFrame, columns: list[str], by: list[str], max_null: float = 0.05) -> DataFrame:
    """Columns that are constant or mostly missing within a group betray a broken join."""
    one = df.groupBy(*by).agg(
        *[F.min(c).cast("string").alias(f"lo_{c}") for c in columns],
        *[F.max(c).cast("string").alias(f"hi_{c}") for c in columns],
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in columns],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.coalesce(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(False)).alias("varies"),
                F.col(f"null_{c}").alias("null_share"),
            )
            for c in columns
        ]
    )
    return one.select(*by, F.explode(rows).alias("r")).select(
        *by, "r.*", (F.col("r.varies") & (F.col("r.null_share") <= max_null)).alias("ok")
    )


def map_coverage(df: DataFrame, key: str, table: dict, value: str) -> DataFrame:
    """Rows that should carry a mapped value against rows that do."""
    return df.agg(
        F.count_if(F.col(key).isin(list(table))).alias("expected"), F.count_if(F.col(value) > 0).alias("got")
    ).select(F.lit(f"{value} from {key}").alias("check"), (F.col("expected") == F.col("got")).alias("ok"), "expected", "got")


def missingness_leak(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """P(null) when the target is 0 and when it is positive; a large gap is a leak."""
    none, some = F.col(target) == 0, F.col(target) > 0
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"z{i}").alias("null_if_zero"), F.col(f"p{i}").alias("null_if_positive")) for i, c in enumerate(columns)]
    )
    one = df.agg(
        *[F.avg(F.when(none, F.col(c).isNull().cast("double"))).alias(f"z{i}") for i, c in enumerate(columns)],
        *[F.avg(F.when(some, F.col(c).isNull().cast("double"))).alias(f"p{i}") for i, c in enumerate(columns)],
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def self_correlation(df: DataFrame, target: str, features: list[str], limit: float = 0.80) -> DataFrame:
    """Correlation of each feature with its own row's target."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"c{i}") for i, c in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("corr")) for i, c in enumerate(features)])
    return one.select(F.explode(rows).alias("r")).select("r.*", F.coalesce(F.abs("r.corr") < limit, F.lit(True)).alias("ok"))


def schema_gap(spark, history_columns: list[str], serving_columns: list[str]) -> DataFrame:
    """Columns present in history and absent when serving."""
    h = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in history_columns])).alias("column"))
    s = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in serving_columns])).alias("column"))
    return h.exceptAll(s)


def coherence(totals: DataFrame, measure: str) -> DataFrame:
    """Expected over actual within the band; totals: expected, actual."""
    r = ratio(F.sum("expected"), F.sum("actual"))
    return totals.agg(r.alias("ratio")).select(
        F.lit(f"{measure} within {TOTAL_TOLERANCE:.0%}").alias("check"),
        F.coalesce(F.abs(F.col("ratio") - 1) <= TOTAL_TOLERANCE, F.lit(False)).alias("ok"), "ratio",
    )


def appearance_band(per_group: DataFrame, p: str = "p") -> DataFrame:
    lo, hi = APPEARANCE_BAND
    return per_group.agg(F.avg(p).alias("mean_p")).select(
        F.lit(f"expected appearances in [{lo:g}, {hi:g}]").alias("check"), F.col("mean_p").between(lo, hi).alias("ok"), "mean_p"
    )


def concentration_band(shares: DataFrame, measure: str) -> DataFrame:
    """Model top share against what a right conditional mean would show; shares: model_top, actual_top."""
    want = F.avg("actual_top") * ORACLE_TOP_SHARE[measure]
    r = ratio(F.avg("model_top"), want)
    return shares.agg(r.alias("ratio")).select(
        F.lit(f"{measure} top share").alias("check"), (F.abs(F.col("ratio") - 1) <= CONCENTRATION_TOLERANCE).alias("ok"), "ratio"
    )


def refuse_wrong_sum(df: DataFrame, column: str) -> None:
    """Only expected values may be summed over a roster."""
    meta = df.schema[column].metadata or {}
    if meta.get("estimand") == "conditional":
        raise CheckFailed(f"{column} is conditional on playing and must not be summed over a roster")


def pairedness(history: DataFrame, keys: list[str]) -> DataFrame:
    """Unpaired share, duplicate scorings, and errors that are not |pred - actual|."""
    dup = duplicates(history, keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"))
    a = history.agg(
        F.avg((F.col("abs_err_model").isNull() | F.col("abs_err_b2").isNull()).cast("double")).alias("u"),
        F.count_if(F.abs(F.col("abs_err_model") - F.abs(F.col("pred") - F.col("actual"))) > 1e-9).alias("w"),
    )
    parts = [
        a.select(F.lit("unpaired share <= 1 %").alias("check"), (F.col("u") <= 0.01).alias("ok"), F.col("u").alias("value")),
        dup.select(F.lit("no duplicate scorings").alias("check"), (F.col("d") == 0).alias("ok"), F.col("d").cast("double").alias("value")),
        a.select(F.lit("error is |pred - actual|").alias("check"), (F.col("w") == 0).alias("ok"), F.col("w").cast("double").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def coverage(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Share of rows carrying each column."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"share_{c}") for c in columns]
    )


def out_of_sample(history: DataFrame, era: str = "season") -> DataFrame:
    return history.agg(F.count_if(~F.coalesce(F.col("trained_through") < F.col(era), F.lit(False))).alias("violations")).select(
        F.lit("trained_through before the scored era").alias("check"), (F.col("violations") == 0).alias("ok"), "violations"
    )
