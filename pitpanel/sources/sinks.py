"""Versioned, guarded and incremental sinks. A version is visible once its commit marker exists."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitpanel.operators.calibrate import GateError
from pitpanel.operators.windows import latest


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for s in fs.listStatus(root):
        m = re.fullmatch(r"version=(\d+)", s.getPath().getName())
        done = jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")
        if m and fs.exists(done):
            found.append(int(m.group(1)))
    return sorted(found)


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    v = versions(spark, path)
    return spark.read.parquet(os.path.join(path, f"version={v[-1]}")) if v else None


def claim_version(spark: SparkSession, path: str) -> int:
    """The next version number, claimed by creating a file that no other writer can create again."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    v = versions(spark, path)
    n = (v[-1] + 1) if v else 1
    while not fs.createNewFile(fs_path(f"{path}/_claims/{n}")):
        n += 1
    return n


def write_version(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write the next version beside the old ones; readers keep the previous one until it commits.

    Two writers get two versions; one that fails leaves its number unused.
    """
    n = claim_version(df.sparkSession, path)
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(os.path.join(path, f"version={n}"))
    return n


def guarded_write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> bool:
    """An empty refresh never replaces a non-empty table; returns whether a version was written."""
    from pitpanel.session import materialise

    old = read_latest(df.sparkSession, path)
    if old is not None and not old.isEmpty():
        df = materialise(df, "refresh")  # computed once, for the check and for the write
        if df.isEmpty():
            return False
    write_version(df, path, partition_by)
    return True


def gate_then_write(df: DataFrame, path: str, passes: bool, why: str) -> int:
    """The gate is computed first; nothing is written when it fails."""
    if not passes:
        raise GateError(why)
    return write_version(df, path)


def resume_write(todo: DataFrame, build, path: str, keys: list[str], partition_by: list[str] | None = None) -> int:
    """Build only the keys the table lacks, add them, and keep one row per key."""
    old = read_latest(todo.sparkSession, path)
    new = build(todo.join(old.select(*keys).distinct(), keys, "left_anti") if old is not None else todo)
    if old is not None:
        tagged = old.withColumn("__new", F.lit(1)).unionByName(new.withColumn("__new", F.lit(0)))
        new = latest(tagged, keys, ["__new"]).drop("__new")
    return write_version(new, path, partition_by)


def upsert_latest(new: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> int:
    """Append and keep the newest row per key."""
    old = read_latest(new.sparkSession, path)
    if old is None:
        return write_version(latest(new.withColumn("__n", F.lit(1)), keys, ["__n"]).drop("__n"), path, partition_by)
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    return write_version(latest(both, keys, ["__n"]).drop("__n"), path, partition_by)


def save_board(batch: DataFrame, path: str, arrival: list[str], era: str = "season", period: str = "week") -> None:
    """Merge a batch into the saved boards of the periods it touches and rewrite only those.

    The merged rows are written to the shared scratch first, since a table cannot be read and
    overwritten in one plan.
    """
    from pitpanel.operators.lines import collapse_alternates
    from pitpanel.session import materialise
    from pitpanel.sources.tables import exists

    spark = batch.sparkSession
    rows = batch.withColumn("__batch", F.lit(1))
    if exists(spark, path):
        touched = batch.select(era, period).distinct()
        old = spark.read.parquet(path).join(touched, [era, period], "left_semi")
        rows = old.withColumn("__batch", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    merged = collapse_alternates(rows, ["__batch", *arrival], (era, period)).drop("__batch")
    safe = materialise(merged, "board")
    (
        safe.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(era, period)
        .parquet(path)
    )
