"""Session helpers: builder for local use, durable scratch space, sizes."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
SIDE_ROWS = 1 << 18
SLICE = "__slice"
SLICE_ROWS = 200_000


def local_session(cores: str = "8", app: str = "pitpanel") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in spark.checkpoint.dir. Only when that is unset (local tests)
    is a temporary folder created, and the choice is remembered in the session.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.conf.get("spark.pitpanel.scratch", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.pitpanel.scratch", base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder; never reused, never deleted here."""
    return os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table in the shared folder and reading it back.

    A written table survives the loss of every executor, which a cached frame does not.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of all files and relations the frame reads; unknown counts as very large."""
    if not hasattr(df, "_jdf"):
        return 1 << 62
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def small_side(df: DataFrame) -> DataFrame:
    """A join side that is usually small. It carries no hint and nothing is fetched: adaptive execution
    broadcasts it if its measured size allows, and otherwise the join shuffles."""
    return df


def stored_side(df: DataFrame, label: str) -> DataFrame:
    """A join side written once and counted: broadcast up to SIDE_ROWS rows, so that wide rows stay where they are; joined by
    shuffle beyond."""
    side = materialise(df, label)
    return F.broadcast(side) if side.count() <= SIDE_ROWS else side


def dealt_in_order(df: DataFrame, order: list[str], label: str) -> tuple[DataFrame, int]:
    """The rows with SLICE, the number of a consecutive stretch of ``order``, as a written table; and how many slices there are.

    A global sort samples its input and so computes it twice. Dealt while its rows are narrow, a table can be widened and then
    put in order by ``in_order`` at the price of one exchange.
    """
    rows = materialise(df, label)
    slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))
    return materialise(rows.repartitionByRange(slices, *order).withColumn(SLICE, F.spark_partition_id()), label), slices


def in_order(df: DataFrame, order: list[str], slices: int) -> DataFrame:
    """Rows of ``dealt_in_order``, whatever was added to them, in the order of their partitions and inside each."""
    return df.repartitionById(slices, F.col(SLICE)).sortWithinPartitions(*order).drop(SLICE)


def constant_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small fixed table as one literal, so it needs no Python worker and has a known size."""
    data = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")
    return spark.range(1).select(F.inline(data))
