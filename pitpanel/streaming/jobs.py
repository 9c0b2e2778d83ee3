"""Structured Streaming twins of three batch operators; each agrees with its batch form.

``home`` names the folder of a job's checkpoint and output. A second call with the same home goes on where
the first one stopped; without it both go to a fresh folder of the shared scratch. Every sink is keyed by
batch id, so a batch that is replayed after a failure overwrites its own output instead of adding to it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from pitpanel.operators.joins import asof
from pitpanel.session import scratch_path
from pitpanel.sources import keyed


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files arriving under a path or pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _home(stream: DataFrame, label: str, home: str | None) -> tuple[str, str]:
    """Folders of the checkpoint and of the output."""
    home = home or scratch_path(stream.sparkSession, label)
    return os.path.join(home, "checkpoint"), os.path.join(home, "out")


def _run(stream: DataFrame, checkpoint: str, write_batch, mode: str = "append") -> StreamingQuery:
    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write_batch)
        .start()
    )
    q.awaitTermination()
    return q


def _batch_sink(out: str):
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    return write


def assign_periods(
    snapshots: DataFrame, kickoffs: DataFrame | Callable[[], DataFrame], by: list[str], stamp: str, kick: str, take: dict[str, str], tie: str,
    home: str | None = None,
) -> DataFrame:
    """Snapshot stream to the group's next kickoff; a snapshot after the last one gets null.

    A frame keeps the files that it listed when it was made. Pass a function that reads the schedule to
    have every batch see later files too.
    """
    spark = snapshots.sparkSession
    checkpoint, out = _home(snapshots, "assigned", home)

    def write(df: DataFrame, batch_id: int) -> None:
        got = asof(df, kickoffs() if callable(kickoffs) else kickoffs, by, stamp, kick, take, tie, "forward")
        got.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    _run(snapshots, checkpoint, write)
    return spark.read.parquet(out).drop("batch")


def freeze_stream(lines: DataFrame, keys: list[str], order: list[str], home: str | None = None) -> DataFrame:
    """First-seen record of a line stream.

    Each batch keeps its first row per key and adds those whose key the store lacks: it reads the keys of its own hash
    buckets only and rewrites nothing. A batch that is repeated after a crash finds its number in the store. Keys never
    expire; use ``freeze_expiring`` when they may.
    """
    from pitpanel.operators.windows import first_seen

    spark = lines.sparkSession
    checkpoint, out = _home(lines, "frozen", home)

    def write(df: DataFrame, batch_id: int) -> None:
        done = keyed.manifest(spark, out)
        if done is None or done.note.get("batch", -1) < batch_id:
            keyed.add_missing(first_seen(df, keys, order), out, keys, note={"batch": batch_id})

    _run(lines, checkpoint, write)
    found = keyed.read(spark, out)
    return spark.createDataFrame([], lines.schema) if found is None else found.select(*lines.columns)


def freeze_expiring(lines: DataFrame, keys: list[str], ts: str, horizon: str = "14 days", home: str | None = None) -> DataFrame:
    """First-seen record with bounded state: keys are forgotten after the horizon."""
    spark = lines.sparkSession
    checkpoint, out = _home(lines, "frozen-expiring", home)
    kept = lines.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)
    _run(kept, checkpoint, _batch_sink(out))
    return spark.read.parquet(out).drop("batch")


def window_counts(events: DataFrame, ts: str, by: list[str], width: str, slide: str | None = None, late: str = "1 day", home: str | None = None) -> DataFrame:
    """Counts per event-time window, tumbling or sliding.

    Update mode writes the changed windows of each batch; the newest batch wins when read.
    """
    spark = events.sparkSession
    checkpoint, out = _home(events, "counts", home)
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    agg = (
        events.withWatermark(ts, late)
        .groupBy(span.alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), *by, "n")
    )
    _run(agg, checkpoint, _batch_sink(out), "update")
    done = spark.read.parquet(out)
    return done.groupBy("start", *by).agg(F.max_by("n", "batch").alias("n"))


def session_bursts(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "1 day", home: str | None = None, flush: bool = True) -> DataFrame:
    """Bursts of updates per key separated by at least the gap, the last burst of every key included.

    The stream emits a burst once the watermark passes it. Bursts that are still open when the run ends are read from the
    state that it left; a later run with the same home goes on with them. With ``flush`` off they are left to that run.
    """
    spark = events.sparkSession
    checkpoint, out = _home(events, "bursts", home)
    agg = (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
    )
    _run(agg, checkpoint, _batch_sink(out), "append")
    closed = spark.read.schema(agg.schema).parquet(out).select(*agg.columns)
    if not flush:
        return closed
    state = spark.read.format("statestore").load(checkpoint).select("value.*")
    window = next(c for c, t in state.dtypes if t.startswith("struct<start:"))
    count = next(c for c in reversed(state.columns) if c.startswith("count"))
    return closed.unionByName(state.select(F.col(window)["start"].alias("start"), F.col(window)["end"].alias("end"), *by, F.col(count).alias("n")))
