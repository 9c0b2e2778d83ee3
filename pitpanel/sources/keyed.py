"""A table of one row per key in hash buckets, under a manifest: writes touch only the buckets of their keys.

Layout: <path>/data/<write>/bucket=<b>/*.parquet and <path>/manifest/<version>.json. A manifest names, for each bucket, the
writes that hold its rows, and what the writer wants remembered. The newest manifest is the table. A write puts
its data beside the old, then commits by creating the next manifest, which only one writer can do; data that no manifest names
is invisible, so a crash before that leaves the old table. Buckets are fixed when the table is made: choose them so that one
fits a task.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitpanel.operators.windows import latest

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed first; read again and repeat."""


@dataclass
class Manifest:
    version: int = 0
    buckets: int = BUCKETS
    keys: list[str] = field(default_factory=list)
    writes: dict[int, list[str]] = field(default_factory=dict)  # bucket -> folders below data/
    note: dict = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The newest committed manifest; its size follows the number of buckets, not the rows."""
    fs, hadoop_path = _fs(spark, path)
    folder = hadoop_path(f"{path}/manifest")
    if not fs.exists(folder):
        return None
    found = [int(m.group(1)) for s in fs.listStatus(folder) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName()))]
    if not found:
        return None
    stream = fs.open(hadoop_path(f"{path}/manifest/{max(found):08d}.json"))
    try:
        raw = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    d = json.loads(raw)
    return Manifest(d["version"], d["buckets"], d["keys"], {int(k): v for k, v in d["writes"].items()}, d["note"])


def _commit(spark: SparkSession, path: str, m: Manifest) -> None:
    """Create the manifest under its number; fails if that number is taken."""
    fs, hadoop_path = _fs(spark, path)
    body = json.dumps({"version": m.version, "buckets": m.buckets, "keys": m.keys, "writes": m.writes, "note": m.note}).encode()
    draft = hadoop_path(f"{path}/manifest/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(body)
    out.close()
    target = hadoop_path(f"{path}/manifest/{m.version:08d}.json")
    if not fs.createNewFile(hadoop_path(f"{path}/manifest/.claim-{m.version:08d}")) or fs.exists(target):
        raise Conflict(f"version {m.version} of {path} is taken")
    fs.rename(draft, target)


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, only: list[int] | None = None, m: Manifest | None = None) -> DataFrame | None:
    """The table, or some of its buckets; None when nothing was written."""
    m = m or manifest(spark, path)
    if m is None:
        return None
    folders = [f"{path}/data/{w}/bucket={b}" for b, ws in sorted(m.writes.items()) if only is None or b in only for w in ws]
    return spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None


def _put(rows: DataFrame, path: str, m: Manifest, keys: list[str]) -> tuple[str, list[int]]:
    """Write rows by bucket; (name of the write, buckets that got rows)."""
    spark = rows.sparkSession
    name = f"w{m.version + 1:08d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/data/{name}"
    rows.withColumn("bucket", bucket_of(keys, m.buckets)).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    fs, hadoop_path = _fs(spark, path)
    found = [int(g.group(1)) for s in fs.listStatus(hadoop_path(folder)) if (g := re.fullmatch(r"bucket=(\d+)", s.getPath().getName()))]
    return name, found


def touched(rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """Buckets of some keys: at most `buckets` numbers."""
    return [r[0] for r in rows.select(bucket_of(keys, buckets).alias("b")).distinct().collect()]


def _start(spark: SparkSession, path: str, keys: list[str], buckets: int) -> Manifest:
    m = manifest(spark, path) or Manifest(0, buckets, list(keys))
    if m.keys != list(keys):
        raise ValueError(f"the table is keyed by {m.keys}")
    return m


def upsert(new: DataFrame, path: str, keys: list[str], order: list[str] = (), buckets: int = BUCKETS, note: dict | None = None) -> Manifest:
    """New rows replace stored ones of their key (of several new ones the last by `order` stays); other buckets are neither read nor written."""
    from pitpanel.session import materialise

    spark = new.sparkSession
    m = _start(spark, path, keys, buckets)
    new = materialise(new, "upsert")
    some = touched(new, keys, m.buckets)
    old = read(spark, path, some, m)
    tagged = new.withColumn("__new", F.lit(1))
    if old is not None:
        tagged = old.withColumn("__new", F.lit(0)).unionByName(tagged, allowMissingColumns=True)
    name, _ = _put(latest(tagged, keys, ["__new", *order]).drop("__new"), path, m, keys)
    after = Manifest(m.version + 1, m.buckets, m.keys, m.writes | {b: [name] for b in some}, m.note | (note or {}))
    _commit(spark, path, after)
    return after


def add_missing(todo: DataFrame, path: str, keys: list[str], build: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS, note: dict | None = None) -> Manifest:
    """Build and add the rows whose keys the table lacks; only the keys of the touched buckets are read, nothing is rewritten.

    `todo` has one row per key, and so has what `build` makes of it.
    """
    from pitpanel.session import materialise

    spark = todo.sparkSession
    m = _start(spark, path, keys, buckets)
    todo = materialise(todo, "todo")
    old = read(spark, path, touched(todo, keys, m.buckets), m)
    new = todo if old is None else todo.join(old.select(*keys), keys, "left_anti")
    name, some = _put(build(new) if build else new, path, m, keys)
    writes = m.writes | {b: [*m.writes.get(b, []), name] for b in some}
    after = Manifest(m.version + 1, m.buckets, m.keys, writes, m.note | (note or {}))
    _commit(spark, path, after)
    return after
