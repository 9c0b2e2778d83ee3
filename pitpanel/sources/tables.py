"""Registered readers: era floors, required tables, kind and season filters, snapshot layouts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pitpanel.operators.shape import nan_to_null, union_ragged

# First era each fact covers.
COVERAGE = {
    "pbp": 1999, "stats_player": 1999, "injuries": 2009, "snap_counts": 2012, "weekly_rosters": 2002,
    "depth_charts": 2001, "participation": 2016, "pfr_advstats": 2018,
}
REQUIRED = {"schedules"}
TRACKING_KINDS = ("receiving", "rushing", "passing")
ADVANCED_KINDS = ("pass", "rush", "rec", "def")


class MissingTable(RuntimeError):
    """A table nothing can work without is absent."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Catalog:
    """Tables under one root, one folder per table, facts partitioned by season."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def dimension(self, name: str) -> DataFrame | None:
        """Whole-history table; None when absent, unless it is required."""
        if not exists(self.spark, self.path(name)):
            if name in REQUIRED:
                raise MissingTable(f"{name} is not under {self.root}")
            return None
        return nan_to_null(self.spark.read.parquet(self.path(name)))

    def fact(self, name: str, seasons: list[int] | None = None) -> DataFrame | None:
        """Season-partitioned fact from its coverage floor on; asking only for earlier ones gives None."""
        floor = COVERAGE[name]
        if seasons is not None and max(seasons) < floor:
            return None
        df = self.dimension(name)
        if df is None:
            return None
        df = df.where(F.col("season") >= floor)
        return df.where(F.col("season").isin([int(s) for s in seasons])) if seasons is not None else df

    def tracking(self, kind: str) -> DataFrame | None:
        """Regular-season weeks only; week 0 holds season totals that would count twice."""
        if kind not in TRACKING_KINDS:
            raise ValueError(f"kind must be one of {TRACKING_KINDS}")
        df = self.dimension(f"ngs_{kind}")
        if df is None:
            return None
        return df.where((F.col("season_type") == "REG") & (F.col("week") > 0))

    def advanced(self, kind: str, seasons: list[int] | None = None) -> DataFrame | None:
        if kind not in ADVANCED_KINDS:
            raise ValueError(f"kind must be one of {ADVANCED_KINDS}")
        df = self.dimension(f"pfr_{kind}")
        if df is None:
            return None
        df = df.where((F.col("season") >= COVERAGE["pfr_advstats"]) & (F.col("game_type") == "REG"))
        return df.where(F.col("season").isin(seasons)) if seasons is not None else df

    def officials(self) -> DataFrame | None:
        """One crew chief per event, keyed by the alternate id as text."""
        df = self.dimension("officials")
        if df is None:
            return None
        chief = df.where((F.col("season_type") == "REG") & (F.col("position") == "Referee")).where(
            "game_id IS NOT NULL AND official_name IS NOT NULL"
        )
        return chief.groupBy(F.col("game_id").cast("string").alias("old_game_id")).agg(
            F.min("official_name").alias("referee")
        )

    def rosters(self) -> DataFrame | None:
        """Both snapshot layouts, each from its own folder, under one ragged union."""
        parts = [d for d in (self.dimension("depth_charts_old"), self.dimension("depth_charts")) if d is not None]
        return union_ragged(*parts) if parts else None


def csv_overlay(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Curated CSV with a stated schema; unreadable cells become null, a missing file no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")


def json_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Every revision of a feed kept as one JSON file each: file, scraped_at text, payload."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select(
        "file", F.coalesce(F.get_json_object("value", "$.scrapedAt"), F.get_json_object("value", "$.scraped_at")).alias("scraped"),
        F.col("value").alias("payload"),
    )
