"""Readers of the delivered tables and their row rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlake.functions.paths import canonical_path, repository


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def current_modules(modules: DataFrame, *extra: str) -> DataFrame:
    """One row per (snapshot_id, canonical path): the one with the latest scanned_at.

    Columns: snapshot_id, id, path and ``extra``. Rows without a snapshot, id or
    path are no modules. A null scanned_at is older than any time; among rows of
    one time the largest (id, extras) counts, so that a repeated run gives the same.
    """
    rows = modules.select(
        "snapshot_id",
        canonical_path("path").alias("path"),
        F.struct("scanned_at", "id", *extra).alias("r"),
    ).where("snapshot_id is not null and path is not null and r.id is not null")
    best = rows.groupBy("snapshot_id", "path").agg(F.max("r").alias("r"))
    return best.select("snapshot_id", F.col("r.id").alias("id"), "path", *[F.col(f"r.{c}").alias(c) for c in extra])


def current_module_ids(modules: DataFrame, *extra: str, seed: int = 0) -> DataFrame:
    """As current_modules, with path_hash (64 bits, of seed and path) in place of the path: nothing but numbers is shuffled."""
    rows = modules.select(
        "snapshot_id",
        F.xxhash64(F.lit(seed), canonical_path("path")).alias("path_hash"),
        F.struct("scanned_at", "id", *extra).alias("r"),
    ).where("snapshot_id is not null and path is not null and r.id is not null")
    best = rows.groupBy("snapshot_id", "path_hash").agg(F.max("r").alias("r"))
    return best.select("snapshot_id", F.col("r.id").alias("id"), "path_hash", *[F.col(f"r.{c}").alias(c) for c in extra])


def deliveries(snapshots: DataFrame) -> DataFrame:
    """repo, snapshot_id, step and previous_id of every delivered snapshot.

    Repeated headers count once, by their earliest saved_at. Steps follow
    saved_at within a repository (roots compared without a final ``/``), nulls
    first, equal times by id.
    """
    heads = (
        snapshots.where("snapshot_id is not null")
        .groupBy("snapshot_id")
        .agg(F.min(repository("repo_root")).alias("repo"), F.min("saved_at").alias("saved_at"))
    )
    order = Window.partitionBy("repo").orderBy(F.col("saved_at").asc_nulls_first(), "snapshot_id")
    return heads.select(
        "repo",
        "snapshot_id",
        F.row_number().over(order).alias("step"),
        F.lag("snapshot_id").over(order).alias("previous_id"),
    )
