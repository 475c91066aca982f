"""Trend points, baselines and the sentence that sums a delta up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round2(c: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(c.cast("double"), 2)


def trend_points(snapshots: DataFrame, metrics: DataFrame, edges: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """One point per delivered snapshot, in no order: files, edges, mean fan_in, fan_out and coupling in percent
    (two decimals), and violations (null where no rules were given). Snapshots without modules have zeros."""
    heads = snapshots.where("snapshot_id is not null").groupBy("snapshot_id").agg(F.max("snapshot_label").alias("label"), F.min("saved_at").alias("saved_at"))
    m = metrics.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("fan_in").alias("fi"), F.sum("fan_out").alias("fo"), F.sum("coupling").alias("co")
    )
    e = edges.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("edge_count"))
    out = heads.join(m, "snapshot_id", "left").join(e, "snapshot_id", "left").fillna(0, ["file_count", "edge_count", "fi", "fo", "co"])
    n = F.greatest(F.col("file_count"), F.lit(1))
    out = out.select(
        "snapshot_id", "label", "saved_at", "file_count", "edge_count",
        round2(F.col("fi") / n).alias("avg_fan_in"), round2(F.col("fo") / n).alias("avg_fan_out"), round2(F.col("co") / n * 100).alias("avg_coupling"),
    )
    if violations is None:
        return out.withColumn("violation_count", F.lit(None).cast("long"))
    v = violations.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("violation_count"))
    return out.join(v, "snapshot_id", "left").fillna(0, ["violation_count"])


def baseline_positions(points: DataFrame, baselines: DataFrame) -> DataFrame:
    """repo, position: where (from 0, by saved_at, then snapshot_id) the baseline's label stands first among a repository's
    points; -1 for a repository without a baseline or without that label.

    ``points``: repo, snapshot_id, saved_at, label; ``baselines``: repo, label.
    """
    order = Window.partitionBy("repo").orderBy(F.col("saved_at").asc_nulls_first(), "snapshot_id")  # one repository's deliveries
    placed = points.withColumn("position", F.row_number().over(order) - 1)
    met = placed.join(baselines.select("repo", F.col("label").alias("wanted")), "repo", "left")
    return met.groupBy("repo").agg(F.coalesce(F.min(F.when(F.col("label") == F.col("wanted"), F.col("position"))), F.lit(-1)).alias("position"))


def default_from(points: DataFrame, baselines: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """repo, label a comparison starts from: the one requested, else the baseline's, else the oldest one's, else empty."""
    oldest = points.groupBy("repo").agg(F.min(F.struct(F.col("saved_at").isNotNull().alias("known"), "saved_at", "snapshot_id", "label"))["label"].alias("oldest"))
    rows = oldest.join(baselines.select("repo", F.col("label").alias("baseline")), "repo", "left")
    if requested is None:
        return rows.select("repo", F.coalesce("baseline", "oldest", F.lit("")).alias("label"))
    return rows.join(requested.select("repo", F.col("label").alias("asked")), "repo", "left").select("repo", F.coalesce("asked", "baseline", "oldest", F.lit("")).alias("label"))


def with_workdir(points: DataFrame, workdir: DataFrame) -> DataFrame:
    """The stored points and the working directory's, unless a stored one is labelled workdir."""
    stored = points.where("label = 'workdir'").select(F.lit(1).alias("x")).limit(1)
    return points.unionByName(workdir.join(stored, F.lit(True), "left_anti"), allowMissingColumns=True)


def delta_summary(delta: DataFrame) -> DataFrame:
    """snapshot_id and the four counts of its delta, with the sentence the counts read as."""
    n = lambda e, d: F.count_if((F.col("entity") == e) & (F.col("delta") == d))
    sums = delta.groupBy("snapshot_id").agg(
        n("module", "added").alias("modules_added"), n("module", "removed").alias("modules_removed"),
        n("edge", "added").alias("edges_added"), n("edge", "removed").alias("edges_removed"),
    )
    text = F.format_string("%d file(s) added, %d removed | %d import edges added, %d removed", "modules_added", "modules_removed", "edges_added", "edges_removed")
    return sums.withColumn("summary", text)


def changed_paths(delta: DataFrame) -> DataFrame:
    """snapshot_id, path of modules added or removed since the snapshot before."""
    return delta.where("entity = 'module' and delta in ('added', 'removed')").select("snapshot_id", "path").distinct()


def short_label(label: Column) -> Column:
    """The last ten characters of labels longer than twelve."""
    return F.when(F.char_length(label) > 12, F.right(label, F.lit(10))).otherwise(label)


def display_root(root: Column) -> Column:
    """The last two segments of a repository root."""
    parts = F.filter(F.split(root, "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")
