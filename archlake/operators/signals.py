"""Per-module signals and display classes derived from metrics, components, violations and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hub_thresholds(metrics: DataFrame) -> DataFrame:
    """snapshot_id, hub_at: the larger of 2 and the fan_in at position floor(0.9 n) of the ascending order.

    Counted over (fan_in, modules) pairs, so no snapshot's values are collected: the
    position is found in the running count of distinct values.
    """
    from pyspark.sql import Window

    counts = metrics.groupBy("snapshot_id", "fan_in").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("snapshot_id").orderBy("fan_in")
    total = counts.groupBy("snapshot_id").agg(F.sum("c").alias("n"))
    running = counts.withColumn("upto", F.sum("c").over(up)).join(total, "snapshot_id")
    return running.where(F.col("upto") > F.floor(F.col("n") * 0.9)).groupBy("snapshot_id").agg(F.greatest(F.lit(2), F.min("fan_in")).alias("hub_at"))


def module_signals(
    metrics: DataFrame, components: DataFrame, violations: DataFrame, duplicates: DataFrame, delta: DataFrame
) -> DataFrame:
    """One row per module: is_hub, is_orphan, is_cycle, is_violation_src (Errors only), is_dupe, change_status.

    ``metrics``: snapshot_id, id, path, fan_in, fan_out, instability; ``components``:
    scc_size; ``duplicates``: snapshot_id, path; ``delta``: snapshot_id, path, delta
    (added modules; others are unchanged).
    """
    def paths(df: DataFrame, flag: str) -> DataFrame:
        return df.select("snapshot_id", "path").where("path is not null").distinct().withColumn(flag, F.lit(True))

    sources = violations.where("severity = 'Error'").select("snapshot_id", F.col("from_path").alias("path"))
    rows = (
        metrics.join(components.select("snapshot_id", "id", "scc_size"), ["snapshot_id", "id"], "left")
        .join(hub_thresholds(metrics), "snapshot_id", "left")
        .join(paths(sources, "bad"), ["snapshot_id", "path"], "left")
        .join(paths(duplicates, "dupe"), ["snapshot_id", "path"], "left")
        .join(paths(delta.where("delta = 'added'"), "new"), ["snapshot_id", "path"], "left")
    )
    no = F.lit(False)
    return rows.select(
        "snapshot_id", "id", "path", "instability",
        (F.col("fan_in") >= F.col("hub_at")).alias("is_hub"),
        ((F.col("fan_in") == 0) & (F.col("fan_out") == 0)).alias("is_orphan"),
        F.coalesce(F.col("scc_size") > 1, no).alias("is_cycle"),
        F.coalesce("bad", no).alias("is_violation_src"),
        F.coalesce("dupe", no).alias("is_dupe"),
        F.when(F.coalesce("new", no), "added").otherwise("unchanged").alias("change_status"),
    )


def badges(signals: DataFrame) -> DataFrame:
    """At most three badges: cycle, hub, then violation or else dupe."""
    last = F.when(F.col("is_violation_src"), "violation").when(F.col("is_dupe"), "dupe")
    return signals.select("snapshot_id", "id", F.array_compact(F.array(F.when(F.col("is_cycle"), "cycle"), F.when(F.col("is_hub"), "hub"), last)).alias("badges"))


def filter_modules(signals: DataFrame, search: str = "", **flags: bool) -> DataFrame:
    """Modules whose path contains ``search`` in any case and that have every flag asked for (is_hub=True, ...)."""
    out = signals.where(F.lower("path").contains(search.lower())) if search else signals
    for name, wanted in flags.items():
        if wanted:
            out = out.where(F.col(name))
    return out


def edge_classes(edges: DataFrame, components: DataFrame, violating: DataFrame) -> DataFrame:
    """Edges with edge_class: violation, else cycle (both ends in one cycle), else reexport, else import."""
    c = components.where("scc_size > 1").select("snapshot_id", "id", "scc_id")
    return (
        edges.join(violating.select("snapshot_id", "from_id", "to_id").distinct().withColumn("bad", F.lit(True)), ["snapshot_id", "from_id", "to_id"], "left")
        .join(c.select("snapshot_id", F.col("id").alias("from_id"), F.col("scc_id").alias("sf")), ["snapshot_id", "from_id"], "left")
        .join(c.select("snapshot_id", F.col("id").alias("to_id"), F.col("scc_id").alias("st")), ["snapshot_id", "to_id"], "left")
        .select(
            "snapshot_id", "from_id", "to_id", "kind",
            F.when(F.col("bad"), "violation").when(F.col("sf") == F.col("st"), "cycle").when(F.col("kind") == "reexports", "reexport").otherwise("import").alias("edge_class"),
        )
    )


def node_width(loc: Column) -> Column:
    return F.round(F.least(F.greatest(148 + loc / 400 * 76, F.lit(148)), F.lit(224))).cast("long")


def stability_label(instability: Column) -> Column:
    return F.when(instability < 0.25, "stable").when(instability > 0.75, "unstable").otherwise("balanced")


def instability_colour(instability: Column) -> Column:
    return F.when(instability > 0.7, "hot").when(instability < 0.3, "cold").otherwise("warm")


def similarity_severity(similarity: Column) -> Column:
    """Of a similarity in percent."""
    return F.when(similarity >= 85, "high").when(similarity >= 70, "medium").otherwise("low")


def module_hue(module: Column) -> Column:
    return F.pmod(module * 137.508, F.lit(360.0))


def palette_index(i: Column) -> Column:
    return F.pmod(i, F.lit(6))
