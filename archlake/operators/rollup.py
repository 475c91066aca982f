"""Grouped graph: modules by directory, layer or dependency cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlake.operators.rules import Rules

UNASSIGNED = "(unassigned)"


def group_of(modules: DataFrame, by: str = "directory", depth: int = 1, rules: Rules | None = None, components: DataFrame | None = None) -> DataFrame:
    """snapshot_id, id, group_key. directory: the first ``max(depth, 1)`` path segments; layer: the layer or
    (unassigned); scc: ``scc:<id>`` for modules of a cycle, else the path. Any other ``by`` means directory."""
    path = F.col("path")
    if by == "layer":
        return modules.select("snapshot_id", "id", F.coalesce((rules or Rules()).layer(path), F.lit(UNASSIGNED)).alias("group_key"))
    if by == "scc":
        joined = modules.join(components, ["snapshot_id", "id"], "left")
        return joined.select("snapshot_id", "id", F.when(F.col("scc_size") > 1, F.concat(F.lit("scc:"), F.col("scc_id").cast("string"))).otherwise(path).alias("group_key"))
    return modules.select("snapshot_id", "id", F.array_join(F.slice(F.split("path", "/"), 1, max(depth, 1)), "/").alias("group_key"))


def group_nodes(modules: DataFrame, groups: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row per group: group_id (its position in the snapshot), group_key, label, file_count, loc, is_cluster.

    Order: declared layers in their order, other groups after them by key.
    ``modules`` needs id and loc; a null loc is 0. Members stay rows of ``groups``.
    """
    rows = groups.join(modules.select("snapshot_id", "id", "loc"), ["snapshot_id", "id"])
    sums = rows.groupBy("snapshot_id", "group_key").agg(F.count(F.lit(1)).alias("file_count"), F.sum(F.coalesce("loc", F.lit(0))).alias("loc"))
    place = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(rules.layers if rules else []))):
        place = F.when(F.col("group_key") == name, i).otherwise(place)
    order = Window.partitionBy("snapshot_id").orderBy(F.coalesce(place, F.lit(1 << 30)), "group_key")
    cluster = F.col("group_key").startswith("scc:")
    label = F.when(cluster, F.format_string("cycle cluster (%d files)", "file_count")).otherwise(F.element_at(F.split("group_key", "/"), -1))
    return sums.select(
        "snapshot_id", (F.row_number().over(order) - 1).alias("group_id"), "group_key", label.alias("label"), "file_count", "loc", cluster.alias("is_cluster")
    )


def group_edges(edges: DataFrame, groups: DataFrame, violating: DataFrame | None = None, layers: DataFrame | None = None) -> DataFrame:
    """from_group, to_group, weight, violation, cross_layer_up; edges inside a group are dropped.

    ``violating``: snapshot_id, from_id, to_id of edges with any violation.
    ``layers``: snapshot_id, id, layer_index; upward means from a lower to a higher index.
    """
    g = groups.select("snapshot_id", "id", "group_key")
    rows = edges.join(g.select("snapshot_id", F.col("id").alias("from_id"), F.col("group_key").alias("from_group")), ["snapshot_id", "from_id"]).join(
        g.select("snapshot_id", F.col("id").alias("to_id"), F.col("group_key").alias("to_group")), ["snapshot_id", "to_id"]
    ).where("from_group <> to_group")
    if violating is not None:
        rows = rows.join(violating.select("snapshot_id", "from_id", "to_id").distinct().withColumn("bad", F.lit(True)), ["snapshot_id", "from_id", "to_id"], "left")
    else:
        rows = rows.withColumn("bad", F.lit(False))
    if layers is not None:
        li = layers.select("snapshot_id", "id", "layer_index")
        rows = rows.join(li.select("snapshot_id", F.col("id").alias("from_id"), F.col("layer_index").alias("fi")), ["snapshot_id", "from_id"], "left").join(
            li.select("snapshot_id", F.col("id").alias("to_id"), F.col("layer_index").alias("ti")), ["snapshot_id", "to_id"], "left"
        )
    else:
        rows = rows.withColumns({"fi": F.lit(None).cast("int"), "ti": F.lit(None).cast("int")})
    return rows.groupBy("snapshot_id", "from_group", "to_group").agg(
        F.count(F.lit(1)).alias("weight"),
        F.bool_or(F.coalesce("bad", F.lit(False))).alias("violation"),
        F.bool_or(F.coalesce(F.col("fi") < F.col("ti"), F.lit(False))).alias("cross_layer_up"),
    )


def group_edge_class(violation, upward):
    return F.when(violation, "violation").when(upward, "upward").otherwise("normal")


def group_signals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per group: weighted fan_in and fan_out, orphan (no edge), violation (any incident violating edge), cycle."""
    ends = edges.select("snapshot_id", F.col("from_group").alias("group_key"), F.lit(0).alias("i"), F.col("weight").alias("o"), "violation").unionByName(
        edges.select("snapshot_id", F.col("to_group").alias("group_key"), F.col("weight").alias("i"), F.lit(0).alias("o"), "violation")
    )
    sums = ends.groupBy("snapshot_id", "group_key").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.bool_or("violation").alias("is_violation"))
    return nodes.join(sums, ["snapshot_id", "group_key"], "left").select(
        "snapshot_id", "group_key", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"),
        F.col("fan_in").isNull().alias("is_orphan"), F.coalesce("is_violation", F.lit(False)).alias("is_violation"), F.col("is_cluster").alias("is_cycle"),
    )
