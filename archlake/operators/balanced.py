"""Per-key results when a few keys hold most records (problem 4).

Fragment-replicate by estimated load. The load of a key is its row count. Keys
heavier than a fraction of a task's fair share are split into shards in
proportion to their load; all other keys fall into hash buckets; shards and
buckets are packed into tasks, largest first. Rows travel to the task of their
bucket or shard, and the matching side is replicated to exactly the tasks that
hold a shard of its key. Both plans are bounded: at most ``tasks / fraction``
keys can exceed the fraction, and the buckets are a multiple of the tasks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class LoadPlan:
    tasks: int
    buckets: int
    bucket_task: list[int]
    heavy: list[tuple]  # (*key, list of tasks), one entry per shard
    loads: list[int]

    def tables(self, spark: SparkSession, keys: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
        schema = ", ".join(f"{k} {t}" for k, t in keys) + ", shard_tasks array<int>"
        heavy = spark.createDataFrame([(*h[:-1], h[-1]) for h in self.heavy], schema)
        buckets = spark.createDataFrame(list(enumerate(self.bucket_task)), "bucket int, bucket_task int")
        return heavy, buckets


def pack(items: list[tuple[int, object]], tasks: int) -> tuple[dict, list[int]]:
    """Largest first into the emptiest task; returns item -> task and the loads."""
    heap = [(0, t) for t in range(tasks)]
    where, loads = {}, [0] * tasks
    for load, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        total, t = heapq.heappop(heap)
        where[item] = t
        loads[t] = total + load
        heapq.heappush(heap, (total + load, t))
    return where, loads


def plan_load(rows: DataFrame, keys: list[str], tasks: int | None = None, fraction: float = 0.25, buckets_per_task: int = 16) -> LoadPlan:
    """Estimate loads and pack them. Two small results reach the driver: the bucket
    loads (``tasks * buckets_per_task`` rows) and the keys above ``fraction`` of a
    fair share (at most ``tasks / fraction``)."""
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * buckets_per_task
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__bucket", bucket).persist()
    try:
        load = dict(counts.groupBy("__bucket").agg(F.sum("__n")).collect())
        fair = max(1, -(-sum(load.values()) // tasks))
        limit = max(1, int(fair * fraction))
        hot = counts.where(F.col("__n") > limit).select(*keys, "__n", "__bucket").collect()
    finally:
        counts.unpersist()
    items: list[tuple[int, object]] = []
    for h in hot:
        load[h["__bucket"]] -= h["__n"]
        shards = min(tasks, -(-h["__n"] // limit))
        items += [(-(-h["__n"] // shards), ("key", tuple(h[k] for k in keys), s)) for s in range(shards)]
    items += [(load.get(b, 0), ("bucket", b)) for b in range(buckets)]
    where, loads = pack(items, tasks)
    heavy: dict[tuple, list[int]] = {}
    for item, t in where.items():
        if item[0] == "key":
            heavy.setdefault(item[1], []).append(t)
    return LoadPlan(
        tasks, buckets, [where[("bucket", b)] for b in range(buckets)], [(*k, sorted(set(v))) for k, v in heavy.items()], loads
    )


def route(rows: DataFrame, plan: LoadPlan, keys: list[str], shard_by: list[str]) -> DataFrame:
    """Adds __task: of the key's bucket, or for heavy keys of the shard that the hash of ``shard_by`` falls in."""
    heavy, buckets = plan.tables(rows.sparkSession, [(k, rows.schema[k].dataType.simpleString()) for k in keys])
    shard = F.pmod(F.xxhash64(*shard_by), F.size("shard_tasks")).cast("int")
    return (
        rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(plan.buckets)).cast("int"))
        .join(F.broadcast(heavy), keys, "left")
        .join(F.broadcast(buckets), "bucket")
        .withColumn("__task", F.coalesce(F.element_at("shard_tasks", shard + 1), F.col("bucket_task")))
        .drop("bucket", "bucket_task", "shard_tasks")
    )


def replicate(match: DataFrame, plan: LoadPlan, keys: list[str]) -> DataFrame:
    """``match`` once per task that can hold rows of its key, with __task."""
    heavy, buckets = plan.tables(match.sparkSession, [(k, match.schema[k].dataType.simpleString()) for k in keys])
    return (
        match.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(plan.buckets)).cast("int"))
        .join(F.broadcast(heavy), keys, "left")
        .join(F.broadcast(buckets), "bucket")
        .withColumn("__task", F.explode(F.coalesce("shard_tasks", F.array("bucket_task"))))
        .drop("bucket", "bucket_task", "shard_tasks")
    )


def balanced_counts(
    rows: DataFrame, match: DataFrame, keys: list[str], distinct: list[str], tasks: int | None = None, load_rows: DataFrame | None = None
) -> DataFrame:
    """``match`` rows (keys plus any columns) with ``n``, the number of distinct
    ``distinct`` among the ``rows`` of equal keys; 0 without any.

    ``rows`` may repeat. Null keys in ``rows`` count for nothing, in ``match`` they
    get 0; null in ``distinct`` is a value of its own. Repeated ``match`` rows come
    out once. ``tasks`` defaults to spark.sql.shuffle.partitions. An empty ``rows``
    gives 0 everywhere. ``load_rows`` (default: ``rows``) are rows whose key counts
    estimate the load where ``rows`` themselves are costly to count; a wrong
    estimate costs balance, never rows.
    """
    given = rows.select(*keys, *distinct).dropna(subset=keys)
    plan = plan_load(given if load_rows is None else load_rows.select(*keys).dropna(), keys, tasks)
    fragments = (
        route(given, plan, keys, distinct)
        .repartitionById(plan.tasks, F.col("__task"))
        .dropDuplicates(["__task", *keys, *distinct])  # distinct rows of a key never share a shard
        .groupBy("__task", *keys)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    distinct_match = match.dropDuplicates()
    copies = replicate(distinct_match, plan, keys).repartitionById(plan.tasks, F.col("__task"))
    joined = copies.join(fragments, ["__task", *keys], "left")
    return joined.groupBy(*match.columns).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))


def fan_in_mismatches(modules: DataFrame, edges: DataFrame, metrics: DataFrame, tasks: int | None = None) -> DataFrame:
    """snapshot_id, id of recorded fan_in values that differ from the edges.

    The true value is the number of distinct (from_id, kind) among the snapshot's
    edges to the module whose from_id is a current module of the snapshot; kinds
    compare without case and outer blanks (null is a kind of its own).
    """
    from archlake.sources.tables import current_module_ids

    sources = current_module_ids(modules).select("snapshot_id", F.col("id").alias("from_id"))
    rows = (
        edges.select("snapshot_id", "from_id", F.col("to_id").alias("id"), F.lower(F.trim("kind")).alias("kind"))
        .where("snapshot_id is not null and from_id is not null and id is not null")
        .dropDuplicates()  # by all columns: repeats go on the map side, and no from_id gathers in one task
        .join(sources, ["snapshot_id", "from_id"], "left_semi")
    )
    recorded = metrics.where("fan_in is not null and snapshot_id is not null and id is not null").select("snapshot_id", "id", "fan_in")
    raw = edges.select("snapshot_id", F.col("to_id").alias("id"))
    counted = balanced_counts(rows, recorded, ["snapshot_id", "id"], ["from_id", "kind"], tasks, load_rows=raw)
    return counted.where("fan_in <> n").select("snapshot_id", "id").distinct()
