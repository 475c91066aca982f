"""The module graph: clean edges, metrics, neighbourhoods, components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.functions.components import spread_components
from archlake.session import Scratch
from archlake.sources.tables import current_modules

KEY = ["snapshot_id", "id"]


def edge_kind(kind: Column | str) -> Column:
    """imports or reexports: kinds compare without case and outer blanks."""
    return F.lower(F.trim(F.col(kind) if isinstance(kind, str) else kind))


def clean_edges(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """snapshot_id, from_id, to_id, kind, specifier: one row per (from, to, kind) of current modules.

    Of repeated edges the specifier seen first counts (smallest scanned_at, then
    smallest text). Edges with a null end or an end outside the snapshot are dropped;
    a null kind reads as imports. Self-imports stay.
    """
    ids = current_modules(modules).select("snapshot_id", "id")
    rows = edges.where("snapshot_id is not null and from_id is not null and to_id is not null").select(
        "snapshot_id", "from_id", "to_id", F.coalesce(edge_kind("kind"), F.lit("imports")).alias("kind"), "specifier", "scanned_at"
    )
    first = rows.groupBy("snapshot_id", "from_id", "to_id", "kind").agg(
        F.min(F.struct(F.col("scanned_at").isNull().alias("late"), "scanned_at", "specifier"))["specifier"].alias("specifier")
    )
    return first.join(ids.withColumnRenamed("id", "from_id"), ["snapshot_id", "from_id"], "left_semi").join(
        ids.withColumnRenamed("id", "to_id"), ["snapshot_id", "to_id"], "left_semi"
    )


def module_metrics(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """fan_in, fan_out (edge counts; an import and a re-export of one target count twice), coupling (fan_out over
    all modules of the snapshot) and instability (fan_out over all edges; 0 for isolated modules) of every module.

    ``modules``: snapshot_id, id, path; ``edges``: clean edges. Counts are taken in
    one aggregation over both ends, combined before the shuffle, so hot targets
    don't gather in one task.
    """
    ends = edges.select("snapshot_id", F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select("snapshot_id", F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    degree = ends.groupBy(*KEY).agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    totals = modules.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("total"))
    joined = modules.select("snapshot_id", "id", "path").join(degree, KEY, "left").join(totals, "snapshot_id").fillna(0, ["fan_in", "fan_out"])
    all_ = F.col("fan_in") + F.col("fan_out")
    return joined.select(
        "snapshot_id", "id", "path", "fan_in", "fan_out",
        (F.col("fan_out") / F.col("total")).alias("coupling"),
        F.when(all_ > 0, F.col("fan_out") / all_).otherwise(0.0).alias("instability"),
    )


def neighbours(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """snapshot_id, id, direction (self, out, in) of the chosen modules and their direct neighbours."""
    out = edges.join(chosen.withColumnRenamed("id", "from_id"), ["snapshot_id", "from_id"], "left_semi").select("snapshot_id", F.col("to_id").alias("id"), F.lit("out").alias("direction"))
    into = edges.join(chosen.withColumnRenamed("id", "to_id"), ["snapshot_id", "to_id"], "left_semi").select("snapshot_id", F.col("from_id").alias("id"), F.lit("in").alias("direction"))
    own = chosen.select("snapshot_id", "id", F.lit("self").alias("direction"))
    return own.unionByName(out).unionByName(into).distinct()


def neighbour_modules(edges: DataFrame, chosen: DataFrame, modules: DataFrame) -> DataFrame:
    """snapshot_id, chosen_id, direction (out: depends on, in: is depended on by), id, path: the module rows beside each chosen module."""
    own = chosen.select("snapshot_id", F.col("id").alias("chosen_id"))
    out = edges.withColumnRenamed("from_id", "chosen_id").join(own, ["snapshot_id", "chosen_id"], "left_semi").select("snapshot_id", "chosen_id", F.lit("out").alias("direction"), F.col("to_id").alias("id"))
    into = edges.withColumnRenamed("to_id", "chosen_id").join(own, ["snapshot_id", "chosen_id"], "left_semi").select("snapshot_id", "chosen_id", F.lit("in").alias("direction"), F.col("from_id").alias("id"))
    return out.unionByName(into).distinct().join(modules.select("snapshot_id", "id", "path"), KEY)


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges both of whose ends are visible."""
    return edges.join(visible.select("snapshot_id", F.col("id").alias("from_id")), ["snapshot_id", "from_id"], "left_semi").join(
        visible.select("snapshot_id", F.col("id").alias("to_id")), ["snapshot_id", "to_id"], "left_semi"
    )


def connected_components(links: DataFrame, part: str = "part") -> DataFrame:
    """part, node, component (smallest node) for every node of the undirected ``links`` (part, a, b).

    Alternating large and small stars: every round ties the neighbours of a node to
    the smallest of them, so the depth of a component halves. A component is settled
    once it is a star around its smallest node. Self links only name their node;
    null ends are ignored. Rounds are written to the shared folder; whether all is
    settled is seen while a round is written.
    """
    scratch = Scratch(links.sparkSession, "components")
    given = links.select(F.col(part).alias("part"), "a", "b").where("a is not null and b is not null and part is not null")
    nodes = given.select("part", F.col("a").alias("node")).union(given.select("part", "b")).distinct()
    start = given.where("a <> b").select("part", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = scratch.write_counting(start, "stars", n=F.lit(1), sum=F.pmod(F.xxhash64("part", "a", "b"), F.lit(1 << 40)))
    last = None
    while seen["n"] and seen != last:
        both = now.union(now.select("part", "b", "a"))
        low = both.groupBy("part", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, ["part", "a"]).where("b > a and b <> m").select("part", F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("a <> m").select("part", "a", F.col("m").alias("b")))  # repeats go with the round's last step
        small_low = large.groupBy("part", "a").agg(F.min("b").alias("m"))
        small = large.join(small_low, ["part", "a"]).where("b <> m").select("part", F.col("b").alias("a"), F.col("m").alias("b"))
        new = small.union(small_low.select("part", "a", F.col("m").alias("b"))).distinct()
        last = seen
        new, seen = scratch.write_counting(new, "stars", n=F.lit(1), sum=F.pmod(F.xxhash64("part", "a", "b"), F.lit(1 << 40)))
        scratch.drop(now)
        now = new
    return nodes.join(now.select("part", F.col("a").alias("node"), "b"), ["part", "node"], "left").select(
        "part", "node", F.coalesce("b", "node").alias("component")
    )


#: edges a task holds at once, about 150 bytes each, where strong components are spread
SHARE = 1_000_000


def _core(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """snapshot_id, f, t of the distinct edges between two modules that aren't one, to modules with an edge out.

    The left join key comes first in the distinct rows, so they need no shuffle of
    their own; a target with an edge out is known to be a module.
    """
    ids = modules.select("snapshot_id", F.col("id").alias("f"))
    rows = edges.where("from_id <> to_id").select("snapshot_id", F.col("from_id").alias("f"), F.col("to_id").alias("t")).join(ids, ["snapshot_id", "f"], "left_semi").distinct()
    tails = rows.select("snapshot_id", F.col("f").alias("t")).distinct()
    return rows.join(tails, ["snapshot_id", "t"], "left_semi").select("snapshot_id", "f", "t")


def _local_components(x: pd.DataFrame) -> pd.DataFrame:
    """v, c (smallest id of its component) of one bounded set of edges: two depth-first passes, without recursion."""
    forward: dict[int, list[int]] = {}
    backward: dict[int, list[int]] = {}
    for f, t in zip(x["f"].tolist(), x["t"].tolist()):
        forward.setdefault(f, []).append(t)
        backward.setdefault(t, []).append(f)
    finished, seen = [], set()
    for root in sorted({*forward, *backward}):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(forward.get(root, ())))]
        while stack:
            v, rest = stack[-1]
            w = next((w for w in rest if w not in seen), None)
            if w is None:
                finished.append(v)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(forward.get(w, ()))))
    component: dict[int, int] = {}
    for root in reversed(finished):
        if root in component:
            continue
        members, todo = [root], [root]
        component[root] = root
        while todo:
            for w in backward.get(todo.pop(), ()):
                if w not in component:
                    component[w] = root
                    members.append(w)
                    todo.append(w)
        low = min(members)
        for w in members:
            component[w] = low
    return pd.DataFrame({"snapshot_id": x["snapshot_id"].iloc[0], "v": list(component), "c": list(component.values())})


def _slots(spark: SparkSession) -> int:
    """Tasks that can run side by side."""
    jvm = spark.sparkContext._jsc.sc()
    return max(1, jvm.maxNumConcurrentTasks(jvm.resourceProfileManager().defaultResourceProfile()))


def strong_components(modules: DataFrame, edges: DataFrame, local_edges: int = 200_000, share: int = SHARE) -> DataFrame:
    """snapshot_id, id, scc_id (smallest id of the component), scc_size of every module.

    ``modules``: snapshot_id, id; ``edges``: snapshot_id, from_id, to_id, clean or as delivered: repeats and ends that
    are null or no module count for nothing. Edges to modules without an edge out lie
    on no cycle and go first. A snapshot of whose edges at most ``local_edges`` are left
    (they are counted first, and take 40 MB and a second or two) is solved in one task, many
    snapshots side by side; this saves the steps below where they gain nothing. All
    others advance together in one barrier stage, with their modules spread over all tasks
    (``archlake.functions.components``): the graphs are deep, and a step there costs
    milliseconds, where one of joins costs a second. If the tasks would hold more than
    ``share`` edges each, whole snapshots are dealt into as many stages, one after the
    other. A single larger snapshot takes all tasks and more of their memory, as does a
    module with many edges that task's which holds it. Barrier stages need all their
    tasks to run at once, so they don't run under dynamic allocation.
    """
    spark = modules.sparkSession
    scratch, one = Scratch(spark, "scc"), F.lit(1)
    core, left = scratch.write_counting(_core(modules, edges), "core", n=one)
    members = spark.createDataFrame([], "snapshot_id long, id long, scc_id long")
    if local_edges > 0 and left["n"]:
        small = core.groupBy("snapshot_id").agg(F.count(one).alias("n")).where(F.col("n") <= local_edges).select("snapshot_id")
        solved = core.join(small, "snapshot_id", "left_semi").groupBy("snapshot_id").applyInPandas(_local_components, "snapshot_id long, v long, c long")
        members = scratch.write(solved.select("snapshot_id", F.col("v").alias("id"), F.col("c").alias("scc_id")), "solved")
        later, left = scratch.write_counting(core.join(small, "snapshot_id", "left_anti"), "core", n=one)
        scratch.drop(core)
        core = later
    tasks = _slots(spark)
    stages = -(-left["n"] // (share * tasks))
    if stages > 1:
        later = scratch.write_by(core.withColumn("stage", F.pmod(F.xxhash64("snapshot_id"), F.lit(stages)).cast("int")), "stage", "stages")
        scratch.drop(core)
        core = later
    for stage in range(stages):
        own = core if stages == 1 else core.where(F.col("stage") == stage)
        task_of = lambda end: F.pmod(F.xxhash64("snapshot_id", end), F.lit(tasks)).cast("int")
        dealt = own.select("snapshot_id", "f", "t", task_of("t").cast("long").alias("peer"), task_of("f").alias("task")).repartitionById(tasks, F.col("task"))
        found = scratch.write(
            dealt.select("snapshot_id", "f", "t", "peer").mapInArrow(spread_components, "snapshot_id long, v long, turn int, c long", barrier=True), "found"
        )
        low = found.groupBy("snapshot_id", "turn", "c").agg(F.min("v").alias("scc_id"))
        members = members.unionByName(found.join(low, ["snapshot_id", "turn", "c"]).select("snapshot_id", F.col("v").alias("id"), "scc_id"))
    ids = modules.select("snapshot_id", "id").join(members, KEY, "left").withColumn("scc_id", F.coalesce("scc_id", "id"))
    sizes = ids.groupBy("snapshot_id", "scc_id").agg(F.count(one).alias("scc_size"))
    return ids.join(sizes, ["snapshot_id", "scc_id"]).select("snapshot_id", "id", "scc_id", "scc_size")
