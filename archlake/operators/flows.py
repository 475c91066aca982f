"""Entry points, bounded flow walks and the fragility of their steps.

Works on any call table: caller, callee and the order of the calls within a caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlake.functions.labels import entry_kind, flow_name, is_test
from archlake.session import Scratch

#: Bounds of a flow and of the list of flows.
MAX_DEPTH, MAX_STEPS, MAX_FLOWS, TOP_PER_MODULE = 6, 40, 30, 3
#: The kinds a declared feature may name.
KINDS = ("route", "cli", "handler", "public_api")


def feature_table(spark: SparkSession, features: list[dict]) -> DataFrame:
    """place, feature_name, entry (path#function) and given_kind of declared features, in their order (a rules file's section)."""
    rows = [(i, f.get("name"), f.get("entry"), f.get("kind")) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "place int, feature_name string, entry string, given_kind string")


def declared_entries(features: DataFrame, functions: DataFrame) -> DataFrame:
    """part, node, kind (null where the declaration names none of the known kinds), feature_name, place.

    ``features``: as feature_table, with part if they hold for one part only;
    ``functions``: part, node, name, path. An entry without ``#``, or whose file or
    function isn't there, is skipped. Of several functions of one name in a file the
    one with the smallest node counts; a function declared twice keeps its first declaration.
    """
    cut = F.instr("entry", "#")
    wanted = features.where(cut > 0).withColumns({"path": F.expr("substring(entry, 1, instr(entry, '#') - 1)"), "name": F.expr("substring(entry, instr(entry, '#') + 1)")})
    keys = [c for c in ("part", "path", "name") if c in wanted.columns]
    met = functions.select("part", "node", "name", "path").join(wanted, keys)
    first = met.groupBy("part", "place", "feature_name", "given_kind").agg(F.min("node").alias("node"))
    once = first.groupBy("part", "node").agg(F.min(F.struct("place", "feature_name", "given_kind")).alias("d"))
    return once.select("part", "node", F.when(F.col("d.given_kind").isin(*KINDS), F.col("d.given_kind")).alias("kind"), "d.feature_name", "d.place")


def entry_points(functions: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """part, node, name, path, kind, declared, feature_name, rank, flow_name: entries of every part, at most MAX_FLOWS.

    ``functions``: part, node, module, name, path, exported, out_calls. ``declared``:
    as declared_entries; these come first, in their order. Other entries are
    exported, call something, and are no tests; those of a kind other than
    exported_entry come before the rest, then those with more resolved calls, and of
    a module the TOP_PER_MODULE first ones count. Ties go by name, then node.
    """
    auto = functions.where(F.col("exported") & (F.col("out_calls") > 0) & ~is_test(F.col("path")))
    if declared is not None:
        auto = auto.join(declared, ["part", "node"], "left_anti")
    kind = entry_kind(F.col("name"), F.col("path"))
    auto = auto.withColumn("kind", kind)
    biggest = [(F.col("kind") != "exported_entry").desc(), F.col("out_calls").desc(), "name", "node"]
    columns = ["part", "node", "name", "path", "kind", "out_calls"]
    # the functions of one module, then those of one part: no more than TOP_PER_MODULE a module are left
    top = auto.withColumn("r", F.row_number().over(Window.partitionBy("part", "module").orderBy(*biggest))).where(F.col("r") <= TOP_PER_MODULE)
    rows = top.select(*columns, F.lit(False).alias("declared"), F.lit(None).cast("string").alias("feature_name"), F.lit(None).cast("int").alias("place"))
    if declared is not None:
        named = functions.join(declared.withColumnRenamed("kind", "given"), ["part", "node"]).withColumn("kind", F.coalesce("given", kind))
        rows = rows.unionByName(named.select(*columns, F.lit(True).alias("declared"), "feature_name", "place"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("declared").desc(), F.col("place").asc_nulls_last(), *biggest))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= MAX_FLOWS)
    return first.select("part", "node", "name", "path", "kind", "declared", "feature_name", "rank", flow_name(F.col("name")).alias("flow_name"))


def reachable_calls(entries: DataFrame, calls: DataFrame) -> DataFrame:
    """part, entry, caller, callee, pos, branch: the calls a walk from each entry can meet.

    A call at position i of its caller is met after i siblings, so a path costs the
    sum of (i + 1) over its calls, and none beyond MAX_STEPS can belong to the walk.
    One call more is kept: it shows that the walk was cut.
    With at most MAX_DEPTH hops this bounds every entry's share, whatever the graph.
    ``calls``: part, caller, callee, call_order (and branch). Expanded by one join a hop.
    """
    scratch = Scratch(calls.sparkSession, "flows")
    order = Window.partitionBy("part", "caller").orderBy("call_order", "callee", "branch")
    near = calls.select("part", "caller", "callee", "branch", (F.row_number().over(order) - 1).alias("pos")).where(F.col("pos") <= MAX_STEPS)
    near = scratch.write(near, "calls")
    reached = entries.select("part", F.col("node").alias("entry"), F.col("node").alias("caller"), F.lit(0).alias("cost"))
    front = reached
    for _ in range(MAX_DEPTH - 1):
        step = front.join(near, ["part", "caller"]).select("part", "entry", F.col("callee").alias("caller"), (F.col("cost") + F.col("pos") + 1).alias("cost"))
        front = step.where(F.col("cost") <= MAX_STEPS).groupBy("part", "entry", "caller").agg(F.min("cost").alias("cost"))
        front = scratch.write(front, "front")
        reached = reached.unionByName(front)
    best = reached.groupBy("part", "entry", "caller").agg(F.min("cost").alias("cost"))
    return best.join(near, ["part", "caller"]).where(F.col("cost") + F.col("pos") <= MAX_STEPS).drop("cost")


STEP = "part long, entry long, step int, parent int, caller long, callee long, depth int, recursion boolean, branch int, truncated boolean"


def walk(entry: int, calls: dict[int, list[tuple]]) -> tuple[list[dict], bool]:
    """Pre-order steps from ``entry``: a callee met before anywhere in the flow is shown but not entered again."""
    seen, steps, stack = {entry}, [], [(entry, iter(calls.get(entry, ())), 0, None)]
    while stack:
        caller, rest, depth, parent = stack[-1]
        call = next(rest, None)
        if call is None:
            stack.pop()
            continue
        if len(steps) == MAX_STEPS:
            return steps, True
        callee, branch = call
        again = callee in seen
        me = len(steps)
        steps.append({"step": me, "parent": parent, "caller": caller, "callee": callee, "depth": depth, "recursion": again, "branch": branch})
        if not again and depth + 1 < MAX_DEPTH:
            seen.add(callee)
            if callee in calls:
                stack.append((callee, iter(calls[callee]), depth + 1, me))
    return steps, False


def flow_steps(entries: DataFrame, calls: DataFrame) -> DataFrame:
    """The steps (STEP) of the walk from every entry; ``truncated`` marks flows that were cut at MAX_STEPS.

    An entry without calls has no steps. Nodes are numbers; only resolved calls are given.
    """
    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, list[tuple]] = {}
        for caller, callee, branch in x.sort_values(["caller", "pos"])[["caller", "callee", "branch"]].itertuples(index=False):
            by.setdefault(caller, []).append((callee, None if pd.isna(branch) else int(branch)))
        steps, cut = walk(key[1], by)
        out = pd.DataFrame(steps, columns=["step", "parent", "caller", "callee", "depth", "recursion", "branch"])
        out = out.assign(part=key[0], entry=key[1], truncated=cut).astype({"parent": "Int64", "branch": "Int64"})
        return out[[c.split()[0] for c in STEP.split(", ")]]

    return reachable_calls(entries, calls).groupBy("part", "entry").applyInPandas(run, STEP)


def _flag(when: Column, source: str, code: str, severity: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(source).alias("source"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message")))


def step_flags(steps: DataFrame, nodes: DataFrame, violating: DataFrame, changed: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """``steps`` with ``flags``: array<struct<source, code, severity, message>> in their fixed order.

    ``nodes``: part, node, path, scc_id, scc_size, instability; ``violating``: part,
    from_path, to_path (of any severity); ``changed``: part, path (added or removed
    since the baseline); ``contracts``: part, node, slot, name, untyped, missing.
    """
    n = nodes.select("part", "node", F.struct("path", "scc_id", "scc_size", "instability").alias("m"))
    bad = violating.select("part", "from_path", "to_path").distinct().withColumn("bad", F.lit(True))
    new = changed.select("part", "path").distinct()
    rows = (
        steps.join(n.select("part", F.col("node").alias("caller"), F.col("m").alias("f")), ["part", "caller"], "left")
        .join(n.select("part", F.col("node").alias("callee"), F.col("m").alias("t")), ["part", "callee"], "left")
        .withColumns({"from_path": F.col("f.path"), "to_path": F.col("t.path")})
        .join(bad, ["part", "from_path", "to_path"], "left")
        .join(new.select("part", F.col("path").alias("from_path"), F.lit(True).alias("new_f")), ["part", "from_path"], "left")
        .join(new.select("part", F.col("path").alias("to_path"), F.lit(True).alias("new_t")), ["part", "to_path"], "left")
    )
    # Sources, codes, severities and texts of the flags, in their order.
    percent = F.bround(F.col("t.instability") * 100, 0).cast("int").cast("string")
    before = [
        _flag((F.col("f.scc_id") == F.col("t.scc_id")) & (F.col("f.scc_size") > 1), "metric", "scc_cycle", "Error", F.lit("This call crosses a circular dependency — both modules are in the same import cycle.")),
        _flag(F.col("t.instability") > 0.75, "metric", "high_instability", "Warning", F.concat(F.lit("Target module instability is "), percent, F.lit("% — highly unstable modules change often."))),
        _flag(F.col("bad"), "metric", "violation", "Error", F.lit("This call crosses a boundary declared forbidden in the rules file.")),
    ]
    after = [
        _flag(F.col("new_f"), "churn", "churn_caller", "Warning", F.lit("The calling module has changed since the baseline snapshot.")),
        _flag(F.col("new_t"), "churn", "churn_callee", "Warning", F.lit("The called module has changed since the baseline snapshot.")),
    ]
    flags = F.array(*before, *after)
    if contracts is not None:
        c = contracts.where("slot >= 0 and (untyped or missing) or slot < 0 and untyped")
        name = F.concat(F.lit("Parameter '"), F.col("name"))
        typed = F.coalesce(
            _flag(F.col("slot") < 0, "type", "any_return", "Warning", F.lit("Return type is `any` or `unknown`.")),
            _flag(F.col("untyped"), "type", "any_payload", "Warning", F.concat(name, F.lit("' is typed as `any` or `unknown` — no contract enforcement."))),
            _flag(F.lit(True), "type", "untyped_boundary", "Warning", F.concat(name, F.lit("' has no type annotation — contract is implicit."))),
        )
        place = F.when(F.col("slot") < 0, 1 << 30).otherwise(F.col("slot"))
        own = c.groupBy("part", F.col("node").alias("callee")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), typed.alias("flag")))).alias("typed"))  # one function's parameters
        rows = rows.join(own, ["part", "callee"], "left")
        flags = F.concat(F.array(*before), F.coalesce(F.transform("typed", lambda x: x["flag"]), F.array().cast("array<struct<source:string,code:string,severity:string,message:string>>")), F.array(*after))
    return rows.select(*steps.columns, "from_path", "to_path", F.array_compact(flags).alias("flags"))


def fragility_summary(flagged: DataFrame, keys: tuple[str, ...] = ("part", "entry")) -> DataFrame:
    """Per flow: steps, fragile steps, flags by source, the highest severity (null for none) and the fragile percentage."""
    n = lambda s: F.sum(F.size(F.filter("flags", lambda f: f["source"] == s)))
    worst = F.max(F.when(F.exists("flags", lambda f: f["severity"] == "Error"), 2).when(F.size("flags") > 0, 1).otherwise(0))
    out = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(F.size("flags") > 0).alias("fragile_steps"),
        n("metric").alias("metric_flags"), n("type").alias("type_flags"), n("churn").alias("churn_flags"), worst.alias("w"),
    )
    return out.select(
        *keys, "steps", "fragile_steps", "metric_flags", "type_flags", "churn_flags",
        F.when(F.col("w") == 2, "Error").when(F.col("w") == 1, "Warning").alias("max_severity"),
        F.when(F.col("steps") > 0, F.round(F.col("fragile_steps") * 100 / F.col("steps"))).otherwise(0).cast("int").alias("fragile_percent"),
    )


def flow_summaries(entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row per entry; entries without steps have zeros and no severity. flow_id is a hash of part and entry."""
    rows = entries.join(summaries.withColumnRenamed("entry", "node"), ["part", "node"], "left").fillna(
        0, ["steps", "fragile_steps", "metric_flags", "type_flags", "churn_flags", "fragile_percent"]
    )
    return rows.withColumn("flow_id", F.xxhash64("part", "node"))


def find_flow(summaries: DataFrame, steps: DataFrame, flow_id: int) -> tuple[DataFrame, DataFrame]:
    """The summary of one flow and its steps; both are empty for an unknown id."""
    one = summaries.where(F.col("flow_id") == flow_id)
    return one, steps.join(one.select("part", F.col("node").alias("entry")), ["part", "entry"], "left_semi")


def branch_groups(steps: DataFrame) -> DataFrame:
    """part, entry, caller, branch: how many steps share a branch, and the first of them."""
    return steps.where("branch is not null").groupBy("part", "entry", "caller", "branch").agg(F.count(F.lit(1)).alias("steps"), F.min("step").alias("first_step"))


def tree_edges(steps: DataFrame) -> DataFrame:
    """Edges of the flow's tree: from the parent step, without repeated visits."""
    return steps.where("parent is not null and not recursion").select("part", "entry", F.col("parent").alias("from_step"), F.col("step").alias("to_step"))


def step_severities(flagged: DataFrame) -> DataFrame:
    """Errors and warnings of each step."""
    n = lambda s: F.size(F.filter("flags", lambda f: f["severity"] == s))
    return flagged.select("part", "entry", "step", n("Error").alias("errors"), n("Warning").alias("warnings"))
