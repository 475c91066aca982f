import random

import pytest

from archlake.operators import flows, graph, rollup, rules, signals, trends
from archlake.operators.resolve import resolve_imports


def closure(nodes, edges):
    reach = {v: {v} for v in nodes}
    changed = True
    while changed:
        changed = False
        for f, t in edges:
            new = reach[t] - reach[f]
            if new:
                reach[f] |= new
                changed = True
    return reach


@pytest.mark.parametrize("local", [0, 1000])
def test_strong_components(spark, local):
    rng = random.Random(4)
    edges, nodes = [], []
    for s in (1, 2):
        nodes += [(s, v) for v in range(14)]
        edges += [(s, rng.randrange(14), rng.randrange(14)) for _ in range(20)]
    m = spark.createDataFrame(nodes, "snapshot_id long, id long")
    e = spark.createDataFrame(edges, "snapshot_id long, from_id long, to_id long")
    got = {(r["snapshot_id"], r["id"]): (r["scc_id"], r["scc_size"]) for r in graph.strong_components(m, e, local_edges=local).collect()}
    for s in (1, 2):
        reach = closure(range(14), [(f, t) for x, f, t in edges if x == s])
        for v in range(14):
            own = {w for w in range(14) if w in reach[v] and v in reach[w]}
            assert got[s, v] == (min(own), len(own))
    assert graph.strong_components(m, e.limit(0), local_edges=local).where("scc_size <> 1").count() == 0


@pytest.mark.parametrize("share", [1_000_000, 60])
def test_deep_graphs_take_few_jobs(spark, share):
    """A chain of cycles 600 hops deep, in two snapshots: no job per hop, in one stage or dealt into several."""
    ring = [(v, v + 1) for v in range(600)] + [(v + 2, v) for v in range(0, 598, 6)] + [(599, 600), (600, 599)]
    edges = [(s, f, t) for s in (1, 2) for f, t in ring if (s, f) != (2, 300)] + [(1, 5, 5), (1, None, 3), (1, 9, None), (1, 600, 7000), (1, 7000, 0), (2, 1, 2), (None, 1, 2)]
    m = spark.createDataFrame([(s, v) for s in (1, 2) for v in range(602)], "snapshot_id long, id long")
    e = spark.createDataFrame(edges, "snapshot_id long, from_id long, to_id long")
    spark.sparkContext.setJobGroup(f"deep {share}", "")
    got = {(r["snapshot_id"], r["id"]): (r["scc_id"], r["scc_size"]) for r in graph.strong_components(m, e, local_edges=0, share=share).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"deep {share}"))
    spark.sparkContext.setJobGroup("other", "")
    want = {(s, v): (v, 1) for s in (1, 2) for v in range(602)}
    for s in (1, 2):
        for v in range(0, 598, 6):
            if (s, v) != (2, 300):
                want |= {(s, w): (v, 3) for w in (v, v + 1, v + 2)}
        want |= {(s, 599): (599, 2), (s, 600): (599, 2)}
    assert got == want and jobs < 60


def test_connected_components(spark):
    links = [(1, a, a + 1) for a in range(30)] + [(1, 100, 100), (1, 50, 51), (2, 3, 1), (2, None, 1)]
    got = {(r["part"], r["node"]): r["component"] for r in graph.connected_components(spark.createDataFrame(links, "part long, a long, b long")).collect()}
    assert got == {**{(1, v): 0 for v in range(31)}, (1, 100): 100, (1, 50): 50, (1, 51): 50, (2, 3): 1, (2, 1): 1}
    assert graph.connected_components(spark.createDataFrame([], "part long, a long, b long")).count() == 0


def modules(spark, paths):
    return spark.createDataFrame([(1, i, p) for i, p in enumerate(paths)], "snapshot_id long, id long, path string")


def test_metrics_count_both_kinds_and_self_imports(spark):
    m = modules(spark, ["a.ts", "b.ts", "c.ts"])
    e = spark.createDataFrame([(1, 0, 1, "imports"), (1, 0, 1, "reexports"), (1, 2, 2, "imports")], "snapshot_id long, from_id long, to_id long, kind string")
    got = {r["id"]: (r["fan_in"], r["fan_out"], r["instability"]) for r in graph.module_metrics(m, e).collect()}
    assert got == {0: (0, 2, 1.0), 1: (2, 0, 0.0), 2: (1, 1, 0.5)}


def test_layers_and_rules(spark):
    r = rules.Rules.from_toml('[boundaries]\ncore = ["core/**"]\nui = ["ui/**"]\nshared = ["*/shared/*"]\n[rules]\nlayers = ["core", "ui", "core/**"]\ncanonical = [{concept = "src/*/date*.ts", path = "src/utils/date.ts"}]\n')
    m = modules(spark, ["core/shared/u.rs", "ui/app.tsx", "scripts/g.py", "src/utils/date.ts", "src/legacy/date-x.ts"])
    assert {(x["path"], x["layer"]) for x in rules.assign_layers(m, r).collect()} == {("core/shared/u.rs", "core"), ("ui/app.tsx", "ui")}
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 0, 0), (1, 2, 1)], "snapshot_id long, from_id long, to_id long")
    v = {(x["rule"], x["severity"], x["from_path"], x["to_path"]) for x in rules.violations(m, e, r).collect()}
    assert v == {("layer: core < ui", "Error", "core/shared/u.rs", "ui/app.tsx"), ("canonical: src/*/date*.ts", "Warning", "src/legacy/date-x.ts", "src/utils/date.ts")}
    assert rules.violations(m, e, rules.Rules()).count() == 0
    with pytest.raises(ValueError):
        rules.Rules.from_toml("[boundaries")


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("src/*/a?.ts", "src/x/y/ab.ts", True), ("**/x", "x", True), ("a/**", "a/b/c", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("{a,b}/c", "b/c", True), ("a.ts", "aXts", False), ("a[", "za[b", True)],
)
def test_globs(spark, glob, path, hit):
    from pyspark.sql import functions as F

    assert spark.range(1).select(rules.glob_match(glob, F.lit(path)).alias("x")).first()["x"] is hit


def test_rollup_depth_one(spark):
    m = modules(spark, ["main.ts", "src/a.ts", "src/b.ts"]).selectExpr("*", "10 as loc")
    e = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 2)], "snapshot_id long, from_id long, to_id long")
    g = rollup.group_of(m)
    assert {(x["group_key"], x["loc"]) for x in rollup.group_nodes(m, g).collect()} == {("main.ts", 10), ("src", 20)}
    assert [(x["from_group"], x["to_group"], x["weight"]) for x in rollup.group_edges(e, g).collect()] == [("main.ts", "src", 2)]


def test_order_of_violations(spark):
    v = spark.createDataFrame([(1, "b", "Warning", "a", "b", "m", 1), (1, "a", "Error", "z", "b", "m", 9), (1, "a", "Error", "y", "b", "m", 9), (1, "c", "Error", "x", None, None, 3), (2, "c", "Warning", "x", "y", "m", 0)], "snapshot_id long, rule string, severity string, from_path string, to_path string, message string, rule_order int")
    got = [(r["snapshot_id"], r["place"], r["from_path"]) for r in rules.ordered_violations(v).orderBy("snapshot_id", "place").collect()]
    assert got == [(1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (1, 4, "a"), (2, 1, "x")]
    assert rules.ordered_violations(v.limit(0)).count() == 0


def test_neighbours_with_their_rows(spark):
    m = modules(spark, ["a.ts", "b.ts", "c.ts"])
    e = spark.createDataFrame([(1, 0, 1, "imports"), (1, 0, 1, "reexports"), (1, 2, 0, "imports"), (1, 0, 0, "imports"), (2, 0, 1, "imports")], "snapshot_id long, from_id long, to_id long, kind string")
    chosen = spark.createDataFrame([(1, 0)], "snapshot_id long, id long")
    got = {(r["direction"], r["path"]) for r in graph.neighbour_modules(e, chosen, m).collect()}
    assert got == {("out", "b.ts"), ("out", "a.ts"), ("in", "c.ts"), ("in", "a.ts")}


def test_hub_threshold(spark):
    m = spark.createDataFrame([(1, i) for i in range(1, 11)] + [(2, 0)], "snapshot_id long, fan_in long")
    assert {tuple(r) for r in signals.hub_thresholds(m).collect()} == {(1, 10), (2, 2)}


def test_summary_sentence(spark):
    d = spark.createDataFrame([(1, "module", "added"), (1, "edge", "removed"), (1, "module", "changed")], "snapshot_id long, entity string, delta string")
    assert trends.delta_summary(d).first()["summary"] == "1 file(s) added, 0 removed | 0 import edges added, 1 removed"


def test_resolution(spark):
    m = spark.createDataFrame([(1, p) for p in ("src/a/b.ts", "src/foo.ts", "src/foo.service.ts", "src/d/index.js", "src/t.tsx")], "part long, path string")
    i = spark.createDataFrame([(1, "src/a/main.ts", s) for s in ("./b", "react", "../foo.js", "../foo.service", "../d", "/src/t", "../../../../src/t", "./zz")], "part long, path string, specifier string")
    got = {r["specifier"]: r["target"] for r in resolve_imports(i, m).collect()}
    assert got == {"./b": "src/a/b.ts", "react": None, "../foo.js": "src/foo.ts", "../foo.service": "src/foo.ts", "../d": "src/d/index.js", "/src/t": "src/t.tsx", "../../../../src/t": "src/t.tsx", "./zz": None}


def brute_walk(entry, calls):
    seen, steps = {entry}, []

    def visit(v, depth, parent):
        for c in calls.get(v, []):
            if len(steps) == 40:
                return
            again = c in seen
            steps.append((len(steps), parent, v, c, depth, again))
            me = len(steps) - 1
            if not again and depth + 1 < 6:
                seen.add(c)
                visit(c, depth + 1, me)

    visit(entry, 0, None)
    return steps


def test_walk_matches_brute_force(spark):
    rng = random.Random(9)
    calls = {v: [rng.randrange(60) for _ in range(rng.randrange(6))] for v in range(60)}
    calls[0] = list(range(1, 60))
    rows = [(1, v, c, i, None) for v, cs in calls.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "part long, caller long, callee long, call_order long, branch int")
    entries = spark.createDataFrame([(1, v) for v in range(60)], "part long, node long")
    got = {}
    for r in flows.flow_steps(entries, df).collect():
        got.setdefault(r["entry"], []).append((r["step"], r["parent"], r["caller"], r["callee"], r["depth"], r["recursion"]))
    for v in range(60):
        assert sorted(got.get(v, [])) == brute_walk(v, calls)


@pytest.mark.parametrize(("first", "leaves", "cut"), [(0, 40, False), (0, 41, True), (1, 39, False), (1, 40, True)])
def test_one_call_too_many_is_seen(spark, first, leaves, cut):
    """A flow with one call more than fits is truncated, also where that call leads to a leaf or comes from a callee."""
    hub = 2 if first else 1
    calls = [(1, 1, 2, 0, None)] * first + [(1, hub, 100 + i, i, None) for i in range(leaves)]
    df = spark.createDataFrame(calls, "part long, caller long, callee long, call_order int, branch int")
    rows = flows.flow_steps(spark.createDataFrame([(1, 1)], "part long, node long"), df).collect()
    assert len(rows) == 40 and {r["truncated"] for r in rows} == {cut}


def test_walk_fixture():
    steps, cut = flows.walk(1, {1: [(2, None), (3, None)], 2: [(3, None)], 3: [(1, None)]})
    assert [(s["callee"], s["depth"], s["recursion"]) for s in steps] == [(2, 0, False), (3, 1, False), (1, 2, True), (3, 0, True)] and not cut
