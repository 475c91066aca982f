"""Every registered query against its SQL; those SQL can't express against each other and against brute force."""

import re
from collections import Counter, defaultdict

import pytest

from archlake.plans import problems, registry
from tests.helpers import DATA, assert_same

ALL = {**{k: (registry, k) for k in registry.QUERIES}, **{k: (problems, k) for k in problems.QUERIES}}
TEXT_QUERIES = {
    "extracted_functions", "call_resolutions", "call_graph_edges", "call_graph_degrees", "call_graph_report", "type_contracts", "parameter_arguments",
    "function_entry_points", "function_flow_steps", "function_fragility_flags", "function_fragility_summary", "function_step_severities",
}


@pytest.mark.parametrize("name", [k for k, (m, _) in ALL.items() if k in m.ORACLES])
def test_against_sql(spark, name):
    module, _ = ALL[name]
    assert_same(module.QUERIES[name](spark, DATA), module.ORACLES[name])


def test_every_query_is_compared():
    assert {k for k, (m, _) in ALL.items() if k not in m.ORACLES} == TEXT_QUERIES


def rows(spark, name):
    return registry.QUERIES[name](spark, DATA).collect()


def test_functions_of_the_texts(spark):
    """Declared functions and classes' methods as plain patterns find them; contracts hold one row per parameter and one per return."""
    found = rows(spark, "extracted_functions")
    texts = {(r["report_id"], r["path"].replace("\\", "/").replace("//", "/").removeprefix("./")): r["content"] for r in spark.read.parquet(f"{DATA}/source_files.parquet").where("content is not null").collect()}
    names = defaultdict(set)
    for r in found:
        names[r["part"], r["path"]].add(r["name"])
        assert texts[r["part"], r["path"]][r["start"] : r["end"]].rstrip()[-1] in "}]);)" or r["end"] > r["start"]
    missed = {(k, n) for k, t in texts.items() if re.search(r"\.(ts|tsx|js|jsx|mjs|cjs)$", k[1]) for n in re.findall(r"^export (?:async )?function (\w+)\(", t, re.M) if n not in names[k]}
    assert not missed and len(found) > 50
    contracts = rows(spark, "type_contracts")
    slots = Counter((r["part"], r["path"], r["order"]) for r in contracts)
    assert slots == Counter({(r["part"], r["path"], r["order"]): r["params"] + 1 for r in found})
    untyped = {(r["part"], r["path"], r["order"]) for r in found if r["return_type"] is None}
    assert {(r["part"], r["path"], r["order"]) for r in contracts if r["slot"] == -1 and r["missing"]} == untyped


def test_calls_and_their_counts(spark):
    calls, edges, degrees, report = (rows(spark, n) for n in ("call_resolutions", "call_graph_edges", "call_graph_degrees", "call_graph_report"))
    params = {(r["part"], r["path"], r["order"]): r["params"] for r in rows(spark, "extracted_functions")}
    resolved = Counter((r["part"], r["path"], r["order"], r["target_module"], r["target_order"]) for r in calls if r["resolution"] == "resolved")
    assert {tuple(r)[:5]: r["call_count"] for r in edges} == resolved
    out, fan_out, fan_in = Counter(), Counter(), Counter()
    for (part, path, order, module, target), n in resolved.items():
        out[part, path, order] += n
        fan_out[part, path, order] += 1
        fan_in[part, module, target] += 1
    assert {(r["part"], r["path"], r["order"]): (r["resolved_calls"], r["fan_out"], r["fan_in"]) for r in degrees} == {k: (out[k], fan_out[k], fan_in[k]) for k in params}
    for r in report:
        own = [c for c in calls if c["part"] == r["part"]]
        assert (r["functions"], r["resolved_calls"], r["unresolved_calls"]) == (sum(k[0] == r["part"] for k in params), sum(c["resolution"] == "resolved" for c in own), sum(c["resolution"] != "resolved" for c in own))
    paired = Counter((r["part"], r["path"], r["order"], r["call_order"]) for r in rows(spark, "parameter_arguments"))
    want = {(c["part"], c["path"], c["order"], c["call_order"]): params[c["part"], c["target_module"], c["target_order"]] for c in calls if c["resolution"] == "resolved"}
    assert paired == Counter({k: n for k, n in want.items() if n})


def test_flows_over_functions(spark):
    """Entries, walks, flags and sums agree with one another; each walk shows no more than the resolved calls of its callers."""
    entries, steps, flags, summary, severities = (rows(spark, f"function_{n}") for n in ("entry_points", "flow_steps", "fragility_flags", "fragility_summary", "step_severities"))
    assert all(sorted(e["rank"] for e in entries if e["part"] == p) == list(range(1, 1 + sum(e["part"] == p for e in entries))) for p in {e["part"] for e in entries})
    assert all(e["declared"] == (e["rank"] == 1) and (e["feature_name"] is not None) == e["declared"] for e in entries)
    assert len(summary) == len(entries) and sum(s["steps"] for s in summary) == len(steps)
    got = {(r["part"], r["entry"], r["step"]): (r["errors"], r["warnings"]) for r in severities}
    count = Counter((f["part"], f["entry"], f["step"], f["severity"]) for f in flags)
    assert got == {(s["part"], s["entry"], s["step"]): (count[s["part"], s["entry"], s["step"], "Error"], count[s["part"], s["entry"], s["step"], "Warning"]) for s in steps}
    by = defaultdict(list)
    for s in steps:
        by[s["part"], s["entry"]].append(s)
    for (_, entry), own in by.items():
        seen = {entry}
        for s in sorted(own, key=lambda s: s["step"]):
            assert s["recursion"] == (s["callee"] in seen) and s["depth"] < 6 and s["step"] < 40
            if s["depth"] < 5:
                seen.add(s["callee"])
