import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from archlake.functions import extract, labels
from archlake.functions.paths import canonical_path
from archlake.functions.shapes import Shapes, render
from archlake.functions.source_text import NUM, REGEX, STR, batch_shingles, tokens
from archlake.operators import calls, dupes, extraction, flows, shapes, trends
from archlake.operators.flows import fragility_summary, step_flags
from archlake.sources.files import line_count, scan_repository
from archlake.sources.snapshots import SnapshotStore
from archlake.streaming.trends_stream import edge_rates, start


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('foo2bar("x") / 2 // c', ["foo", NUM, "(", STR, ")", "/", NUM]), ("a = /re[/]x/g.test(b)", ["a", "=", REGEX, ".", "test", "(", "b", ")"]),
        ("/* c */ 'it\\'s' `a\nb`", [STR, STR]), ("x /* open", ["x", "n"]), ("A_$b 0x1F", ["a_$b", NUM]), ("", []), ("x // y\n/ 2", ["x", "/", NUM]), ("'open", [STR]),
    ],
)
def test_tokens(text, want):
    assert tokens(text) == want


def test_shingles_by_batch():
    texts = ["a b c d e", "", "a b", "a b c d f", "a b c d e"]
    sets = batch_shingles(texts)
    assert [len(s) for s in sets] == [2, 0, 0, 2, 2]
    assert len(np.intersect1d(sets[0], sets[3])) == 1 and (sets[0] == sets[4]).all()


def test_similar_files_are_exact(spark):
    """Classes and their members give brute force's pairs; clusters weigh copies as the pairs they stand for."""
    rng = random.Random(2)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(5):
            c = list(b)
            for _ in range(rng.randrange(12)):
                c[rng.randrange(60)] = f"z{rng.randrange(400)}"
            texts.append(" ".join(c))
    texts += [texts[0]] * 5 + [texts[1] + " // a comment"] * 2 + [None, "", "a b c"]
    rows = [(i, 1 + i % 2, t, "clash") for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows + [(None, 1, texts[0], ""), (500, None, texts[0], ""), rows[3]], "id long, part long, content string, rep string")
    sets = {}
    for i, _, t, _ in rows:
        if t:
            w = tokens(t)
            sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    want, linked = {}, {i: i for i in sets}
    for i, p, t, _ in rows:
        for j, q, u, _ in rows[:i]:
            if p == q and t and u and sets[i] and sets[j]:
                s = np.float32(len(sets[i] & sets[j])) / np.float32(len(sets[i] | sets[j]))
                if s >= np.float32(0.6):
                    want[j, i] = float(s)
    for _ in linked:
        for j, i in want:
            linked[i] = linked[j] = min(linked[i], linked[j])
    similar = dupes.SimilarFiles(files)
    of: dict[int, list[int]] = {}
    for r in similar.members.collect():
        of.setdefault(r["rep"], []).append(r["id"])
    got = {tuple(sorted((x, y))) for r in similar.pairs.collect() for x in of[r["a"]] for y in of[r["b"]]}
    got |= {(x, y) for ids in of.values() for x in ids for y in ids if x < y}
    assert got == set(want) and len(want) > 30
    clusters = dupes.cluster_order(similar.clusters()).collect()
    for c in clusters:
        ids = {i for i, low in linked.items() if low == c["cluster"]}
        inside = [s for (j, _), s in want.items() if j in ids]
        assert c["files"] == len(ids) > 1 and abs(c["similarity"] - sum(inside) / len(inside)) < 0.0051
    for part in (1, 2):
        keys = [(-c["files"], -c["similarity"], c["cluster"]) for c in sorted((c for c in clusters if c["part"] == part), key=lambda c: c["place"])]
        assert keys == sorted(keys)
    assert len(clusters) == len({linked[i] for p in want for i in p})
    assert dupes.report(similar.clusters(), spark.createDataFrame(rows, files.schema)).agg(F.sum("files_analyzed")).first()[0] == len(rows)
    empty = dupes.SimilarFiles(files.limit(0))
    assert empty.pairs.count() == empty.members.count() == empty.clusters().count() == 0


def test_many_copies_make_one_class(spark):
    """Two thousand copies of one file are a class of two thousand members, without a pair of copies."""
    text = " ".join(f"w{i}" for i in range(300))
    files = spark.range(2000).select("id", F.lit(1).cast("long").alias("part"), F.lit(text).alias("content"))
    files = files.union(spark.createDataFrame([(5000, 1, text + " tail")], "id long, part long, content string"))
    similar = dupes.SimilarFiles(files)
    assert [(r["a"], r["b"]) for r in similar.pairs.collect()] == [(0, 5000)]
    assert similar.members.where("rep = 0").count() == 2000
    c = similar.clusters().first()
    assert (c["cluster"], c["files"], c["similarity"]) == (0, 2001, 1.0)


def test_cluster_files_are_sorted(spark):
    rows = spark.createDataFrame([(1, "a", "z.ts"), (1, "a", "b.ts"), (1, "c", "x.ts")], "part long, cluster string, path string")
    assert [(r["path"], r["file_place"]) for r in dupes.cluster_files(rows).orderBy("cluster", "file_place").collect()] == [("b.ts", 1), ("z.ts", 2), ("x.ts", 1)]


def test_scan_gives_every_file_once(spark, tmp_path):
    """More text than one partition's advisory size, at default settings; pruned folders are not read."""
    body = "const a = 1;\n" * 9000
    for i in range(200):
        folder = tmp_path / "repo" / f"src [{i % 7}]" / "x"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i:03d}.ts").write_text(body)
    for name in ("node_modules/p", ".git", "src/dist"):
        (tmp_path / "repo" / name).mkdir(parents=True)
        (tmp_path / "repo" / name / "no.ts").write_text("x")
    (tmp_path / "repo" / "readme.md").write_text("x")
    (tmp_path / "repo" / "bad.js").write_bytes(b"\xff\xfe\xfa")
    found = scan_repository(spark, str(tmp_path / "repo"))
    rows = found.select("id", "path", "loc").collect()
    assert len(rows) == found.count() == 201
    assert [r["path"] for r in sorted(rows, key=lambda r: r["id"])] == sorted(r["path"] for r in rows) and sorted(r["id"] for r in rows) == list(range(201))
    assert {r["loc"] for r in rows} == {0, 9000} and found.where("content is null").select("path").first()[0] == "bad.js"
    assert not any("node_modules" in f or "/dist/" in f for f in found.inputFiles())
    (tmp_path / "empty").mkdir()
    assert scan_repository(spark, str(tmp_path / "empty")).count() == 0


def test_paths_and_lines(spark):
    assert one(spark, canonical_path(F.lit(".\\a\\\\b///c.ts"))) == "a/b/c.ts"
    assert one(spark, canonical_path(F.lit("././a"))) == "./a"
    for text, n in (("a\nb\n", 2), ("a", 1), ("", 0), (None, 0)):
        assert one(spark, line_count(F.lit(text).cast("string"))) == n


@pytest.mark.parametrize("label", ["v1", "v1/fix", "feat: my feature", "sha:abc123", "é*~+%"])
def test_labels_round_trip(spark, label):
    code = one(spark, labels.encode_label(F.lit(label)))
    assert "/" not in code and " " not in code and one(spark, labels.decode_label(F.lit(code))) == label


def test_names(spark):
    for name, words in (("handleSignup", "Handle signup"), ("parseURL_now", "Parse url now"), ("A.b.cDe", "C de"), ("", "")):
        assert one(spark, labels.flow_name(F.lit(name))) == words
    kind = lambda n, p: one(spark, labels.entry_kind(F.lit(n), F.lit(p)))
    assert [kind("main", "src/x.ts"), kind("loginHandler", "a.ts"), kind("handlerFactory", "src/x.ts"), kind("f", "a.ts")] == ["cli", "route", "handler", "exported_entry"]


SOURCE = """import D, { a as b } from './m'; import * as ns from '../n'; import './side';
export * from './y'; const z = require('zed'); const lazy = () => import("./lazy");
export function createUser(name: string, email?: string, ...rest: any[]): Promise<User> { if (a) { foo(1, b(2)); } else bar(); return svc.save(name); }
export const getUser = async (id: number): Promise<User> => { try { load(id); } catch (e) { fail(e); } };
export class UserService { private x = new Map(); async createUser(name: string): User { this.go(name); new X(1); return a ? q() : c(); } }
function outer() { function inner() { foo2(); } bar(); }
"""


def test_extraction():
    x = extract.Text(SOURCE)
    assert extract.imports(x) == [("./m", False), ("../n", False), ("./side", False), ("./y", True), ("zed", False), ("./lazy", False)]
    assert extract.bindings(x) == [("D", "default", "./m"), ("b", "a", "./m"), ("ns", "*", "../n")]
    f = {g["name"]: g for g in extract.functions(x)}
    assert set(f) == {"lazy", "createUser", "getUser", "UserService.createUser", "outer", "inner"}
    assert f["createUser"]["params"] == [("name", "string", False), ("email", "string", True), ("...rest", "any[]", True)]
    assert f["createUser"]["return_type"] == "Promise<User>" and f["createUser"]["exported"] and not f["inner"]["exported"]
    assert f["UserService.createUser"]["is_method"] and f["UserService.createUser"]["exported"]
    called = [c["callee_text"] for c in extract.calls(x, {g["name_at"] for g in f.values()})]
    assert called == ["require", "foo", "b", "bar", "svc.save", "load", "fail", "this.go", "q", "c", "foo2", "bar"] or set(called) >= {"foo", "b", "svc.save", "this.go", "q", "c", "foo2"}
    for bad in ("", "((((", "}}}", "class {", "const x = (", "import {", "function", "a ? b", "`open"):
        y = extract.Text(bad)
        extract.functions(y), extract.calls(y, set()), extract.branches(y), extract.imports(y), extract.bindings(y)


@pytest.mark.parametrize(
    ("annotation", "text"),
    [("string", "string"), ("string[]", "string[]"), ("string | null", "string | null"), ("{ id: number; name?: string }", "{ id: number; name?: string }"),
     ("User", "{ id: number; email?: string }"), ("T", "{ child?: T }"), ("[A, 1]", "[A, 1]"), ("Array<'x'>", "'x'[]"), ("Ext", "Ext"), (None, "unknown"), ("A & B", "A")],
)
def test_shapes(annotation, text):
    assert render(Shapes({"User": ("id: number; email?: string", True), "T": ("{ child?: T }", False)}, {"Ext": None}).of(annotation)) == text


def test_call_graph(spark):
    files = [
        (1, "src/main.ts", "import { run, gone } from './lib'; import * as ns from './lib'; import { deep } from './hub'; import x from 'react';\nexport function main(cfg: any, y) { run(); ns.run(); ns.nope(); deep(); gone(); x(); local(); nowhere(); this.z(); a.b(); }\nfunction local(): Opt { }\ninterface Opt { n: number }"),
        (1, "src/lib.ts", "export function run() { }"), (1, "src/hub.ts", "export { deep } from './deep';"), (1, "src/deep.ts", "export const deep = () => { inner(); };\nfunction inner() {}"),
        (1, "notes.md", "run()"), (1, "src/empty.ts", None),
    ]
    df = spark.createDataFrame(files, "part long, path string, content string")
    g = calls.CallGraph(df, df.select("part", "path"))
    got = {(r["path"], r["callee_text"]): (r["resolution"], r["target_module"]) for r in g.calls.collect()}
    assert got == {
        ("src/main.ts", "run"): ("resolved", "src/lib.ts"), ("src/main.ts", "ns.run"): ("resolved", "src/lib.ts"), ("src/main.ts", "ns.nope"): ("unresolved_imported", None),
        ("src/main.ts", "deep"): ("resolved", "src/deep.ts"), ("src/main.ts", "gone"): ("unresolved_imported", None), ("src/main.ts", "x"): ("external", None),
        ("src/main.ts", "local"): ("resolved", "src/main.ts"), ("src/main.ts", "nowhere"): ("unresolved_local", None), ("src/main.ts", "this.z"): ("method", None),
        ("src/main.ts", "a.b"): ("method", None), ("src/deep.ts", "inner"): ("resolved", "src/deep.ts"),
    }
    c = {(r["path"], r["order"], r["slot"]): (r["text"], r["untyped"], r["missing"]) for r in shapes.contracts(g.facts, g.bindings).collect()}
    assert c["src/main.ts", 0, 0] == ("any", True, False) and c["src/main.ts", 0, 1] == ("unknown", False, True) and c["src/main.ts", 1, -1] == ("{ n: number }", False, False)
    assert g.report().first()["functions"] == 5


def test_calls_are_attributed_by_one_sweep():
    """Equal to looking through all spans for every call, also where spans overlap; a file with very many calls takes seconds."""
    rng = random.Random(7)
    for _ in range(200):
        span = lambda: (a := rng.randrange(60), a + 1 + rng.randrange(30))
        functions = [{"start": a, "end": b} for a, b in sorted(span() for _ in range(rng.randrange(6)))]
        branches = [span() for _ in range(rng.randrange(8))]
        found = [{"start": p} for p in sorted(rng.randrange(80) for _ in range(20))]
        for c in extraction.attribute(found, functions, branches):
            own = max(((f["start"], i) for i, f in enumerate(functions) if f["start"] <= c["start"] < f["end"]), default=None)
            assert c["function"] == (own and own[1])
            f = functions[own[1]] if own else None
            inside = [(b - a, i) for i, (a, b) in enumerate(branches) if f and a <= c["start"] < b and a >= f["start"] and b <= f["end"]]
            assert c["branch"] == (min(inside)[1] if inside else None)
    many = [{"start": 10 * i} for i in range(20_000)]
    began = time.perf_counter()
    out = extraction.attribute(many, [{"start": 100 * i, "end": 100 * i + 90} for i in range(2000)], [(40 * i, 40 * i + 20) for i in range(5000)])
    assert time.perf_counter() - began < 3 and sum(c["function"] is not None for c in out) == 18_000


def test_one_file_with_many_calls(spark):
    text = "\n".join(f"function f{i}(a: number, b) {{ " + " ".join(f"f{(i + k) % 400}({k}, x); if (a) {{ g{k}(); }}" for k in range(25)) + " }" for i in range(400))
    df = spark.createDataFrame([(1, "src/big.ts", text)], "part long, path string, content string")
    g = calls.CallGraph(df, df.select("part", "path"))
    assert g.calls.count() == 20_000 and g.calls.where("branchy").count() == 10_000 and g.calls.where("resolution = 'resolved'").count() == 10_000
    assert shapes.contracts(g.facts, g.bindings).count() == 1200


def test_parameters_beside_arguments(spark):
    files = [(1, "a.ts", "export function go() { take(1, [2, 3]); take(); none(9); }\nfunction take(p: number, q?: any) { }\nfunction none() { }"), (1, "b.ts", "take(1)")]
    df = spark.createDataFrame(files, "part long, path string, content string")
    g = calls.CallGraph(df, df.select("part", "path"))
    rows = shapes.paired_arguments(g.calls, g.functions).orderBy("call_order", "slot").collect()
    assert [(r["call_order"], r["name"], r["optional"], r["argument"]) for r in rows] == [(0, "p", False, "1"), (0, "q", True, "[2, 3]"), (1, "p", False, None), (1, "q", True, None)]


def test_entries_and_declared_features(spark):
    f = [
        (1, 1, "m", "apiRoute", "src/m.ts", True, 1), (1, 2, "m", "plain", "src/m.ts", True, 9), (1, 3, "m", "other", "src/m.ts", True, 8), (1, 4, "m", "third", "src/m.ts", True, 7),
        (1, 5, "n", "Main", "src/n.ts", True, 1), (1, 6, "n", "main", "src/n.ts", True, 1), (1, 7, "n", "quiet", "src/n.ts", True, 0), (1, 8, "t", "x", "src/a.test.ts", True, 3), (1, 9, "n", "own", "src/n.ts", False, 3), (1, 10, "n", "own", "src/n.ts", False, 0),
    ]
    functions = spark.createDataFrame(f, "part long, node long, module string, name string, path string, exported boolean, out_calls long")
    declared = [{"name": "second", "entry": "src/n.ts#own", "kind": "nonsense"}, {"name": "none", "entry": "src/n.ts#gone"}, {"name": "bad", "entry": "src/n.ts"}, {"name": "public", "entry": "src/m.ts#plain", "kind": "public_api"}, {"name": "again", "entry": "src/m.ts#plain", "kind": "cli"}, {}]
    d = flows.declared_entries(flows.feature_table(spark, declared), functions)
    got = [(r["node"], r["kind"], r["declared"], r["feature_name"]) for r in flows.entry_points(functions, d).orderBy("rank").collect()]
    assert got == [
        (9, "exported_entry", True, "second"), (2, "public_api", True, "public"), (1, "route", False, None), (6, "cli", False, None),
        (3, "exported_entry", False, None), (4, "exported_entry", False, None), (5, "exported_entry", False, None),
    ]
    alone = [r["node"] for r in flows.entry_points(functions).orderBy("rank").collect()]
    assert alone == [1, 6, 2, 3, 5]  # three of a module
    assert flows.entry_points(functions.limit(0), d.limit(0)).count() == 0


def test_flow_by_id(spark):
    s = spark.createDataFrame([(1, 7, 70), (1, 8, 80)], "part long, node long, flow_id long")
    steps = spark.createDataFrame([(1, 7, 0), (1, 8, 0), (1, 8, 1)], "part long, entry long, step long")
    one, own = flows.find_flow(s, steps, 80)
    assert [r["node"] for r in one.collect()] == [8] and own.count() == 2 and flows.find_flow(s, steps, 1)[0].count() == 0


def test_baselines(spark):
    p = spark.createDataFrame([("a", 3, 1, "x"), ("a", 4, 2, "y"), ("a", 5, 3, "y"), ("b", 6, 1, None), ("c", 7, None, "z"), ("c", 8, 1, "w")], "repo string, snapshot_id long, saved_at long, label string")
    b = spark.createDataFrame([("a", "y"), ("c", "gone")], "repo string, label string")
    assert {tuple(r) for r in trends.baseline_positions(p, b).collect()} == {("a", 1), ("b", -1), ("c", -1)}
    assert {tuple(r) for r in trends.default_from(p, b).collect()} == {("a", "y"), ("b", ""), ("c", "gone")}
    asked = spark.createDataFrame([("a", "x")], "repo string, label string")
    assert {tuple(r) for r in trends.default_from(p, b.limit(0), asked).collect()} == {("a", "x"), ("b", ""), ("c", "z")}
    assert trends.baseline_positions(p.limit(0), b).count() == trends.default_from(p.limit(0), b).count() == 0


def test_fragility(spark):
    steps = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 1, 1, 2)], "part long, entry long, step int, caller long, callee long")
    nodes = spark.createDataFrame([(1, 0, "a", 0, 2, 0.1), (1, 1, "b", 0, 2, 0.765), (1, 2, "c", 2, 1, None)], "part long, node long, path string, scc_id long, scc_size long, instability double")
    bad = spark.createDataFrame([(1, "b", "c")], "part long, from_path string, to_path string")
    new = spark.createDataFrame([(1, "c")], "part long, path string")
    kinds = spark.createDataFrame([(1, 1, 0, "p", True, False), (1, 1, 1, "q", False, True), (1, 1, -1, "return", True, False)], "part long, node long, slot int, name string, untyped boolean, missing boolean")
    flagged = step_flags(steps, nodes, bad, new, kinds)
    got = {r["step"]: [f["code"] for f in r["flags"]] for r in flagged.collect()}
    assert got == {0: ["scc_cycle", "high_instability", "any_payload", "untyped_boundary", "any_return"], 1: ["violation", "churn_callee"]}
    s = fragility_summary(flagged).first()
    assert (s["steps"], s["fragile_steps"], s["max_severity"], s["type_flags"], s["fragile_percent"]) == (2, 2, "Error", 3, 100)


def test_type_flags_of_function_flows(spark, tmp_path):
    """The registered walk over functions gives the three type flags; the walks over modules have none."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from archlake.plans import registry
    from tests.helpers import DATA

    for name in os.listdir(DATA):
        if name != "source_files.parquet":
            os.symlink(f"{DATA}/{name}", tmp_path / name)
    files = pq.read_table(f"{DATA}/source_files.parquet")
    row = next(r for r in files.slice(0, 100).to_pylist() if r["report_id"] is not None)
    row |= {"file_id": 10**9, "path": "src/zz.ts", "content": "export function begin() { take(1, 2); }\nfunction take(p: any, q): any { }"}
    pq.write_table(pa.concat_tables([files, pa.Table.from_pylist([row], files.schema)]), tmp_path / "source_files.parquet")
    flags = registry.QUERIES["function_fragility_flags"](spark, str(tmp_path)).where("source = 'type'")
    assert [r["code"] for r in flags.collect()] == ["any_payload", "untyped_boundary", "any_return"]


def test_scan_and_store(spark, tmp_path):
    root = tmp_path / "repo"
    for p, text in (("src/a.ts", b"x\n"), ("src/b.js", b"\xff\xfe"), ("node_modules/z.ts", b""), ("readme.md", b"")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(text)
    got = {r["path"]: (r["id"], r["loc"]) for r in scan_repository(spark, str(root)).collect()}
    assert got == {"src/a.ts": (0, 1), "src/b.js": (1, 0)}
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.baseline() is None and store.load("v1/x", "t") is None
    store.save("v1/x", t=spark.range(3))
    assert store.load("v1/x", "t").count() == 3 and [r["label"] for r in store.list().collect()] == ["v1/x"] and store.baseline() == "v1/x"
    store.set_baseline("v1/x")
    with pytest.raises(KeyError):
        store.set_baseline("unknown")


def test_json_export_and_load(spark, tmp_path):
    """A table exported as JSON is read back by its path in place of a label; an unknown path is an unknown label."""
    store = SnapshotStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "src/a.ts", None), (2, None, "x")], "id long, path string, sha string")
    store.export_json(rows, str(tmp_path / "out.json"))
    back = store.load(str(tmp_path / "out.json"), "anything")
    assert {(r["id"], r["path"], r["sha"]) for r in back.collect()} == {(1, "src/a.ts", None), (2, None, "x")}
    assert store.load(str(tmp_path / "gone.json"), "anything") is None


def test_workdir_point(spark):
    """The working directory's point joins the stored ones unless one of them is already labelled so."""
    stored = spark.createDataFrame([(1, "v1", 5), (2, None, 6)], "snapshot_id long, label string, file_count long")
    work = spark.createDataFrame([("workdir", 7)], "label string, file_count long")
    assert {tuple(r) for r in trends.with_workdir(stored, work).collect()} == {(1, "v1", 5), (2, None, 6), (None, "workdir", 7)}
    twice = trends.with_workdir(stored.union(spark.createDataFrame([(3, "workdir", 1)], stored.schema)), work)
    assert twice.where("label = 'workdir'").count() == 1 and twice.count() == 3
    assert trends.with_workdir(stored.limit(0), work).count() == 1


@pytest.mark.parametrize(("given", "used"), [(None, 0.6), (0.0, 0.1), (0.7, 0.7), (5, 1.0), (-1, 0.1)])
def test_thresholds_are_clamped(given, used):
    assert dupes.clamp_threshold(given) == used


def test_time_helpers(spark):
    t = F.timestamp_seconds(F.lit(1_700_000_000.9))
    assert one(spark, labels.unix_seconds(t)) == 1_700_000_000 and one(spark, labels.seen_label(t)) == "seen_1700000000"
    assert one(spark, labels.seen_label(F.lit(None).cast("timestamp"))) is None


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2025-01-01' + make_interval(0,0,0,cast(id % 5 as int)) as scanned_at, if(id % 2 = 0, ' Imports', 'reexports') as kind from range(50)")
    late = spark.sql("select timestamp'2026-01-01' as scanned_at, 'imports' as kind")
    rows.union(late).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = start(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in edge_rates(rows).collect()}
    assert want <= got
