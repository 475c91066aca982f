"""Problems 3 and 4 on small tables: nulls, repeats, ties, empty tables, clashing columns."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from archlake.operators.balanced import balanced_counts, fan_in_mismatches, pack, plan_load
from archlake.operators.snapshot_delta import SnapshotIndex, history_delta, module_changes, probe

T = dt.datetime(2025, 1, 1)
S = "snapshot_id long, repo_root string, commit_sha string, snapshot_label string, saved_at timestamp, extra string"
M = "snapshot_id long, id long, path string, exports array<string>, content_sha string, scanned_at timestamp, bucket string, delta string"
E = "snapshot_id long, from_id long, to_id long, kind string, specifier string, scanned_at timestamp, bucket string"


def day(n):
    return T + dt.timedelta(days=n)


def tables(spark):
    snapshots = spark.createDataFrame(
        [(10, "/r/a/", "x", None, day(1), "e"), (3, "/r/a", "x", "l", day(2), "e"), (3, "/r/a/", "x", "l", day(2), "e"), (7, "/r/a", None, None, day(3), None), (8, "/r/b", None, None, day(1), None)], S
    )
    modules = spark.createDataFrame(
        [
            (10, 0, "src//a.ts", ["x", "y"], "AB", day(1), "b", "d"), (10, 1, "./src/b.ts", None, None, day(1), "b", "d"), (10, 2, "src\\c.ts", [], "cc", day(1), None, None),
            (3, 5, "src/a.ts", ["y", "x", "x"], "ab", day(2), None, None), (3, 6, "src/b.ts", [], "zz", day(2), None, None), (3, 6, "src/b.ts", ["old"], "zz", day(0), None, None),
            (3, 7, "src/d.ts", None, "d1", None, None, None), (3, 7, "src/d.ts", None, "d2", day(2), None, None), (3, 9, None, None, None, day(2), None, None), (None, 9, "src/x.ts", None, None, day(2), None, None),
            (8, 1, "src/a.ts", None, None, day(1), None, None), (99, 1, "src/zz.ts", None, None, day(1), None, None),
        ], M,
    )
    edges = spark.createDataFrame(
        [
            (10, 0, 1, "Imports", "./b", day(1), "b"), (10, 0, 1, "Reexports", "./b", day(1), None), (10, 0, 2, "Imports", "./c", day(1), None), (10, 0, 77, "Imports", "?", day(1), None), (10, None, 1, "Imports", "?", day(1), None),
            (3, 5, 6, " reexports", "./b", day(2), None), (3, 6, 5, None, None, day(2), None), (3, 6, 5, None, None, day(2), None),
        ], E,
    )
    return snapshots, modules, edges


def test_history(spark):
    got = {tuple(r) for r in history_delta(*tables(spark)).collect()}
    assert got == {
        (3, "module", "src/c.ts", "", "removed"), (3, "module", "src/d.ts", "", "added"),
        (3, "edge", "src/a.ts", "src/c.ts", "removed"), (3, "edge", "src/b.ts", "src/a.ts", "added"),
        (7, "module", "src/a.ts", "", "removed"), (7, "module", "src/b.ts", "", "removed"), (7, "module", "src/d.ts", "", "removed"),
        (7, "edge", "src/a.ts", "src/b.ts", "removed"), (7, "edge", "src/b.ts", "src/a.ts", "removed"),
    }


def test_module_changes(spark):
    s, m, _ = tables(spark)
    got = {tuple(r) for r in module_changes(s, m).collect()}
    assert got == {(3, "src/c.ts", "removed"), (3, "src/d.ts", "added"), *((7, f"src/{x}.ts", "removed") for x in "abd")}


def test_history_empty(spark):
    s, m, e = (t.limit(0) for t in tables(spark))
    assert history_delta(s, m, e).collect() == []


def test_probe_null_rules(spark):
    last = spark.createDataFrame([(1, 5, None), (2, 5, 5), (3, None, 5), (None, 1, 1)], "k long, v long, w long")
    new = spark.createDataFrame([(1, 6, 9), (2, 5, None), (4, 1, 1)], "k long, v long, w long")
    assert {tuple(r) for r in probe(last, new, ["k"], ["v", "w"], ignore_null=("w",)).collect()} == {(1, "changed"), (3, "removed"), (4, "added")}
    assert {tuple(r) for r in probe(last, new, ["k"], ["w"]).collect()} == {(1, "changed"), (2, "changed"), (3, "removed"), (4, "added")}


def test_index_swaps(spark, tmp_path):
    make = lambda: SnapshotIndex(spark, str(tmp_path / "i"), ["key"], ["value"], buckets=4)
    t = lambda rows: spark.createDataFrame(rows, "key string, value long, old_row string")
    index = make()
    first = index.advance(t([("a", 1, "x"), ("b", None, "y"), ("b", 2, "y"), (None, 1, "z")]))
    assert {(r["delta"], r["new_row"]["r_key"]) for r in first.collect()} == {("added", "a"), ("added", "b")}
    second = index.advance(t([("a", 1, "other"), ("b", 3, "y"), ("c", 1, None)]))
    assert {(r["delta"], r["old_row"] and r["old_row"]["r_value"], r["new_row"]["r_value"]) for r in second.collect()} == {("changed", 2, 3), ("added", None, 1)}
    for kind in ("index", "rows"):  # a later session knows nothing of the tables
        spark.sql(f"DROP TABLE {index._place(2, kind)[0]}")
    third = make().advance(t([("a", 1, None)]))
    assert {(r["delta"], r["old_row"]["r_key"]) for r in third.collect()} == {("removed", "b"), ("removed", "c")}
    assert index.version() == 3 and not (tmp_path / "i" / "v=2").exists()
    assert index.advance(t([]).limit(0)).select("key", "delta").collect() == [("a", "removed")]


def test_index_of_streams(spark, tmp_path):
    index = SnapshotIndex(spark, str(tmp_path / "i"), ["repo", "key"], ["value"], stream="repo", buckets=4, keep_rows=False)
    t = lambda rows: spark.createDataFrame(rows, "repo long, key string, value long, delta string")
    index.advance(t([(1, "a", 1, ""), (2, "a", 1, ""), (3, "a", 1, "")]))
    got = index.advance(t([(1, "a", 2, "")]), spark.createDataFrame([(1,), (3,)], "repo long"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", "changed"), (3, "a", "removed")}


def test_probe_of_the_index_needs_no_shuffle(spark, tmp_path):
    index = SnapshotIndex(spark, str(tmp_path / "i"), ["key"], ["value"], buckets=4, keep_rows=False)
    t = lambda n: spark.range(n).select(F.col("id").alias("key"), (F.col("id") % n).alias("value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.advance(t(100))
        new = index._write(index._read(1, "index"), 2, "index")
        plan = probe(index._read(1, "index"), new, ["key"], ["h_value"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_fan_in(spark):
    _, modules, edges = tables(spark)
    metrics = spark.createDataFrame([(10, 1, 2), (10, 1, 2), (10, 1, 5), (10, 2, 1), (10, 0, 0), (3, 5, 2), (3, 6, None), (3, 7, 1), (None, 1, 1)], "snapshot_id long, id long, fan_in long")
    assert {tuple(r) for r in fan_in_mismatches(modules, edges, metrics).collect()} == {(10, 1), (3, 5), (3, 7)}
    assert fan_in_mismatches(modules, edges.limit(0), metrics.where("fan_in = 0")).collect() == []
    assert fan_in_mismatches(modules, edges, metrics.limit(0)).collect() == []


def test_hot_source_and_hot_copy(spark):
    """One module importing a third of all, and one edge delivered over and over, among small joins split as skewed."""
    s = spark.createDataFrame([(1, "/r", None, None, day(1), None), (2, "/r", None, None, day(2), None)], S)
    m = spark.createDataFrame([(k, i, f"m{i}", None, None, day(1), None, None) for k in (1, 2) for i in range(300)], M)
    rng = [(k, 0, i, "Imports", "x", day(1), None) for k in (1, 2) for i in range(300 - k)] + [(1, 5, 6, "Imports", "x", day(1), None)] * 400 + [(2, i, 7, "Imports", str(i), day(1), None) for i in range(300)]
    e = spark.createDataFrame(rng, E)
    metrics = spark.createDataFrame([(1, 6, 2), (1, 7, 2), (2, 7, 300), (2, 299, 0), (2, 8, 1)], "snapshot_id long, id long, fan_in long")
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = Counter(tuple(r)[1:] for r in history_delta(s, m, e).collect())
        wrong = {tuple(r) for r in fan_in_mismatches(m, e, metrics).collect()}
    finally:
        for k in keys:
            spark.conf.unset(k)
    pairs = lambda k: {(f, t) for x, f, t, *_ in rng if x == k}
    want = [("edge", f"m{f}", f"m{t}", "added") for f, t in pairs(2) - pairs(1)] + [("edge", f"m{f}", f"m{t}", "removed") for f, t in pairs(1) - pairs(2)]
    assert got == Counter(want)
    assert wrong == {(1, 7)}


def test_hot_key_is_spread(spark):
    rows = spark.range(6000).selectExpr("cast(if(id % 3 = 0, 0, id) as long) as k", "id % 700 as v", "'x' as bucket")
    plan = plan_load(rows, ["k"], tasks=8)
    assert len(plan.heavy) == 1 and len(plan.heavy[0][-1]) > 1
    assert max(plan.loads) < 1.3 * sum(plan.loads) / 8
    match = rows.select("k").distinct().union(spark.createDataFrame([(-1,), (None,)], "k long"))
    got = {r["k"]: r["n"] for r in balanced_counts(rows, match, ["k"], ["v"], tasks=8).collect()}
    want = Counter(k for k, _ in {(0 if i % 3 == 0 else i, i % 700) for i in range(6000)})
    assert got == {**want, -1: 0, None: 0}


def test_pack_balances():
    where, loads = pack([(9, "a"), (5, "b"), (5, "c"), (1, "d")], 2)
    assert sorted(loads) == [10, 10] and len(where) == 4
