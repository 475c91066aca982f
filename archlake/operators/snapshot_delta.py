"""What changed between full snapshots (problem 3).

A snapshot is reduced to an index: one slim row per key with one hash per compared
value. The index is kept as a table bucketed by key, so that probing it with the
rows of the next snapshot, bucketed alike as they are written, is a join of equal
buckets without a shuffle. Only the keys that the probe reports fetch their old and
new values; then the new rows' index takes the place of the old one.

``SnapshotIndex`` is the operator. ``history_delta`` runs a whole history of
deliveries through it, the first of every repository, then the second, and so on.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlake.functions.paths import canonical_path
from archlake.session import Scratch
from archlake.sources.tables import current_module_ids, deliveries

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def hash64(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def probe(
    last: DataFrame,
    new: DataFrame,
    keys: list[str],
    values: list[str] = (),
    ignore_null: tuple[str, ...] = (),
) -> DataFrame:
    """Full outer probe of the index ``last`` with the rows ``new``.

    Both hold ``keys`` (one row per key) and the hash columns ``values``. Returns
    ``keys`` and delta: ``added`` (only in new), ``removed`` (only in last) or
    ``changed`` (in both, some value differs). Values compare null-safe, but a
    value named in ``ignore_null`` differs only if both sides are given. Null
    keys never match and are dropped. Other columns of the inputs are ignored, so
    names that clash don't matter; an empty side gives all rows of the other.
    """
    given = [F.col(k).isNotNull() for k in keys]
    cond = given[0]
    for c in given[1:]:
        cond = cond & c
    old = last.where(cond).select(*keys, *[F.col(v).alias(f"__old_{v}") for v in values], F.lit(True).alias("__old"))
    now = new.where(cond).select(*keys, *[F.col(v).alias(f"__new_{v}") for v in values], F.lit(True).alias("__new"))
    differs = F.lit(False)
    for v in values:
        a, b = F.col(f"__old_{v}"), F.col(f"__new_{v}")
        differs = differs | (F.coalesce(a != b, F.lit(False)) if v in ignore_null else ~a.eqNullSafe(b))
    delta = (
        F.when(F.col("__old").isNull(), ADDED).when(F.col("__new").isNull(), REMOVED).when(differs, CHANGED)
    )
    return old.join(now, keys, "full_outer").select(*keys, delta.alias("delta")).where("delta is not null")


class SnapshotIndex:
    """The stored index of the last snapshot of one or many streams, bucketed by key.

    ``advance(rows)`` probes the index with a new full snapshot, returns the deltas
    and swaps: the new rows' index is written beside the old one and comes into
    force by creating its number in the folder ``current``, one atomic step, so a run
    that dies leaves the old index in force; then the old one is removed.

    ``keys`` and ``values`` are columns of the rows. Keys are compared themselves,
    values by a 64-bit hash; a value named in ``ignore_null`` differs only where both
    sides are given. Rows with a null key are left out; repeated keys count once,
    with the largest of each hash. With ``keep_rows`` the rows are kept beside the
    index, one per key, and deltas carry old_row and new_row. ``stream`` names the key
    column that tells streams apart (see ``advance``).
    """

    def __init__(
        self, spark: SparkSession, folder: str, keys: list[str], values: list[str], ignore_null: tuple[str, ...] = (), stream: str | None = None, buckets: int = 64, keep_rows: bool = True
    ):
        self.spark, self.folder, self.keys, self.values, self.stream, self.buckets, self.keep_rows = spark, folder.rstrip("/"), keys, values, stream, buckets, keep_rows
        self.ignore_null = tuple(f"h_{v}" for v in ignore_null)
        self.label = "archlake_" + hashlib.md5(self.folder.encode()).hexdigest()[:16]

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        fs, path = self._fs()
        pointer = path(f"{self.folder}/current")
        if not fs.exists(pointer):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(pointer)), default=0)

    def _place(self, version: int, kind: str) -> tuple[str, str]:
        return f"{self.label}_{kind}_{version}", f"{self.folder}/v={version}/{kind}"

    def _write(self, df: DataFrame, version: int, kind: str) -> DataFrame:
        name, path = self._place(version, kind)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        df.write.mode("overwrite").format("parquet").bucketBy(self.buckets, *self.keys).option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def _read(self, version: int, kind: str) -> DataFrame:
        """A stored table with its buckets; a session that has not seen it yet is told about them."""
        name, path = self._place(version, kind)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            by = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _remove(self, version: int) -> None:
        fs, path = self._fs()
        for kind in ("index", "rows"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._place(version, kind)[0]}")
        fs.delete(path(f"{self.folder}/v={version}"), True)

    def advance(self, rows: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
        """The keys and delta (added, removed, changed) of a new snapshot, written; then the swap.

        ``delivered`` (the stream column): streams that this delivery holds in full;
        the others have no deltas and leave the index. Without it, all of them.
        """
        v = self.version()
        fs, path = self._fs()
        given = rows.dropna(subset=self.keys)
        hashed = [F.when(F.col(c).isNotNull(), hash64(F.col(c))).alias(f"h_{c}") for c in self.values]
        slim = given.select(*self.keys, *hashed).groupBy(*self.keys)
        hashes = [f"h_{c}" for c in self.values]
        new = self._write(slim.agg(*[F.max(h).alias(h) for h in hashes]) if hashes else given.select(*self.keys).distinct(), v + 1, "index")
        last = self._read(v, "index") if v else new.limit(0)
        if delivered is not None:
            last = last.join(F.broadcast(delivered.select(self.stream).distinct()), self.stream, "left_semi")  # one row per stream
        deltas = probe(last, new, self.keys, hashes, self.ignore_null)
        if self.keep_rows:
            named = [f"r_{c}" for c in rows.columns]
            one = given.groupBy(*[F.col(k) for k in self.keys]).agg(F.max(F.struct(*[F.col(c).alias(n) for c, n in zip(rows.columns, named)])).alias("row"))
            now = self._write(one, v + 1, "rows")
            before = self._read(v, "rows") if v else now.limit(0)
            deltas = deltas.join(before.withColumnRenamed("row", "old_row"), self.keys, "left").join(now.withColumnRenamed("row", "new_row"), self.keys, "left")
        out = f"{self.folder}/deltas/number={v + 1}"
        deltas.write.mode("overwrite").parquet(out)
        fs.mkdirs(path(f"{self.folder}/current/{v + 1}"))  # the swap
        if v:
            self._remove(v)
        return self.spark.read.schema(deltas.schema).parquet(out)

    def close(self) -> None:
        """Removes the index; deltas stay."""
        self._remove(self.version())


def module_index(modules: DataFrame, seed: int = 0) -> DataFrame:
    """snapshot_id, id, path_hash, sha (case-free, nullable) and exports (set) hashes of current modules."""
    return current_module_ids(
        modules.select(
            "snapshot_id", "id", "path", "scanned_at",
            F.when(F.col("content_sha").isNotNull(), hash64(F.lower("content_sha"))).alias("sha"),
            hash64(F.array_sort(F.array_distinct(F.coalesce(F.array_compact("exports"), F.array().cast("array<string>"))))).alias("exp"),
        ),
        "sha", "exp", seed=seed,
    )


def path_names(modules: DataFrame, scratch: Scratch) -> tuple[int, DataFrame]:
    """A seed under which no two paths share their 64-bit hash, and path_hash, path of all paths ever delivered."""
    paths = modules.select(canonical_path("path").alias("path")).where("path is not null").distinct()
    for seed in range(8):
        names = scratch.write(paths.select(F.xxhash64(F.lit(seed), "path").alias("path_hash"), "path"), "names")
        if names.groupBy("path_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return seed, names
        scratch.drop(names)
    raise RuntimeError("hashes of paths collide")


def numbered_deliveries(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, repo (the repository's smallest snapshot id) and step of every delivered snapshot."""
    first = F.min("snapshot_id").over(Window.partitionBy("repo"))
    return deliveries(snapshots).select("snapshot_id", first.alias("repo"), "step")


def history_delta(snapshots: DataFrame, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """snapshot_id, entity, path, to_path, delta between every snapshot and its predecessor.

    Modules: key is the canonical path; changed if both shas are given and differ
    beyond case, or the export sets differ (null is the empty set). Edges: key is
    the pair of module paths; kind, specifier and repetition don't matter; edges
    with a null end or an end outside the snapshot's modules are left out. The
    first snapshot of a repository has no rows; a snapshot without rows removes
    everything of the one before. Modules of unknown snapshots are ignored.

    One index holds both: its keys are a repository, a path (by a hash without
    collisions) and, for edges, a second path. Each delivery is written once,
    bucketed; paths are fetched for changes alone.
    """
    spark = modules.sparkSession
    scratch = Scratch(spark, "delta")
    steps = scratch.write(numbered_deliveries(snapshots), "steps")
    seed, names = path_names(modules, scratch)
    ends = scratch.write(module_index(modules, seed).join(steps, "snapshot_id"), "modules")
    own = ends.select("snapshot_id", "id", "path_hash")
    # both joins sit right above an exchange, so a from_id or to_id that holds much of a snapshot is split there
    pairs = (
        edges.where("snapshot_id is not null and from_id is not null and to_id is not null")
        .select("snapshot_id", "from_id", "to_id")
        .join(own.select("snapshot_id", F.col("id").alias("from_id"), F.col("path_hash").alias("a")), ["snapshot_id", "from_id"])
        .join(ends.select("snapshot_id", "repo", "step", F.col("id").alias("to_id"), F.col("path_hash").alias("b")), ["snapshot_id", "to_id"])
        .select("repo", "a", "b", F.lit(None).cast("long").alias("sha"), F.lit(None).cast("long").alias("exp"), F.lit(True).alias("edge"), "step")
    )
    own_rows = ends.select("repo", F.col("path_hash").alias("a"), F.lit(0).cast("long").alias("b"), "sha", "exp", F.lit(False).alias("edge"), "step")
    prepared = scratch.write_by(own_rows.unionByName(pairs), "step", "rows")
    scratch.drop(ends)

    folder = scratch.folder("index")
    index = SnapshotIndex(spark, folder, ["repo", "edge", "a", "b"], ["sha", "exp"], ("sha",), "repo", int(spark.conf.get("spark.sql.shuffle.partitions")), keep_rows=False)
    last = steps.agg(F.max("step")).first()[0] or 0
    out = None
    for step in range(1, last + 1):
        now = steps.where(F.col("step") == step)
        found = index.advance(prepared.where(F.col("step") == step), now)
        if step > 1:
            named = found.join(F.broadcast(now.select("repo", "snapshot_id")), "repo")  # one row per repository
            out = named if out is None else out.unionByName(named)
    if last:
        index.close()
    if out is None:
        return spark.createDataFrame([], "snapshot_id long, entity string, path string, to_path string, delta string")
    first = names.select(F.col("path_hash").alias("a"), "path")
    out_modules = out.where("not edge").join(first, "a").select("snapshot_id", F.lit("module").alias("entity"), "path", F.lit("").alias("to_path"), "delta")
    out_edges = (
        out.where("edge").join(first, "a")
        .join(names.select(F.col("path_hash").alias("b"), F.col("path").alias("to_path")), "b")
        .select("snapshot_id", F.lit("edge").alias("entity"), "path", "to_path", "delta")
    )
    return out_modules.unionByName(out_edges)


def module_changes(snapshots: DataFrame, modules: DataFrame) -> DataFrame:
    """snapshot_id, path, delta of the modules added or removed since the snapshot before, all snapshots in one pass."""
    steps = deliveries(snapshots).where("previous_id is not null")
    paths = modules.where("id is not null").select("snapshot_id", canonical_path("path").alias("path")).where("path is not null").distinct()
    last = paths.join(steps.select(F.col("previous_id").alias("snapshot_id"), F.col("snapshot_id").alias("next_id")), "snapshot_id")
    new = paths.join(steps.select("snapshot_id"), "snapshot_id")
    return probe(last.select(F.col("next_id").alias("snapshot_id"), "path"), new, ["snapshot_id", "path"])
