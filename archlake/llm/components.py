"""Consolidating pairwise matches into groups (problem 1).

Low-diameter decomposition: every record draws an exponentially distributed head
start, clusters grow from the records whose turn comes first and reach one hop
further per unit of time; each cluster contracts to one super-record, and the same
is done with the links that remain between clusters. The assignments of all levels
composed give every record its group.

Growth is computed round by round: a record passes on the earliest arrival it has
seen, and only records whose arrival improved in the round before do so. Head
starts are not capped: a cluster is as deep as they make it, about ``log(n) / beta``
hops at most, where ``beta`` is the rate of the distribution. Once fewer records
than a small share of the links still improve (ends of long chains, as a rule),
they keep the centre they have, and their last links are left to the next level. A
link stays between clusters with a probability of about ``1 - exp(-beta)``; the rate
is halved from level to level, as contraction makes the graph shallower, so the
links that remain vanish faster than geometrically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlake.functions.paths import canonical_path
from archlake.session import Scratch

DEFAULT_THRESHOLD = 0.60
#: one hop in the fixed-point numbers that times are kept in
HOP = 1 << 32
#: rounds of growth planned as one job; the shuffled links are shared among them
ROUNDS = 3
#: links of one record that a task takes at least; more are split if they exceed its share
HOT = 100_000
#: share of the links below which records that still improve are left to the next level
SETTLED = 0.05


def _start(v: Column, level: int, beta: float) -> Column:
    """The time at which ``v`` begins a cluster of its own: zero minus its head start."""
    u = (F.pmod(F.xxhash64(v, F.lit(level)), F.lit(1 << 40)) + F.lit(1.0)) / F.lit(float((1 << 40) + 1))
    return (F.log(u) * F.lit(HOP / beta)).cast("long")


def _arrive(df: DataFrame) -> DataFrame:
    """v, centre, at and fresh: the earliest arrival at every record, and whether it is earlier than ``was``."""
    first = df.groupBy("v").agg(F.min_by("centre", "at").alias("centre"), F.min("at").alias("at"), F.min("was").alias("was"))
    return first.select("v", "centre", "at", (F.col("at") < F.col("was")).alias("fresh"))


def _shards(both: DataFrame, total: int, hot: int) -> DataFrame | None:
    """v, shards of records with so many links that a task would wait for them: at most 4 a task. None without any."""
    limit = max(hot, total // (4 * int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if total <= limit:
        return None
    found = both.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).collect()
    return both.sparkSession.createDataFrame([(r["v"], -(-r["n"] // limit)) for r in found], "v long, shards int") if found else None


def _grow(links: DataFrame, total: int, level: int, beta: float, hot: int, scratch: Scratch) -> DataFrame:
    """v, centre: the cluster that reaches every linked record first."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("to")).union(links.select("b", "a"))
    shards = _shards(both, 2 * total, hot)
    # the first round needs no shuffle of its own: both ends of a link know each other's start
    own, other = _start(F.col("v"), level, beta), _start(F.col("to"), level, beta) + HOP
    nearer = both.select("v", F.when(other < own, F.col("to")).otherwise(F.col("v")).alias("centre"), F.least(own, other).alias("at"), own.alias("was"))
    reached, moved = scratch.write_counting(_arrive(nearer), "reached", fresh=F.col("fresh"))
    if shards is not None:
        both = both.join(F.broadcast(shards), "v", "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("to"), "shards"), F.lit(0)).cast("int"))

    def pass_on(fresh: DataFrame) -> DataFrame:
        if shards is None:
            return both.join(fresh, "v")
        copies = fresh.join(F.broadcast(shards), "v", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)))
        return both.drop("shards").join(copies.drop("shards"), ["v", "shard"])

    while moved["fresh"] > SETTLED * total:
        now = reached
        for _ in range(ROUNDS):
            sent = pass_on(now.where("fresh")).select(F.col("to").alias("v"), "centre", (F.col("at") + HOP).alias("at"), F.lit(None).cast("long").alias("was"))
            now = _arrive(now.select("v", "centre", "at", F.col("at").alias("was")).unionByName(sent))
        later, moved = scratch.write_counting(now, "reached", fresh=F.col("fresh"))
        scratch.drop(reached)
        reached = later
    return reached.select("v", "centre")


def connected_groups(links: DataFrame, beta: float = 0.6, hot: int = HOT) -> DataFrame:
    """v, root for every record of ``links`` (a, b: bigint); equal roots mean linked directly or indirectly.

    Self links and repeats are ignored, links with a null end too; no links give
    no rows. Each level is written to the session's shared folder. A record with
    more links than ``hot`` and than a quarter of a task's share has them split over
    tasks while clusters grow; a cluster or group that holds much of all records is
    split by the adaptive skew join, as both sides of those joins are plain shuffles.
    """
    scratch = Scratch(links.sparkSession, "groups")
    one = F.lit(1)
    now, left = scratch.write_counting(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", n=one
    )
    levels: list[DataFrame] = []
    while left["n"]:
        grown = _grow(now, left["n"], len(levels), beta / 2 ** len(levels), hot, scratch)
        levels.append(grown)
        ends = now.join(grown.select(F.col("v").alias("a"), F.col("centre").alias("ca")), "a").join(
            grown.select(F.col("v").alias("b"), F.col("centre").alias("cb")), "b"
        )
        between = ends.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        later, left = scratch.write_counting(between, "links", n=one)
        scratch.drop(now)
        now = later
    if not levels:
        return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = levels[-1].select("v", F.col("centre").alias("root"))
    for lower in reversed(levels[:-1]):
        upper = roots.select(F.col("v").alias("centre"), "root")
        roots = lower.join(upper, "centre", "left").select("v", F.coalesce("root", "centre").alias("root"))
    return roots


def accepted_pairs(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """report_id, pa, pb (canonical, pa < pb) and similarity of the pairs that link.

    A row links if both files are given and similarity is at least the report's
    threshold (null: 0.60). Rows of unknown reports, self pairs, null and NaN
    scores don't. Of repeated pairs the highest similarity is kept.
    """
    limits = reports.select("report_id", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD).cast("float")).alias("t"))
    a, b = canonical_path("file_a"), canonical_path("file_b")
    return (
        pairs.select("report_id", F.col("similarity").cast("float").alias("similarity"), F.least(a, b).alias("pa"), F.greatest(a, b).alias("pb"), (a.isNotNull() & b.isNotNull()).alias("ok"))
        .where("ok and pa <> pb and similarity is not null and not isnan(similarity)")
        .join(limits, "report_id")
        .where("similarity >= t")
        .groupBy("report_id", "pa", "pb")
        .agg(F.max("similarity").alias("similarity"))
    )


def file_groups(reports: DataFrame, pairs: DataFrame, beta: float = 0.6) -> DataFrame:
    """report_id, path, group_path: every linked file with the smallest path (by bytes) of its group.

    Files are numbered by a 64-bit hash of (report, path); a collision is looked
    for and answered with another seed, so groups never mix by accident.
    """
    scratch = Scratch(pairs.sparkSession, "files")
    linked = scratch.write(accepted_pairs(reports, pairs).select("report_id", "pa", "pb"), "pairs")
    for seed in range(8):
        numbered = linked.withColumns({"a": F.xxhash64(F.lit(seed), "report_id", "pa"), "b": F.xxhash64(F.lit(seed), "report_id", "pb")})
        files = scratch.write(
            numbered.select(F.col("a").alias("v"), "report_id", F.col("pa").alias("path"))
            .unionByName(numbered.select(F.col("b").alias("v"), "report_id", F.col("pb").alias("path")))
            .distinct(),
            "files",
        )
        if files.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("hashes of files collide")
    members = scratch.write(files.join(connected_groups(numbered.select("a", "b"), beta), "v"), "members")
    # written first: an aggregation right below the join would keep a giant group from being split
    names = scratch.write(members.groupBy("root").agg(F.min("path").alias("group_path")), "names")
    return members.join(names, "root").select("report_id", "path", "group_path")


def group_report(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """report_id, group_path, files and similarity (mean of the linking pairs, two decimals) of every group."""
    groups = file_groups(reports, pairs)
    sizes = groups.groupBy("report_id", "group_path").agg(F.count(F.lit(1)).alias("files"))
    scores = (
        accepted_pairs(reports, pairs)
        .join(groups.withColumnRenamed("path", "pa"), ["report_id", "pa"])
        .groupBy("report_id", "group_path")
        .agg(F.round(F.avg(F.col("similarity").cast("double")), 2).alias("similarity"))
    )
    return sizes.join(scores, ["report_id", "group_path"]).select("report_id", "group_path", "files", "similarity")
