"""Duplication radar: exact pairs by shingle sets, clusters of linked files, and their report."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlake.functions.source_text import batch_shingles
from archlake.operators.graph import connected_components
from archlake.operators.simjoin import exact_pairs, prefix_candidates
from archlake.session import Scratch


def clamp_threshold(threshold: float | None) -> float:
    """Between 0.1 and 1.0; 0.60 if none is given."""
    return 0.60 if threshold is None else min(1.0, max(0.1, threshold))


def shingle_sets(files: DataFrame, threshold: float) -> DataFrame:
    """id, part, threshold, size, set_hash, tokens of files (id, part, content) with at least four tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 256):
                y = x.iloc[at : at + 256]
                sets = batch_shingles(y["content"])
                hashes = [int(s.sum(dtype="uint64").view("int64")) for s in sets]
                rows = {"id": y["id"], "part": y["part"], "threshold": threshold, "size": [len(s) for s in sets], "set_hash": hashes}
                yield pd.DataFrame({**rows, "tokens": [s.view("int64") for s in sets]}).query("size > 0")

    rows = files.where("id is not null and part is not null and content is not null").select("id", "part", "content")
    return rows.mapInPandas(run, "id long, part long, threshold float, size int, set_hash long, tokens array<long>")


class SimilarFiles:
    """Files of one part whose similarity reaches the threshold; exact, without expanding copies.

    Files with equal shingle sets form one class, named by its smallest id.
    ``members``: part, rep, id of every file that has shingles; ``pairs``: part, a,
    b, similarity between classes. Repeated ids count once, with one of their
    texts; files without id, part, content or shingles are left out.
    """

    def __init__(self, files: DataFrame, threshold: float | None = None):
        scratch = Scratch(files.sparkSession, "dupes")
        once = files.where("id is not null and part is not null and content is not null").groupBy("part", "id").agg(F.max("content").alias("content"))
        sets = scratch.write(shingle_sets(once, clamp_threshold(threshold)), "sets")
        same = ["part", "set_hash", "size"]
        classes = scratch.write(sets.groupBy(*same).agg(F.min("id").alias("rep")), "classes")
        self.members = sets.select("id", *same).join(classes, same).select("part", "rep", "id")
        firsts = sets.join(classes.select("part", F.col("rep").alias("id")), ["part", "id"], "left_semi")
        pack = lambda batches: (pd.DataFrame({"id": x["id"], "items": [t.tobytes() for t in x["tokens"]]}) for x in batches)
        items = firsts.select("id", "tokens").mapInPandas(pack, "id long, items binary")
        found = exact_pairs(prefix_candidates(firsts), items)
        self.pairs = found.join(classes.select("part", F.col("rep").alias("a")), "a").select("part", "a", "b", "similarity")

    def clusters(self) -> DataFrame:
        """part, cluster (smallest id), files, similarity (mean of all pairs of files that reached the threshold, two decimals).

        Copies weigh as the pairs they stand for: a pair of classes as often as the
        product of their sizes, a class of n as n (n - 1) / 2 pairs of similarity 1.
        """
        sizes = self.members.groupBy("part", "rep").agg(F.count(F.lit(1)).alias("n"))
        n = lambda rep, name: sizes.select("part", F.col("rep").alias(rep), F.col("n").alias(name))
        across = self.pairs.join(n("a", "na"), ["part", "a"]).join(n("b", "nb"), ["part", "b"])
        across = across.select("part", "a", "b", (F.col("na") * F.col("nb")).alias("weight"), F.col("similarity").cast("double").alias("s"))
        within = sizes.where("n > 1").select("part", F.col("rep").alias("a"), F.col("rep").alias("b"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("weight"), F.lit(1.0).alias("s"))
        links = across.unionByName(within)
        member = connected_components(links.select("part", "a", "b")).withColumnRenamed("node", "rep")
        files = member.join(sizes, ["part", "rep"]).groupBy("part", "component").agg(F.sum("n").alias("files"))
        mean = links.join(member.withColumnRenamed("rep", "a"), ["part", "a"]).groupBy("part", "component").agg(F.round(F.sum(F.col("s") * F.col("weight")) / F.sum("weight"), 2).alias("similarity"))
        return files.join(mean, ["part", "component"]).select("part", F.col("component").alias("cluster"), "files", "similarity")


def cluster_order(found: DataFrame) -> DataFrame:
    """``found`` (part, cluster, files, similarity) with ``place`` (from 1) in its part: most files first, then the
    highest similarity, then the cluster's name. The window sorts clusters, one row each, within a report."""
    order = Window.partitionBy("part").orderBy(F.col("files").desc(), F.col("similarity").desc_nulls_last(), "cluster")
    return found.withColumn("place", F.row_number().over(order))


def cluster_files(members: DataFrame) -> DataFrame:
    """``members`` (part, cluster, path) with ``file_place`` (from 1): the files of a cluster by path."""
    return members.withColumn("file_place", F.row_number().over(Window.partitionBy("part", "cluster").orderBy("path")))


def report(found: DataFrame, files: DataFrame) -> DataFrame:
    """part, clusters, files_analyzed (all files, readable or not), files_in_clusters."""
    all_ = files.groupBy("part").agg(F.count(F.lit(1)).alias("files_analyzed"))
    c = found.groupBy("part").agg(F.count(F.lit(1)).alias("clusters"), F.sum("files").alias("files_in_clusters"))
    return all_.join(c, "part", "left").fillna(0, ["clusters", "files_in_clusters"])
