"""Exact set-similarity self-join (Jaccard) with prefix and length filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, similarity of ``pairs`` (a, b, threshold: float) whose Jaccard similarity reaches the threshold.

    ``sets``: id, items (binary: sorted distinct 64-bit hashes). Both sides of a
    comparison are 32-bit floats, as in the metric's definition. The sets are
    shuffled once, for both ends of the pairs.
    """

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sims = []
            for u, v in zip(x["ia"], x["ib"]):
                u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                sims.append(np.float32(both) / np.float32(len(u) + len(v) - both))
            x = x.assign(similarity=np.array(sims, np.float32))
            yield x.loc[x["similarity"] >= x["threshold"].astype(np.float32), ["a", "b", "similarity"]]

    by_id = sets.select("id", "items").repartition("id")
    with_a = pairs.select("a", "b", "threshold").join(by_id.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a")
    both = with_a.join(by_id.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    return both.mapInPandas(verify, "a long, b long, similarity float")


def prefix_length(size: Column, threshold: Column) -> Column:
    """Two sets of similarity t share an item among the rarest ``size - ceil(t * size) + 1`` of each."""
    return size - F.ceil(threshold.cast("double") * size - F.lit(1e-6)).cast("int") + 1


def prefix_candidates(sets: DataFrame) -> DataFrame:
    """a < b, threshold: all pairs of one part that can reach the threshold; exact, nothing is lost.

    ``sets``: id, part, threshold, size, tokens (array<long>). Items are ordered by
    how many sets of the part hold them; only each set's rarest prefix is joined,
    and sizes must agree within the threshold. Hot items end up outside the
    prefixes; what skew is left is split by the adaptive skew join.
    """
    items = sets.select("id", "part", F.explode("tokens").alias("token"))
    df = items.groupBy("part", "token").agg(F.count(F.lit(1)).alias("df"))
    ordered = (
        items.join(df.where("df > 1"), ["part", "token"])  # an item of one set matches nothing but uses up no prefix
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    )
    # items held by no other set are the rarest: they fill the prefix first
    prefix = (
        sets.select("id", "part", "threshold", "size")
        .join(ordered, "id")
        .withColumn("keep", prefix_length(F.col("size"), F.col("threshold")) - (F.col("size") - F.size("shared")))
        .where("keep > 0")
        .select("id", "part", "threshold", "size", F.explode(F.slice("shared", F.lit(1), F.col("keep"))).alias("x"))
        .select("id", "part", "threshold", "size", "x.token")
    )
    a = prefix.select(F.col("id").alias("a"), "part", "token", "threshold", F.col("size").alias("sa"))
    b = prefix.select(F.col("id").alias("b"), "part", "token", F.col("size").alias("sb"))
    fits = F.least("sa", "sb") >= F.col("threshold").cast("double") * F.greatest("sa", "sb") - 1e-6
    return a.join(b, ["part", "token"]).where((F.col("a") < F.col("b")) & fits).select("a", "b", "threshold").distinct()
