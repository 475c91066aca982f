"""Near-duplicate files with small edits (problem 2).

Banded MinHash proposes candidates within a report; sequential Bayesian
verification compares their signatures batch by batch and drops a pair as soon as
the posterior probability that its similarity reaches the threshold falls below
the chosen miss probability; survivors are verified exactly on their shingle sets.

Files with equal shingle sets form one class, of which one file is banded. A bucket
with more than ``hot_bucket`` members leaves the banding: its members go through
the exact prefix join instead, so nothing is lost and no bucket is quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlake.functions.source_text import batch_shingles, mix64
from archlake.operators.simjoin import exact_pairs, prefix_candidates
from archlake.session import Scratch

SIGNATURE, BATCH = 128, 32
DEFAULT_THRESHOLD = 0.60


@cache
def bands(threshold: float, miss: float, most_rows: int = 4, most_bands: int = 128) -> tuple[int, int]:
    """(rows, bands): the most selective banding that misses a pair at the threshold with probability ``miss`` at most."""
    t = min(max(threshold, 0.05), 0.999)
    for rows in range(most_rows, 0, -1):
        n = math.ceil(math.log(miss) / math.log(1 - t**rows))
        if n <= most_bands:
            return rows, n
    return 1, n


@cache
def least_matches(threshold: float, miss: float) -> list[int]:
    """For each batch end n: the fewest matches at which P(similarity >= threshold | matches of n) is still >= miss.

    The prior is uniform, so the posterior is a Beta distribution and its tail a
    binomial sum. One byte per hash is compared; chance matches only keep pairs.
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append(m)
    return out


@cache
def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return (r.integers(0, 2**32, 4096, dtype=np.uint32) | np.uint32(1))[:k], r.integers(0, 2**32, 4096, dtype=np.uint32)[:k]


def minhash(items: np.ndarray, k: int) -> np.ndarray:
    a, b = _coefficients(k)
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        out = np.minimum(out, (np.multiply.outer(x[i : i + 4096], a) + b).min(axis=0))
    return out


def _sketcher(miss: float):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _slices(batches):
            yield from sketch_rows(x)

    def sketch_rows(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sets = batch_shingles(x["content"])
        x = x.assign(items=sets, size=[len(s) for s in sets])
        x = x[x["size"] > 0]
        for t, group in x.groupby("threshold"):
            r, n = bands(float(t), miss)
            mh = np.stack([minhash(s, max(SIGNATURE, r * n)) for s in group["items"]])
            salt = np.array([xxh(rid) for rid in group["report_id"]], np.uint64)
            keys = salt[:, None] + np.arange(n, dtype=np.uint64)
            for k in range(r):
                keys = mix64(keys + mh[:, k : r * n : r] + np.uint64(0x9E3779B97F4A7C15))
            sig = (mh[:, :SIGNATURE] & np.uint32(255)).astype(np.uint8)
            yield pd.DataFrame(
                {
                    "file_id": group["file_id"], "report_id": group["report_id"], "threshold": t, "size": group["size"],
                    "set_hash": [int(s.sum(dtype=np.uint64).view(np.int64)) for s in group["items"]],
                    "keys": list(keys.view(np.int64)), "sig": [v.tobytes() for v in sig],
                }
            )

    return sketch


@cache
def xxh(number: int) -> int:
    return xxhash.xxh64_intdigest(str(number))


def _prune(miss: float):
    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                a = np.frombuffer(b"".join(x["sa"]), np.uint8).reshape(-1, SIGNATURE)
                b = np.frombuffer(b"".join(x["sb"]), np.uint8).reshape(-1, SIGNATURE)
                t = x["threshold"].to_numpy()
                limits = {v: least_matches(float(v), miss) for v in np.unique(t)}
                alive, m = np.arange(len(x)), np.zeros(len(x), np.int32)
                for step, i in enumerate(range(0, SIGNATURE, BATCH)):
                    m[alive] += (a[alive, i : i + BATCH] == b[alive, i : i + BATCH]).sum(axis=1, dtype=np.int32)
                    need = np.zeros(len(alive), np.int32)
                    for v, lim in limits.items():
                        need[t[alive] == v] = lim[step]
                    alive = alive[m[alive] >= need]
                x = x.iloc[alive]
            yield x[["a", "b", "threshold"]]

    return prune


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        for at in range(0, len(x), 256):
            yield x.iloc[at : at + 256]


def _item_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in _slices(batches):
        yield pd.DataFrame({"id": x["file_id"], "items": [s.tobytes() for s in batch_shingles(x["content"])]})


def _token_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in _slices(batches):
        sets = [s.view(np.int64) for s in batch_shingles(x["content"])]
        yield pd.DataFrame({"id": x["file_id"], "part": x["report_id"], "threshold": x["threshold"], "size": [len(s) for s in sets], "tokens": sets})


class NearDuplicates:
    """``pairs``: a, b, similarity between class representatives of one report; ``members``: rep, file_id of classes of two or more.

    Files without a report, id or content, or with fewer than four tokens, match
    nothing. A null threshold is 0.60; thresholds are clamped to [0.1, 1].
    Repeated file ids count once.
    """

    def __init__(self, reports: DataFrame, files: DataFrame, miss: float = 0.001, hot_bucket: int = 400):
        scratch = Scratch(files.sparkSession, "neardup")
        limit = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD).cast("float"))
        limits = reports.select("report_id", F.least(F.greatest(limit, F.lit(0.1).cast("float")), F.lit(1.0).cast("float")).alias("threshold"))
        texts = (
            files.where("file_id is not null and content is not null")
            .select("file_id", "report_id", "content")
            .join(limits.dropDuplicates(["report_id"]), "report_id")
        )
        sketches = scratch.write(
            texts.mapInPandas(
                _sketcher(miss),
                "file_id long, report_id long, threshold float, size int, set_hash long, keys array<long>, sig binary",
            ),
            "sketches",
        )
        classes = sketches.select("file_id", "report_id", "set_hash", "size").groupBy("report_id", "set_hash", "size")
        many = classes.agg(F.min("file_id").alias("rep"), F.count_distinct("file_id").alias("n")).where("n > 1")
        self.members = scratch.write(
            sketches.select("file_id", "report_id", "set_hash", "size").distinct()
            .join(many, ["report_id", "set_hash", "size"]).select("rep", "file_id"), "members",
        )
        copies = self.members.where("file_id <> rep").select("file_id")
        alone = sketches.join(copies, "file_id", "left_anti")

        # most buckets hold one or two files: a pair is its bucket's minimum and maximum, and only what is
        # left, the buckets of three and more, is looked up again
        banded = alone.select("file_id", F.explode("keys").alias("key"))
        buckets = scratch.write(
            banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("a"), F.max("file_id").alias("b")).where("a < b"),
            "buckets",
        )
        twos = buckets.where("n = 2").select("a", "b")
        crowd = scratch.write(banded.join(buckets.where("n > 2").select("key", "n"), "key"), "crowd")
        common = crowd.where(F.col("n") <= hot_bucket)
        some = (
            common.select("key", F.col("file_id").alias("a"))
            .join(common.select("key", F.col("file_id").alias("b")), "key")
            .where("a < b")
            .select("a", "b")
        )
        hot_files = crowd.where(F.col("n") > hot_bucket).select("file_id").distinct()
        hot = texts.join(hot_files, "file_id", "left_semi").mapInPandas(
            _token_sets, "id long, part long, threshold float, size int, tokens array<long>"
        )
        candidates = twos.union(some).union(prefix_candidates(scratch.write(hot, "hot")).select("a", "b")).distinct()

        sig = alone.select("file_id", "sig", "threshold")
        survivors = scratch.write(
            candidates.join(sig.select(F.col("file_id").alias("a"), F.col("sig").alias("sa"), "threshold"), "a")
            .join(sig.select(F.col("file_id").alias("b"), F.col("sig").alias("sb")), "b")
            .mapInPandas(_prune(miss), "a long, b long, threshold float"),
            "survivors",
        )
        scratch.drop(sketches, buckets, crowd)
        wanted = survivors.select(F.col("a").alias("file_id")).union(survivors.select("b")).distinct()
        sets = scratch.write(
            texts.join(wanted, "file_id", "left_semi").dropDuplicates(["file_id"]).mapInPandas(_item_sets, "id long, items binary"), "sets"
        )
        self.pairs = scratch.write(exact_pairs(survivors, sets), "pairs")

    def expanded(self) -> DataFrame:
        """file_id_a, file_id_b: every pair of files, copies included."""
        of_a = self.members.select(F.col("rep").alias("a"), F.col("file_id").alias("ma"))
        of_b = self.members.select(F.col("rep").alias("b"), F.col("file_id").alias("mb"))
        across = (
            self.pairs.select("a", "b").join(of_a, "a", "left").join(of_b, "b", "left")
            .select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
        )
        within = of_a.join(of_b, of_a["a"] == of_b["b"]).where("ma < mb").select(F.col("ma").alias("x"), F.col("mb").alias("y"))
        return across.union(within).select(F.least("x", "y").alias("file_id_a"), F.greatest("x", "y").alias("file_id_b"))
