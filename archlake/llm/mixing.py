"""Mixing sources to target weights (problem 7).

Entropy balancing: of all rates per document that give every source its target
number of tokens, take those closest (in relative entropy) to one copy each. They
have the form ``min(max_repeats, exp(lambda_source * tokens / mean))``, and the
multipliers solve a convex dual. Each Newton iteration is one aggregation over
(source, tokens) counts, done for all sources at once; the steps stay inside a
bracket that closes, so they converge. Where the gradient still asks for more
tokens although every rate is at its cap, the dual has no finite solution: such a
source can't reach its share, and all its documents get max_repeats.

Rates are rounded into whole copies systematically: along the documents of a
source in the order of their size, the running sum of the fractional rates gives
one more copy whenever it passes a whole number. A source's tokens then miss its
target by no more than about one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlake.session import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern published with the byte-level BPE vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: documents of one source and size that are ranked in one group; larger groups are split
GROUP = 100_000


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (normalised), tokens of every document; a null text has 0. ``tokenizer`` is the path of the
    vocabulary file where the job is started; its bytes (a fixed vocabulary, about a megabyte) go with the job."""
    with open(tokenizer, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary.value).encode_ordinary
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "source": x["source"], "tokens": [len(encode(t)) if t else 0 for t in x["text"]]})

    rows = documents.select("doc_id", source_key("source").alias("source"), "text")
    return rows.mapInPandas(count, "doc_id long, source string, tokens long")


def source_key(c: str | Column) -> Column:
    """Sources compare without case and outer blanks."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


class Mixture:
    """Rates and shares of the sources in ``targets`` (source, target_share, max_repeats).

    Documents of other or null sources take no part. Repeated target rows count
    once (the largest share); a null share is 0, null max_repeats is 1. ``total``
    is the size of the mixture in tokens, by default the tokens of all documents
    that take part.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None, tolerance: float = 1e-9, group: int = GROUP):
        scratch = Scratch(documents.sparkSession, "mix")
        self.spark, self.group = documents.sparkSession, group
        goals = (
            targets.where("source is not null")
            .groupBy(source_key("source").alias("source"))
            .agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"))
        )
        taking_part = documents.join(goals.select(F.col("source").alias("key")), source_key(documents["source"]) == F.col("key"), "left_semi")
        self.tokens = scratch.write(count_tokens(taking_part, tokenizer), "tokens")
        # weights depend on (source, tokens) alone, so the iterations run over these counts
        self.counts = scratch.write(self.tokens.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "counts")
        have = self.counts.groupBy("source").agg(
            F.sum(F.col("tokens") * F.col("n")).alias("have"), F.sum("n").alias("docs"), F.max("tokens").alias("largest"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least")
        )
        rows = goals.join(have, "source", "left").fillna(0, ["have", "docs", "largest", "least"]).collect()  # one row per stated target
        available = sum(r["have"] for r in rows)
        self.total = available if total is None else total
        self.sources = {r["source"]: dict(r.asDict(), goal=r["target_share"] * self.total) for r in rows}
        self._solve(tolerance)

    def _rate(self, rows: DataFrame, values: dict[str, float]) -> DataFrame:
        """``rows`` (source, tokens) of the sources in ``values`` (their multipliers) with rate and capped."""
        table = [(s, float(v), max(1.0, x["have"] / x["docs"]) if x["docs"] else 1.0, int(x["max_repeats"])) for s, v in values.items() for x in [self.sources[s]]]
        given = self.spark.createDataFrame(table, "source string, multiplier double, mean double, max_repeats long")  # one row per target
        power = F.col("multiplier") * F.col("tokens") / F.col("mean")
        capped = (F.col("max_repeats") == 0) | (power >= F.log(F.col("max_repeats").cast("double")))
        out = rows.join(F.broadcast(given), "source").withColumn("capped", capped)
        return out.withColumn("rate", F.when(F.col("capped"), F.col("max_repeats").cast("double")).otherwise(F.exp(power)))

    def _solve(self, tolerance: float) -> None:
        """Multipliers of all sources. ``bracket`` begins where all rates are next to nothing and ends where all are capped."""
        bracket: dict[str, list[float]] = {}
        for s, x in self.sources.items():
            x["multiplier"], x["reachable"] = -math.inf, x["goal"] <= 0
            if x["goal"] > 0 and x["have"]:
                longest = max(1.0, x["have"] / x["docs"]) / x["least"]
                bracket[s] = [-745.0 * longest, math.log(max(1, x["max_repeats"])) * longest * (1 + 1e-12)]
        at = {s: high for s, (_, high) in bracket.items()}
        before: dict[str, float] = {}
        while at:
            size = F.col("n") * F.col("tokens") * F.col("rate")
            sums = self._rate(self.counts, at).groupBy("source").agg(
                F.sum(size).alias("f"), F.sum(F.when(~F.col("capped"), size * F.col("tokens") / F.col("mean")).otherwise(0.0)).alias("slope")
            )
            for r in sums.collect():
                s, x = r["source"], self.sources[r["source"]]
                gap, low, high = r["f"] - x["goal"], *bracket[s]
                if gap < 0 and r["slope"] == 0:  # all rates are capped: no multiplier, however large, gives more
                    x["multiplier"] = at.pop(s)
                    continue
                if abs(gap) <= tolerance * x["goal"]:
                    x["multiplier"], x["reachable"] = at.pop(s), True
                    continue
                low, high = bracket[s] = [at[s], high] if gap < 0 else [low, at[s]]
                if high - low <= 1e-15 * max(1.0, abs(high), abs(low)):
                    raise RuntimeError(f"no multiplier found for source {s}: {gap} tokens remain")
                step = at[s] - gap / r["slope"] if r["slope"] > 0 else math.inf
                slow = abs(gap) > 0.5 * before.get(s, math.inf)
                before[s] = abs(gap)
                at[s] = step if low < step < high and not slow else (max(low, -1.0) + min(high, 1.0)) / 2 if low < 0 < high else (low + high) / 2

    def unreachable(self) -> DataFrame:
        """source: its dual has no finite solution, as max_repeats times its tokens is less than its target."""
        return self.spark.createDataFrame([(s,) for s, x in self.sources.items() if not x["reachable"]], "source string")

    def copies(self) -> DataFrame:
        """doc_id, source, tokens, rate, copies (0 to max_repeats) of every document that takes part.

        Documents of one source and size share a rate. Groups of more than ``group``
        such documents are split by hash, ranked inside, and placed behind one
        another by a running sum over the groups.
        """
        shards = max(1, -(-(self.counts.agg(F.max("n")).first()[0] or 0) // self.group))
        place = F.xxhash64("doc_id", F.lit(7))
        docs = self.tokens.withColumn("shard", F.pmod(place, F.lit(shards)))
        keys = ["source", "tokens", "shard"]
        groups = self._rate(docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), {s: x["multiplier"] if x["goal"] > 0 else -1e308 for s, x in self.sources.items()})
        groups = groups.withColumn("rate", F.when(F.col("multiplier") == -1e308, 0.0).otherwise(F.col("rate")))
        part = F.col("rate") - F.floor(F.col("rate") + F.lit(1e-9))
        groups = groups.withColumn("part", F.greatest(part, F.lit(0.0)))
        sizes = Window.partitionBy("source").orderBy("tokens", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per group
        groups = groups.select(*keys, "rate", "part", F.coalesce(F.sum(F.col("n") * F.col("part")).over(sizes), F.lit(0.0)).alias("passed"))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(place, "doc_id"))
        rows = docs.withColumn("rank", rank).join(groups, keys)
        until = lambda k: F.floor(F.col("passed") + k * F.col("part") + F.lit(0.5))
        n = F.floor(F.col("rate") + F.lit(1e-9)) + until(F.col("rank")) - until(F.col("rank") - 1)
        return rows.select("doc_id", "source", "tokens", F.round("rate", 6).alias("rate"), n.cast("long").alias("copies"))

    def shares(self) -> DataFrame:
        """Per source: target share, actual share of the tokens mixed, share of the intended total, tokens available
        and used, documents used, and whether the target can be reached. Where a source falls short, the others'
        actual shares exceed their targets although their tokens are as intended."""
        goals = self.spark.createDataFrame(
            [(s, float(x["target_share"]), int(x["max_repeats"]), int(x["have"]), bool(x["reachable"])) for s, x in self.sources.items()],
            "source string, target_share double, max_repeats long, tokens_available long, reachable boolean",
        )
        used = self.copies().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count_if(F.col("copies") > 0).alias("documents_used"))
        whole = used.agg(F.sum("tokens_used").alias("whole"))
        return (
            goals.join(used, "source", "left").crossJoin(F.broadcast(whole)).fillna(0, ["tokens_used", "documents_used"])
            .withColumn("actual_share", F.when(F.col("whole") > 0, F.round(F.col("tokens_used") / F.col("whole"), 6)).otherwise(0.0))
            .withColumn("share_of_total", F.round(F.col("tokens_used") / F.lit(float(max(1, self.total))), 6)).drop("whole")
        )

    def targets_met(self) -> DataFrame:
        """Per source: target share, whether it can be reached, and whether the mixture meets it to within one document."""
        goals = self.spark.createDataFrame(
            [(s, float(x["target_share"]), float(x["goal"]), int(x["largest"]), bool(x["reachable"])) for s, x in self.sources.items()],
            "source string, target_share double, goal double, largest long, reachable boolean",
        )
        used = self.copies().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
        met = F.abs(F.coalesce("used", F.lit(0)) - F.col("goal")) <= F.col("largest")
        return goals.join(used, "source", "left").select("source", "target_share", "reachable", (F.col("reachable") & met).alias("met"))
