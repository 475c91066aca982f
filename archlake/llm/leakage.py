"""Evaluation texts leaking into training text (problem 6).

Wu-Manber multi-pattern search over words. The patterns are all runs of
``length`` consecutive words of the evaluation items. A block is two adjacent
words; the shift table gives, for the block at the end of the window, how many
words the window may advance without passing a match (almost always all but one).
Only at shift zero, and only if the window's first block begins some pattern, does
the hash of its last block select a bucket of patterns, and the window's words are
compared with them directly.

The tables are hashed, so their size is fixed by their number of slots however
many items there are: blocks that share a slot only make a shift smaller. Spark
builds them from the items. Documents are scanned whole, once and in place; the
windows that reach shift zero, few besides true matches, meet the patterns of
their bucket in a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlake.session import Scratch

WORD = re.compile(r"[^\W_]+")
LENGTH, BLOCK = 12, 2
#: slots of the hashed tables: this many per word of the items, up to a size that fits every worker (two bytes a slot)
SLOTS_PER_WORD, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 16, 1 << 23
SHIFT, START = 0, 1


def words(text: str) -> list[str]:
    """Unbroken runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def slot(a: str, b: str) -> int:
    """Hash of a block of two words."""
    return xxhash.xxh32_intdigest(f"{a} {b}")


def _table_rows(items: pd.DataFrame, length: int, slots: int) -> pd.DataFrame:
    """kind, slot, value of the items' patterns: the least shift of every block, and the blocks that begin a pattern."""
    least: dict[tuple[int, int], int] = {}
    for text in items["text"]:
        w = words(text)
        last = len(w) - length
        if last < 0:
            continue
        blocks = [slot(a, b) % slots for a, b in zip(w, w[1:])]
        for j, h in enumerate(blocks):  # the block of words j and j + 1; the window that holds it as late as possible starts at:
            start = max(0, j + BLOCK - length)
            shift = length - BLOCK - (j - start)
            least[SHIFT, h] = min(shift, least.get((SHIFT, h), shift))
        for start in range(last + 1):
            least[START, blocks[start]] = 0
    return pd.DataFrame([(k, h, v) for (k, h), v in least.items()], columns=["kind", "slot", "value"]).astype({"kind": "int8", "slot": "int32", "value": "int8"})


def search_tables(items: DataFrame, length: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The shift of every slot, and whether a pattern begins with a block of it. At most two rows of six bytes a slot are collected."""
    rows = items.mapInPandas(lambda batches: (_table_rows(x, length, slots) for x in batches), "kind byte, slot int, value byte")
    found = rows.groupBy("kind", "slot").agg(F.min("value").alias("value")).toPandas()
    shift, start = np.full(slots, length - BLOCK + 1, np.uint8), np.zeros(slots, bool)
    own = found["kind"] == SHIFT
    shift[found.loc[own, "slot"]] = found.loc[own, "value"]
    start[found.loc[~own, "slot"]] = True
    return shift, start


def _patterns(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = []
        for item, text in zip(x["item_id"], x["text"]):
            w = words(text)
            rows += [(slot(*w[s + length - BLOCK : s + length]), " ".join(w[s : s + length]), item) for s in range(len(w) - length + 1)]
        yield pd.DataFrame(rows, columns=["bucket", "run", "item_id"]).astype({"bucket": "int64", "item_id": "int64"})


def windows_at_shift_zero(w: list[str], shift: np.ndarray, start: np.ndarray, length: int) -> set[tuple[int, str]]:
    """Bucket and words of the windows at which a pattern may end."""
    found = set()
    i, n, slots = length - 1, len(w), len(shift)
    while i < n:
        bucket = slot(w[i - 1], w[i])
        s = shift[bucket % slots]
        if s:
            i += int(s)
            continue
        first = i - length + 1
        if start[slot(w[first], w[first + 1]) % slots]:
            found.add((bucket, " ".join(w[first : i + 1])))
        i += 1
    return found


def leaks(documents: DataFrame, items: DataFrame, length: int = LENGTH, slots: int | None = None) -> DataFrame:
    """doc_id, item_id: the document holds at least ``length`` consecutive words of the item.

    Null texts and null ids match nothing, items of fewer words neither; repeated
    rows come out once; no items give no rows. ``slots`` is the size of the hashed
    tables; by default it follows the number of the items' words. Once the items
    fill the largest tables, more windows reach the join, and none is lost.
    """
    spark = documents.sparkSession
    given = items.where("item_id is not null and text is not null").select("item_id", "text")
    if slots is None:
        total = given.agg(F.coalesce(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+"))), F.lit(0))).first()[0]
        slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SLOTS_PER_WORD * int(total)).bit_length()))
    tables = spark.sparkContext.broadcast(search_tables(given, length, slots))
    patterns = given.mapInPandas(lambda batches: _patterns(batches, length), "bucket long, run string, item_id long")
    # written, so that the join is one of plain shuffles and a run that a third of the documents hold can be split
    patterns = Scratch(spark, "leaks").write(patterns.distinct(), "patterns")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, start = tables.value
        for x in batches:
            rows = [(d, *hit) for d, text in zip(x["doc_id"], x["text"]) for hit in windows_at_shift_zero(words(text), shift, start, length)]
            yield pd.DataFrame(rows, columns=["doc_id", "bucket", "run"]).astype({"doc_id": "int64", "bucket": "int64"})

    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    candidates = docs.mapInPandas(scan, "doc_id long, bucket long, run string")
    return candidates.join(patterns, ["bucket", "run"]).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, documents: every item with the number of documents that hold a part of it."""
    hits = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    names = items.where("item_id is not null").select("item_id", "suite").dropDuplicates(["item_id"])
    return names.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))
