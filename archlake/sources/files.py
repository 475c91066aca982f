"""Reading source trees: scan, pruning, line counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlake.functions.paths import canonical_path
from archlake.session import Scratch

#: Directory and file names that are never descended into, and the extensions of source files in the order they are tried.
IGNORED = ("node_modules", ".git", "dist", "build", ".next", "target", ".cache", "__pycache__", ".archlake")
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def is_source(path: Column) -> Column:
    """A source file outside all ignored names; the extension's case counts."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED])) & path.rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")


def line_count(text: Column) -> Column:
    """Lines; a final line end adds none, an empty or null text has 0."""
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(text, "\n", -1)) - text.endswith("\n").cast("int"))


def number_by_order(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``id``: their place (from 0) in the order of ``column``; equal values are numbered in some order.

    Range partitions are written with their number, so that counting them and
    numbering inside them see the same rows; no single task orders everything.
    """
    ranges = Scratch(rows.sparkSession, "numbers").write(rows.repartitionByRange(F.col(column)).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # one row per partition
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    numbered = ranges.withColumn("__place", place).join(F.broadcast(before), "__part")
    return numbered.withColumn("id", (F.col("__before") + F.col("__place")).cast("long")).drop("__part", "__place", "__before")


def scan_repository(spark: SparkSession, root: str) -> DataFrame:
    """id, path (relative), content, loc of the source files under ``root``. Ids follow the paths' order. Files that
    are not UTF-8 keep their row with a null content and loc 0; a root without source files gives no rows.

    Names are listed first and only folders outside the ignored names are read, so
    the content of pruned folders is never fetched. The driver holds the names of
    the folders that are read, as it does for any file source.
    """
    base = root.rstrip("/").removeprefix("file:")
    prefix = "^" + re.escape(base) + "/"
    relative = lambda c: canonical_path(F.regexp_replace(F.regexp_replace(c, r"^file:/*", "/"), prefix, ""))
    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}")
    listed = source.option("recursiveFileLookup", True).load(root).select("path").withColumn("relative", relative("path")).where(is_source(F.col("relative")))
    folders = [r[0] for r in listed.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().toLocalIterator()]
    if not folders:
        return spark.createDataFrame([], "id long, path string, content string, loc int")
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    files = plain.load([re.sub(r"([\\*?\[\]{}])", r"\\\1", f) for f in folders]).select(relative("path").alias("path"), text.alias("content"))
    ids = number_by_order(listed.select(F.col("relative").alias("path")), "path")
    return ids.join(files, "path").select("id", "path", "content", line_count(F.col("content")).alias("loc"))
