"""Import specifiers to modules: ranked candidates, the first that exists wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlake.sources.files import EXTENSIONS


def fold(path: Column) -> Column:
    """``.`` and ``..`` folded away; ``..`` above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    done = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.array_join(done, "/")


def candidates(importer: Column, specifier: Column, strict: bool = True) -> Column:
    """array<struct<rank, path>>: the exact file, the last suffix replaced by each extension (appended too unless
    ``strict``), then index files. Null for bare specifiers. A leading ``/`` means the repository's root."""
    relative = specifier.startswith(".") | specifier.startswith("/")
    folder = F.array_join(F.slice(F.split(importer, "/"), F.lit(1), F.size(F.split(importer, "/")) - 1), "/")
    target = fold(F.when(specifier.startswith("/"), specifier).otherwise(F.concat(folder, F.lit("/"), specifier)))
    stem = F.regexp_replace(target, r"(?<=[^/])\.[^./]*$", "")
    paths = [target, *[F.concat(stem, F.lit(f".{x}")) for x in EXTENSIONS]]
    if not strict:
        paths += [F.concat(target, F.lit(f".{x}")) for x in EXTENSIONS]
    paths += [F.concat(target, F.lit(f"/index.{x}")) for x in EXTENSIONS]
    return F.when(relative, F.array(*[F.struct(F.lit(i).alias("rank"), p.alias("path")) for i, p in enumerate(paths)]))


def resolve_imports(imports: DataFrame, modules: DataFrame, strict: bool = True) -> DataFrame:
    """``imports`` (part, path, specifier, ...) with target, the path they lead to; null where none exists.

    ``modules``: part, path. All candidates meet the modules in one equi-join.
    """
    distinct = imports.select("part", "path", "specifier").distinct()
    tried = distinct.select("part", "path", "specifier", F.explode(candidates(F.col("path"), F.col("specifier"), strict)).alias("c")).select(
        "part", "path", "specifier", "c.rank", F.col("c.path").alias("target")
    )
    there = tried.join(modules.select("part", F.col("path").alias("target")).distinct(), ["part", "target"])
    best = there.groupBy("part", "path", "specifier").agg(F.min_by("target", "rank").alias("target"))
    return imports.join(best, ["part", "path", "specifier"], "left")
