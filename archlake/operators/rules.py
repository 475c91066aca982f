"""Declared architecture: boundaries, layers, and the rules checked against edges.

Rules come from a small file or literal; their globs become one expression per
boundary, so membership is decided in the scan, without a join.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str | None:
    """A regular expression for the whole path, or None for a malformed glob. ``*`` also crosses ``/``."""
    out, i, n = [], 0, len(glob)
    depth = 0
    while i < n:
        c = glob[i]
        if glob.startswith("**", i):
            at_start = i == 0 or glob[i - 1] == "/"
            if at_start and glob.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
                continue
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] not in ("!", "^") else i + 3)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            inner = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + "^" * negated + inner + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "}":
            return None
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return None if depth else "^(?s:" + "".join(out) + ")$"


def glob_match(glob: str, path: Column) -> Column:
    """Whether the path matches; a malformed glob matches paths that contain its text."""
    regex = glob_to_regex(glob)
    return path.rlike(regex) if regex is not None else path.contains(glob)


@dataclass
class Rules:
    boundaries: dict[str, list[str]] = field(default_factory=dict)
    forbidden: list[dict] = field(default_factory=list)
    canonical: list[dict] = field(default_factory=list)
    layers: list[str] = field(default_factory=list)
    features: list[dict] = field(default_factory=list)

    @classmethod
    def from_toml(cls, text: str) -> Rules:
        """Every section is optional; text that isn't TOML raises."""
        d = tomllib.loads(text)
        r = d.get("rules", {})
        return cls(d.get("boundaries", {}), r.get("forbidden", []), r.get("canonical", []), r.get("layers", []), d.get("features", []))

    def in_boundary(self, name: str, path: Column) -> Column:
        cond = F.lit(False)
        for glob in self.boundaries.get(name, []):
            cond = cond | glob_match(glob, path)
        return cond

    def resolves(self, name: str, path: Column) -> Column:
        """Membership in a boundary; any other name is a glob over the files of all boundaries."""
        if name in self.boundaries:
            return self.in_boundary(name, path)
        anywhere = F.lit(False)
        for b in self.boundaries:
            anywhere = anywhere | self.in_boundary(b, path)
        return anywhere & glob_match(name, path)

    def layer_index(self, path: Column) -> Column:
        """Index of the first layer that holds the path; null for none."""
        index = F.lit(None).cast("int")
        for i in range(len(self.layers) - 1, -1, -1):
            index = F.when(self.resolves(self.layers[i], path), i).otherwise(index)
        return index

    def layer(self, path: Column) -> Column:
        names = F.array(*[F.lit(x) for x in self.layers]) if self.layers else F.array().cast("array<string>")
        return F.get(names, self.layer_index(path))


def boundary_members(modules: DataFrame, rules: Rules) -> DataFrame:
    """snapshot_id, id, path, boundary: a row for each boundary that holds the module."""
    names = F.array_compact(F.array(*[F.when(rules.in_boundary(b, F.col("path")), F.lit(b)) for b in rules.boundaries])) if rules.boundaries else F.array().cast("array<string>")
    return modules.select("snapshot_id", "id", "path", F.explode(names).alias("boundary"))


def assign_layers(modules: DataFrame, rules: Rules) -> DataFrame:
    """snapshot_id, id, path, layer: the first declared layer that matches; unmatched modules are left out."""
    return modules.select("snapshot_id", "id", "path", rules.layer(F.col("path")).alias("layer")).where("layer is not null")


def with_paths(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Clean edges with from_path and to_path."""
    m = modules.select("snapshot_id", "id", "path")
    return edges.join(m.select("snapshot_id", F.col("id").alias("from_id"), F.col("path").alias("from_path")), ["snapshot_id", "from_id"]).join(
        m.select("snapshot_id", F.col("id").alias("to_id"), F.col("path").alias("to_path")), ["snapshot_id", "to_id"]
    )


VIOLATION = "snapshot_id", "rule", "severity", "from_path", "to_path", "message", "rule_order"


def violations(modules: DataFrame, edges: DataFrame, rules: Rules) -> DataFrame:
    """Violations of forbidden edges (Error), canonical concepts (Warning) and the layer order (Error).

    One row per edge and rule, so an import and a re-export of one target give two.
    Layers: a module must not depend on one of a later layer; with fewer than two
    layers nothing is checked. Canonical: where more than one module of a snapshot
    matches the concept, all but the declared path are flagged.
    """
    # Names, severities and texts of the three rules.
    pairs = with_paths(edges, modules)
    f, t = F.col("from_path"), F.col("to_path")
    found = []
    for i, rule in enumerate(rules.forbidden):
        a, b = rule["from"], rule["to"]
        text = F.lit(rule.get("reason") or f"'{a}' must not import '{b}'")
        found.append(F.when(rules.resolves(a, f) & rules.resolves(b, t), F.struct(F.lit(f"forbidden: {a} → {b}").alias("rule"), text.alias("message"), F.lit(i).alias("rule_order"))))
    if len(rules.layers) > 1:
        names = F.array(*[F.lit(x) for x in rules.layers])
        fi, ti = rules.layer_index(f), rules.layer_index(t)
        lf, lt = F.get(names, fi), F.get(names, ti)
        text = F.concat(F.lit("'"), f, F.lit("' (layer '"), lf, F.lit("') must not import '"), t, F.lit("' (layer '"), lt, F.lit("')"))
        found.append(F.when(fi < ti, F.struct(F.concat(F.lit("layer: "), lf, F.lit(" < "), lt).alias("rule"), text.alias("message"), F.lit(2_000_000).alias("rule_order"))))
    out = None
    if found:
        out = pairs.select("snapshot_id", "from_path", "to_path", F.explode(F.array_compact(F.array(*found))).alias("v")).select(
            "snapshot_id", "v.rule", F.lit("Error").alias("severity"), "from_path", "to_path", "v.message", "v.rule_order"
        )
    for i, rule in enumerate(rules.canonical):
        concept, path = rule["concept"], rule["path"]
        hits = modules.where(glob_match(concept, F.col("path"))).select("snapshot_id", "path")
        several = hits.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("snapshot_id")
        part = hits.where(F.col("path") != path).join(several, "snapshot_id", "left_semi").select(
            "snapshot_id", F.lit(f"canonical: {concept}").alias("rule"), F.lit("Warning").alias("severity"), F.col("path").alias("from_path"), F.lit(path).alias("to_path"),
            F.concat(F.lit("'"), F.col("path"), F.lit(f"' matches the '{concept}' concept, which already has a canonical implementation at '{path}'")).alias("message"),
            F.lit(1_000_000 + i).alias("rule_order"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        return modules.sparkSession.createDataFrame([], "snapshot_id long, rule string, severity string, from_path string, to_path string, message string, rule_order int")
    return out.select(*VIOLATION)


def scorecard(found: DataFrame) -> DataFrame:
    """Per snapshot: errors, warnings, and whether the check passes (no errors)."""
    return found.groupBy("snapshot_id").agg(
        F.count_if(F.col("severity") == "Error").alias("errors"), F.count_if(F.col("severity") == "Warning").alias("warnings")
    ).withColumn("passes", F.col("errors") == 0)


def ordered_violations(found: DataFrame) -> DataFrame:
    """``found`` with ``place`` (from 1) in its snapshot: errors before warnings, rules in their order, then by path."""
    severe = (F.col("severity") != "Error").cast("int")
    order = Window.partitionBy("snapshot_id").orderBy(severe, "rule_order", "from_path", "to_path", "rule")
    return found.withColumn("place", F.row_number().over(order))


def infer_boundaries(modules: DataFrame) -> DataFrame:
    """snapshot_id, boundary, glob, files: one boundary per top path segment, and its rule line."""
    top = F.split("path", "/")[0]
    return modules.groupBy("snapshot_id", top.alias("boundary")).agg(F.count(F.lit(1)).alias("files")).withColumn("glob", F.concat("boundary", F.lit("/**")))


def boundaries_toml(inferred: DataFrame, snapshot_id: int) -> str:
    """The rules file of one snapshot's inferred boundaries (one line per top segment)."""
    rows = inferred.where(F.col("snapshot_id") == snapshot_id).orderBy("boundary").select("boundary", "glob").toLocalIterator()
    return "[boundaries]\n" + "".join(f'"{r[0]}" = ["{r[1]}"]\n' for r in rows)
