"""Contracts: the shapes of parameters and return values as VARIANT."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlake.functions.shapes import Shapes, render


CONTRACT = "part long, path string, order int, slot int, name string, optional boolean, shape string, text string"


def _contracts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The slots of all functions of a file; its type tables are built once, and each annotation is read once."""
    for x in batches:
        rows = []
        for part, path, functions, types, imported in x[["part", "path", "functions", "types", "imported"]].itertuples(index=False):
            local = {t["name"]: (t["body"], t["is_interface"]) for t in (types if types is not None else [])}
            foreign = {t["name"]: (t["body"], t["is_interface"]) if t["body"] is not None else None for t in (imported if imported is not None else [])}
            shapes, known = Shapes(local, foreign), {}
            for order, f in enumerate(functions if functions is not None else []):
                slots = [(i, p["name"], p["optional"], p["type"]) for i, p in enumerate(f["params"])] + [(-1, "return", False, f["return_type"])]
                for slot, name, optional, annotation in slots:
                    if annotation not in known:
                        s = shapes.of(annotation)
                        known[annotation] = json.dumps(s), render(s)
                    rows.append((part, path, order, slot, name, optional, *known[annotation]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONTRACT.split(", ")])


def contracts(found: DataFrame, bindings: DataFrame) -> DataFrame:
    """part, path, order, slot (parameter position, -1 for the return value), name, optional, shape (VARIANT),
    text, untyped (any or unknown) and missing (no annotation).

    ``found``: the facts of files. Named types expand through the file's own
    declarations, else one import away (``bindings`` with target); an import that
    leads nowhere is external. One row per file enters the Python workers.
    """
    there = found.select("part", F.col("path").alias("target"), F.explode("types").alias("t")).select(
        "part", "target", F.col("t.name").alias("imported_name"), "t.body", "t.is_interface"
    )
    seen = bindings.join(there, ["part", "target", "imported_name"], "left").groupBy("part", "path").agg(
        F.collect_list(F.struct(F.col("local_name").alias("name"), "body", "is_interface")).alias("imported")  # one file's imports
    )
    rows = found.select("part", "path", "functions", "types").join(seen, ["part", "path"], "left").mapInPandas(_contracts, CONTRACT)
    s = rows.withColumn("shape", F.parse_json("shape"))
    kind = F.variant_get("shape", "$.kind", "string")
    return s.select(
        "part", "path", "order", "slot", "name", "optional", "shape", "text",
        ((kind == "primitive") & F.variant_get("shape", "$.name", "string").isin("any", "unknown")).alias("untyped"), (kind == "unknown").alias("missing"),
    )


def paired_arguments(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Every parameter of the function a call resolves to beside the argument text at its position: part, path, order,
    call_order (of the call), target_module, target_order, slot, name, optional, argument (null if not given).

    ``calls``: resolved calls of a call graph; calls that lead nowhere have no rows.
    """
    known = functions.select("part", F.col("path").alias("target_module"), F.col("order").alias("target_order"), "params")
    met = calls.where("target_order is not null").select("part", "path", "order", "call_order", "target_module", "target_order", "arg_texts").join(known, ["part", "target_module", "target_order"])
    rows = met.select("part", "path", "order", "call_order", "target_module", "target_order", "arg_texts", F.posexplode("params").alias("slot", "p"))
    return rows.select("part", "path", "order", "call_order", "target_module", "target_order", "slot", "p.name", "p.optional", F.get("arg_texts", F.col("slot")).alias("argument"))
