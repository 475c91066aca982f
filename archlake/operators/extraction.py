"""One scan over source texts gives all facts of a file; Spark takes them apart into rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlake.functions import extract

FACTS = (
    "imports array<struct<specifier:string,is_reexport:boolean>>, "
    "bindings array<struct<local_name:string,imported_name:string,specifier:string>>, "
    "functions array<struct<name:string,start:int,end:int,exported:boolean,is_default:boolean,is_method:boolean,class_name:string,"
    "params:array<struct<name:string,type:string,optional:boolean>>,return_type:string>>, "
    "calls array<struct<start:int,callee_text:string,callee_root:string,member_path:array<string>,arg_texts:array<string>,function:int,branch:int>>, "
    "branches array<struct<start:int,end:int>>, "
    "types array<struct<name:string,body:string,is_interface:boolean,exported:boolean>>"
)


def attribute(calls: list[dict], functions: list[dict], branches: list[tuple[int, int]]) -> list[dict]:
    """``calls`` (by start) with ``function``, the index of the innermost function around the call (the largest start;
    of equal ones the last), and ``branch``, that of the smallest branch span around the call and inside that function.

    One sweep over the positions: spans are entered at their start and dropped
    once they are behind; what a call looks through are the branches open in its
    function.
    """
    entered: list[int] = []
    open_: list[int] = []
    order = sorted(range(len(branches)), key=lambda i: branches[i][0])
    f = b = 0
    out = []
    for call in calls:
        at = call["start"]
        while f < len(functions) and functions[f]["start"] <= at:
            entered.append(f)
            f += 1
        while entered and functions[entered[-1]]["end"] <= at:
            entered.pop()
        if b < len(order) and branches[order[b]][0] <= at:
            open_ = [i for i in open_ if branches[i][1] > at]
            while b < len(order) and branches[order[b]][0] <= at:
                if branches[order[b]][1] > at:
                    open_.append(order[b])
                b += 1
        function = branch = None
        if entered:
            function = entered[-1]
            low, high = functions[function]["start"], functions[function]["end"]
            best = None
            for i in reversed(open_):
                start, end = branches[i]
                if start < low:
                    break
                if end > at and end <= high and (best is None or (end - start, i) < best):
                    best = (end - start, i)
            branch = best[1] if best else None
        out.append({**call, "function": function, "branch": branch})
    return out


def _facts(path: str, text: str) -> tuple:
    if not re.search(r"\.(ts|tsx|js|jsx|mjs|cjs)$", path or ""):
        return [], [], [], [], [], []
    x = extract.Text(text)
    functions = extract.functions(x)
    names = {f["name_at"] for f in functions}
    functions = [{k: v for k, v in f.items() if k != "name_at"} | {"params": [dict(zip(("name", "type", "optional"), p)) for p in f["params"]], "class_name": f["class_name"] or None} for f in functions]
    spans = extract.branches(x)
    return (
        [{"specifier": s, "is_reexport": r} for s, r in extract.imports(x)],
        [dict(zip(("local_name", "imported_name", "specifier"), b)) for b in extract.bindings(x)],
        functions,
        attribute(extract.calls(x, names), functions, spans),
        [{"start": a, "end": b} for a, b in spans],
        [dict(zip(("name", "body", "is_interface", "exported"), t)) for t in extract.type_declarations(text)],
    )


def facts(files: DataFrame) -> DataFrame:
    """part, path and the nested FACTS of every file (part, path, content). Null contents give empty facts; files of
    other kinds too. Paths are taken as given (canonical)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(part, path, *_facts(path, text or "")) for part, path, text in zip(x["part"], x["path"], x["content"])]
            yield pd.DataFrame(rows, columns=["part", "path", "imports", "bindings", "functions", "calls", "branches", "types"])

    return files.select("part", "path", "content").mapInPandas(run, f"part long, path string, {FACTS}")


def imports_of(found: DataFrame) -> DataFrame:
    return found.select("part", "path", F.posexplode("imports").alias("pos", "x")).select("part", "path", "pos", "x.*")


def bindings_of(found: DataFrame) -> DataFrame:
    return found.select("part", "path", F.explode("bindings").alias("x")).select("part", "path", "x.*")


def functions_of(found: DataFrame) -> DataFrame:
    """part, path, order (by position) and the columns of a function."""
    return found.select("part", "path", F.posexplode("functions").alias("order", "x")).select("part", "path", "order", "x.*")


def types_of(found: DataFrame) -> DataFrame:
    return found.select("part", "path", F.explode("types").alias("x")).select("part", "path", "x.*")


def calls_of(found: DataFrame) -> DataFrame:
    """Calls inside functions: part, path, order (of the function), pos, the columns of a call, branch_id (null
    outside branches), branchy, call_order (within the function, by position)."""
    rows = found.select("part", "path", F.posexplode("calls").alias("pos", "c")).where("c.function is not null")
    names = ["start", "callee_text", "callee_root", "member_path", "arg_texts"]
    out = rows.select("part", "path", F.col("c.function").alias("order"), "pos", *[f"c.{n}" for n in names], F.col("c.branch").alias("branch_id"))
    w = Window.partitionBy("part", "path", "order").orderBy("start", "pos")  # the calls of one function
    return out.withColumn("call_order", F.row_number().over(w) - 1).withColumn("branchy", F.col("branch_id").isNotNull())
