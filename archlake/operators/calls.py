"""The call graph: every call resolved by a cascade of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlake.operators import extraction
from archlake.operators.resolve import resolve_imports
from archlake.session import Scratch


def exported_index(functions: DataFrame) -> DataFrame:
    """part, module, export_name -> order. Names of exported functions (the last wins); short names of exported
    methods (the first wins, below full names); ``default`` for default exports."""
    e = functions.where("exported")
    named = e.groupBy("part", F.col("path").alias("module"), F.col("name").alias("export_name")).agg(F.max("order").alias("order")).withColumn("rank", F.lit(0))
    default = e.where("is_default").groupBy("part", F.col("path").alias("module")).agg(F.max("order").alias("order")).select("part", "module", F.lit("default").alias("export_name"), "order", F.lit(1).alias("rank"))
    short = e.where("is_method").groupBy("part", F.col("path").alias("module"), F.element_at(F.split("name", r"\."), -1).alias("export_name")).agg(F.min("order").alias("order")).withColumn("rank", F.lit(2))
    return named.unionByName(default).unionByName(short).groupBy("part", "module", "export_name").agg(F.min_by("order", "rank").alias("order"))


def resolve_calls(calls: DataFrame, functions: DataFrame, bindings: DataFrame, reexports: DataFrame) -> DataFrame:
    """``calls`` with resolution (resolved, unresolved_imported, external, unresolved_local, method) and the target
    function (target_module, target_order).

    ``bindings``: part, path, local_name, imported_name, target (module path or null);
    ``reexports``: part, path, target. A plain name is looked up among the file's
    functions, then its imports, then one re-export hop behind the import; a
    member call through a namespace import among that module's exports. ``this.x``
    and all other member calls stay methods.
    """
    local = functions.groupBy("part", "path", F.col("name").alias("callee_root")).agg(F.max("order").alias("local_order"))
    names = bindings.groupBy("part", "path", F.col("local_name").alias("callee_root")).agg(F.max(F.struct("imported_name", "target")).alias("b"))
    index = exported_index(functions)
    plain = F.size("member_path") == 0
    star = F.col("b.imported_name") == "*"
    rows = (
        calls.join(local, ["part", "path", "callee_root"], "left").join(names, ["part", "path", "callee_root"], "left")
        .withColumn("module", F.col("b.target"))
        .withColumn("wanted", F.when(plain, F.col("b.imported_name")).when(star, F.element_at("member_path", -1)))
    )
    direct = index.select("part", "module", F.col("export_name").alias("wanted"), F.col("order").alias("direct_order"))
    hop = (
        reexports.where("target is not null").select("part", F.col("path").alias("module"), F.col("target").alias("hop_module"))
        .join(index.select("part", F.col("module").alias("hop_module"), F.col("export_name").alias("wanted"), F.col("order").alias("hop_order")), ["part", "hop_module"])
        .groupBy("part", "module", "wanted").agg(F.min(F.struct("hop_module", "hop_order")).alias("hop"))
    )
    rows = rows.join(direct, ["part", "module", "wanted"], "left").join(hop, ["part", "module", "wanted"], "left")
    found = (
        F.when(plain & F.col("local_order").isNotNull(), F.struct(F.col("path").alias("module"), F.col("local_order").alias("order")))
        .when(F.col("direct_order").isNotNull() & (F.col("callee_root") != "this"), F.struct("module", F.col("direct_order").alias("order")))
        .when(plain & F.col("hop").isNotNull(), F.struct(F.col("hop.hop_module").alias("module"), F.col("hop.hop_order").alias("order")))
    )
    kind = (
        F.when(F.col("found").isNotNull(), "resolved")
        .when(plain & F.col("b").isNotNull(), F.when(F.col("module").isNotNull(), "unresolved_imported").otherwise("external"))
        .when(plain, "unresolved_local")
        .when(star & F.col("module").isNotNull() & (F.col("callee_root") != "this"), "unresolved_imported")
        .otherwise("method")
    )
    out = rows.withColumn("found", found).withColumn("resolution", kind)
    return out.select(*calls.columns, "resolution", F.col("found.module").alias("target_module"), F.col("found.order").alias("target_order"))


class CallGraph:
    """functions and calls (resolved) of source texts (part, path, content); ``modules`` (part, path) are what imports can lead to."""

    def __init__(self, files: DataFrame, modules: DataFrame):
        self.facts = Scratch(files.sparkSession, "facts").write(extraction.facts(files), "facts")  # read by every part below
        self.functions = extraction.functions_of(self.facts)
        imports = extraction.imports_of(self.facts)
        self.imports = resolve_imports(imports, modules)
        self.bindings = resolve_imports(extraction.bindings_of(self.facts), modules)
        self.calls = resolve_calls(extraction.calls_of(self.facts), self.functions, self.bindings, self.imports.where("is_reexport"))

    def edges(self) -> DataFrame:
        """Resolved calls by caller and callee: call_count, branchy (any)."""
        return self.calls.where("resolution = 'resolved'").groupBy("part", "path", "order", "target_module", "target_order").agg(
            F.count(F.lit(1)).alias("call_count"), F.bool_or("branchy").alias("branchy")
        )

    def degrees(self) -> DataFrame:
        """Every function with its resolved calls and its distinct callers and callees."""
        e = self.edges()
        out = e.groupBy("part", "path", "order").agg(F.sum("call_count").alias("resolved_calls"), F.count(F.lit(1)).alias("fan_out"))
        into = e.groupBy("part", F.col("target_module").alias("path"), F.col("target_order").alias("order")).agg(F.count(F.lit(1)).alias("fan_in"))
        keys = ["part", "path", "order"]
        return self.functions.select(*keys, "name", "exported", "is_method").join(out, keys, "left").join(into, keys, "left").fillna(0, ["resolved_calls", "fan_out", "fan_in"])

    def report(self) -> DataFrame:
        """Per part: functions, resolved and unresolved calls."""
        f = self.functions.groupBy("part").agg(F.count(F.lit(1)).alias("functions"))
        c = self.calls.groupBy("part").agg(F.count_if(F.col("resolution") == "resolved").alias("resolved_calls"), F.count_if(F.col("resolution") != "resolved").alias("unresolved_calls"))
        return f.join(c, "part", "full_outer").fillna(0)
