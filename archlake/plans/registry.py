"""Queries of the architecture-graph operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.operators import graph, rollup, rules, signals, trends
from archlake.operators.snapshot_delta import history_delta, module_changes
from archlake.plans.sql import CANON, MODULES, STEPS
from archlake.plans.text_sql import CLASSES, CLUSTERS, candidates, folded
from archlake.sources.tables import current_modules, deliveries, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: the rules of the queries: top-level folders as boundaries, lower layers first
RULES = rules.Rules(
    boundaries={
        "core": ["packages/**"], "libs": ["libs/**"], "services": ["services/**"], "apps": ["apps/**"], "tools": ["tools/*"],
        "tests": ["**/*.test.ts", "**/*.test.[jt]sx"],
    },
    forbidden=[
        {"from": "core", "to": "apps", "reason": "shared packages must not know the apps"},
        {"from": "tools", "to": "services", "reason": ""},
        {"from": "libs/*/src/*", "to": "tests"},
    ],
    canonical=[{"concept": "*/index.ts", "path": "packages/shared/src/index.ts"}],
    layers=["core", "libs", "services", "apps"],
)

_EDGES = """ce AS (
  SELECT e.snapshot_id, e.from_id, e.to_id, coalesce(lower(trim(e.kind)), 'imports') AS kind,
         (array_agg(e.specifier ORDER BY e.scanned_at NULLS LAST, e.specifier NULLS FIRST))[1] AS specifier
  FROM edges e JOIN mods f ON f.snapshot_id = e.snapshot_id AND f.id = e.from_id
  JOIN mods t ON t.snapshot_id = e.snapshot_id AND t.id = e.to_id GROUP BY ALL)"""
_METRICS = """met AS (
  SELECT m.snapshot_id, m.id, m.path, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out,
         coalesce(o.n, 0) / t.n AS coupling,
         CASE WHEN coalesce(i.n, 0) + coalesce(o.n, 0) > 0 THEN coalesce(o.n, 0) / (coalesce(i.n, 0) + coalesce(o.n, 0)) ELSE 0.0 END AS instability
  FROM mods m JOIN (SELECT snapshot_id, count(*) AS n FROM mods GROUP BY 1) t ON t.snapshot_id = m.snapshot_id
  LEFT JOIN (SELECT snapshot_id, to_id AS id, count(*) AS n FROM ce GROUP BY ALL) i ON i.snapshot_id = m.snapshot_id AND i.id = m.id
  LEFT JOIN (SELECT snapshot_id, from_id AS id, count(*) AS n FROM ce GROUP BY ALL) o ON o.snapshot_id = m.snapshot_id AND o.id = m.id)"""
_BASE = f"{MODULES}, {_EDGES}"
# the rules above, spelled out
_IN = {
    "core": "regexp_matches({0}, '^packages/')", "libs": "regexp_matches({0}, '^libs/')", "services": "regexp_matches({0}, '^services/')",
    "apps": "regexp_matches({0}, '^apps/')", "tools": "regexp_matches({0}, '^tools/')",
    "tests": "({0} LIKE '%.test.ts' OR {0} LIKE '%.test.jsx' OR {0} LIKE '%.test.tsx')",
}
_ANY = lambda p: "(" + " OR ".join(x.format(p) for x in _IN.values()) + ")"
_LAYER = lambda p: "CASE " + " ".join(f"WHEN {_IN[x].format(p)} THEN {i}" for i, x in enumerate(RULES.layers)) + " END"
_LAYERNAME = lambda p: "CASE " + " ".join(f"WHEN {_IN[x].format(p)} THEN '{x}'" for x in RULES.layers) + " END"
_VIOLATIONS = f"""pe AS (
  SELECT ce.*, f.path AS from_path, t.path AS to_path FROM ce JOIN mods f ON f.snapshot_id = ce.snapshot_id AND f.id = ce.from_id
  JOIN mods t ON t.snapshot_id = ce.snapshot_id AND t.id = ce.to_id),
vi AS (
  SELECT snapshot_id, 'forbidden: core → apps' AS rule, 'Error' AS severity, from_path, to_path, 'shared packages must not know the apps' AS message, 0 AS rule_order
  FROM pe WHERE {_IN['core'].format('from_path')} AND {_IN['apps'].format('to_path')}
  UNION ALL SELECT snapshot_id, 'forbidden: tools → services', 'Error', from_path, to_path, '''tools'' must not import ''services''', 1
  FROM pe WHERE {_IN['tools'].format('from_path')} AND {_IN['services'].format('to_path')}
  UNION ALL SELECT snapshot_id, 'forbidden: libs/*/src/* → tests', 'Error', from_path, to_path, '''libs/*/src/*'' must not import ''tests''', 2
  FROM pe WHERE {_ANY('from_path')} AND from_path LIKE 'libs/%/src/%' AND {_IN['tests'].format('to_path')}
  UNION ALL SELECT snapshot_id, 'layer: ' || {_LAYERNAME('from_path')} || ' < ' || {_LAYERNAME('to_path')}, 'Error', from_path, to_path,
    '''' || from_path || ''' (layer ''' || {_LAYERNAME('from_path')} || ''') must not import ''' || to_path || ''' (layer ''' || {_LAYERNAME('to_path')} || ''')', 2000000
  FROM pe WHERE {_LAYER('from_path')} < {_LAYER('to_path')}
  UNION ALL SELECT m.snapshot_id, 'canonical: */index.ts', 'Warning', m.path, 'packages/shared/src/index.ts',
    '''' || m.path || ''' matches the ''*/index.ts'' concept, which already has a canonical implementation at ''packages/shared/src/index.ts''', 1000000
  FROM mods m JOIN (SELECT snapshot_id FROM mods WHERE path LIKE '%/index.ts' GROUP BY 1 HAVING count(*) > 1) s ON s.snapshot_id = m.snapshot_id
  WHERE m.path LIKE '%/index.ts' AND m.path <> 'packages/shared/src/index.ts')"""
# strong components by mutual reachability; modules without in- or outgoing edges are left out of the closure
_SCC = """core0 AS (SELECT DISTINCT snapshot_id AS s, from_id AS f, to_id AS t FROM ce WHERE from_id <> to_id),
core1 AS (SELECT * FROM core0 c WHERE (s, f) IN (SELECT (s, t) FROM core0) AND (s, t) IN (SELECT (s, f) FROM core0)),
core2 AS (SELECT * FROM core1 c WHERE (s, f) IN (SELECT (s, t) FROM core1) AND (s, t) IN (SELECT (s, f) FROM core1)),
core3 AS (SELECT * FROM core2 c WHERE (s, f) IN (SELECT (s, t) FROM core2) AND (s, t) IN (SELECT (s, f) FROM core2)),
reach(s, f, t) AS (SELECT s, f, t FROM core3 UNION SELECT r.s, r.f, c.t FROM reach r JOIN core3 c ON c.s = r.s AND c.f = r.t),
mutual AS (SELECT a.s, a.f AS id, min(a.t) AS m FROM reach a JOIN reach b ON b.s = a.s AND b.f = a.t AND b.t = a.f GROUP BY ALL),
sid AS (SELECT m.snapshot_id, m.id, coalesce(least(x.m, m.id), m.id) AS scc_id FROM mods m LEFT JOIN mutual x ON x.s = m.snapshot_id AND x.id = m.id),
scc AS (SELECT snapshot_id, id, scc_id, count(*) OVER (PARTITION BY snapshot_id, scc_id) AS scc_size FROM sid)"""


class Model:
    """The tables of one delivery folder, as DataFrames that share snapshot_id."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = lambda name: table(spark, sf_dir, name)
        self.modules = current_modules(self.t("modules"))
        self.edges = graph.clean_edges(self.t("modules"), self.t("edges"))

    def metrics(self) -> DataFrame:
        return graph.module_metrics(self.modules, self.edges)

    def components(self) -> DataFrame:
        return graph.strong_components(self.modules, self.t("edges"))

    def violations(self) -> DataFrame:
        return rules.violations(self.modules, self.edges, RULES)

    def violating(self) -> DataFrame:
        """snapshot_id, from_id, to_id of edges with a violation of any kind."""
        ids = self.modules.select("snapshot_id", "id", "path")
        v = self.violations().select("snapshot_id", "from_path", "to_path").distinct()
        return v.join(ids.select("snapshot_id", F.col("id").alias("from_id"), F.col("path").alias("from_path")), ["snapshot_id", "from_path"]).join(
            ids.select("snapshot_id", F.col("id").alias("to_id"), F.col("path").alias("to_path")), ["snapshot_id", "to_path"]
        )

    def loc(self) -> DataFrame:
        """snapshot_id, id, path, loc: the largest recorded loc of each module."""
        recorded = self.t("module_metrics").groupBy("snapshot_id", "id").agg(F.max("loc").alias("loc"))
        return self.modules.join(recorded, ["snapshot_id", "id"], "left")

    def delta(self) -> DataFrame:
        return history_delta(self.t("snapshots"), self.t("modules"), self.t("edges"))

    def changed(self) -> DataFrame:
        """snapshot_id, path, delta of modules added or removed."""
        return module_changes(self.t("snapshots"), self.t("modules"))


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("edge_dedup", f"WITH {_BASE} SELECT * FROM ce")
def _(m):
    return m.edges


@query("module_metrics", f"WITH {_BASE}, {_METRICS} SELECT snapshot_id, id, path, fan_in, fan_out, round(coupling, 6) AS coupling, round(instability, 6) AS instability FROM met")
def _(m):
    return m.metrics().withColumns({"coupling": F.round("coupling", 6), "instability": F.round("instability", 6)})


@query("strong_components", f"WITH RECURSIVE {_BASE}, {_SCC} SELECT snapshot_id, id, scc_id, scc_size FROM scc")
def _(m):
    return m.components()


@query("strong_components_spread", f"WITH RECURSIVE {_BASE}, {_SCC} SELECT snapshot_id, id, scc_id, scc_size FROM scc")
def _(m):  # no snapshot is solved in one task
    return graph.strong_components(m.modules, m.t("edges"), local_edges=0)


@query("cycle_counts", f"""WITH RECURSIVE {_BASE}, {_SCC}
SELECT snapshot_id, count(DISTINCT scc_id) FILTER (WHERE scc_size > 1) AS cycles, count(*) FILTER (WHERE scc_size > 1) AS modules_in_cycles FROM scc GROUP BY 1""")
def _(m):
    c = m.components()
    return c.groupBy("snapshot_id").agg(F.count_distinct(F.when(F.col("scc_size") > 1, F.col("scc_id"))).alias("cycles"), F.count_if(F.col("scc_size") > 1).alias("modules_in_cycles"))


@query("boundary_members", f"WITH {MODULES} " + " UNION ALL ".join(f"SELECT snapshot_id, id, path, '{b}' AS boundary FROM mods WHERE {c.format('path')}" for b, c in _IN.items()))
def _(m):
    return rules.boundary_members(m.modules, RULES)


@query("assign_layers", f"WITH {MODULES} SELECT snapshot_id, id, path, {_LAYERNAME('path')} AS layer FROM mods WHERE {_LAYERNAME('path')} IS NOT NULL")
def _(m):
    return rules.assign_layers(m.modules, RULES)


@query("populated_layers", f"WITH {MODULES} SELECT snapshot_id, {_LAYER('path')} AS layer_index, count(*) AS modules FROM mods WHERE {_LAYER('path')} IS NOT NULL GROUP BY ALL")
def _(m):
    return m.modules.groupBy("snapshot_id", RULES.layer_index(F.col("path")).alias("layer_index")).agg(F.count(F.lit(1)).alias("modules")).where("layer_index is not null")


@query("violations", f"WITH {_BASE}, {_VIOLATIONS} SELECT * FROM vi")
def _(m):
    return m.violations()


@query("scorecard", f"""WITH {_BASE}, {_VIOLATIONS}
SELECT snapshot_id, count(*) FILTER (WHERE severity = 'Error') AS errors, count(*) FILTER (WHERE severity = 'Warning') AS warnings,
       count(*) FILTER (WHERE severity = 'Error') = 0 AS passes FROM vi GROUP BY 1""")
def _(m):
    return rules.scorecard(m.violations())


@query("ordered_violations", f"""WITH {_BASE}, {_VIOLATIONS}
SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY severity <> 'Error', rule_order, from_path, to_path, rule) AS place FROM vi""")
def _(m):
    return rules.ordered_violations(m.violations())


@query("violations_of_module", f"""WITH {_BASE}, {_VIOLATIONS}
SELECT snapshot_id, path, count(*) AS touching FROM (
  SELECT snapshot_id, from_path AS path FROM vi UNION ALL SELECT snapshot_id, to_path FROM vi WHERE to_path <> from_path) GROUP BY ALL""")
def _(m):
    v = m.violations()
    ends = v.select("snapshot_id", F.col("from_path").alias("path")).unionByName(v.where("to_path <> from_path").select("snapshot_id", F.col("to_path").alias("path")))
    return ends.groupBy("snapshot_id", "path").agg(F.count(F.lit(1)).alias("touching"))


@query("infer_boundaries", f"WITH {MODULES} SELECT snapshot_id, split_part(path, '/', 1) AS boundary, count(*) AS files, split_part(path, '/', 1) || '/**' AS glob FROM mods GROUP BY ALL")
def _(m):
    return rules.infer_boundaries(m.modules)


_LOC = """ml AS (SELECT m.*, x.loc FROM mods m LEFT JOIN (SELECT snapshot_id, id, max(loc) AS loc FROM module_metrics GROUP BY ALL) x
  ON x.snapshot_id = m.snapshot_id AND x.id = m.id)"""
_PLACE = "CASE group_key " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(RULES.layers)) + " ELSE 1073741824 END"
_NODES = lambda place: f"""SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY {place}, group_key) - 1 AS group_id, group_key,
  CASE WHEN group_key LIKE 'scc:%' THEN 'cycle cluster (' || file_count || ' files)' ELSE split_part(group_key, '/', -1) END AS label, file_count, loc,
  group_key LIKE 'scc:%' AS is_cluster
FROM (SELECT g.snapshot_id, group_key, count(*) AS file_count, sum(coalesce(loc, 0))::BIGINT AS loc FROM g JOIN ml ON ml.snapshot_id = g.snapshot_id AND ml.id = g.id GROUP BY ALL)"""  # noqa: E731
_GROUPS = {
    "directory": "g AS (SELECT snapshot_id, id, array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS group_key FROM mods)",
    "layer": f"g AS (SELECT snapshot_id, id, coalesce({_LAYERNAME('path')}, '(unassigned)') AS group_key FROM mods)",
    "scc": "g AS (SELECT s.snapshot_id, s.id, CASE WHEN scc_size > 1 THEN 'scc:' || scc_id ELSE path END AS group_key FROM scc s JOIN mods m ON m.snapshot_id = s.snapshot_id AND m.id = s.id)",
}
_GEDGES = f"""bad AS (SELECT DISTINCT v.snapshot_id, f.id AS from_id, t.id AS to_id FROM vi v JOIN mods f ON f.snapshot_id = v.snapshot_id AND f.path = v.from_path
  JOIN mods t ON t.snapshot_id = v.snapshot_id AND t.path = v.to_path),
ge AS (SELECT ce.snapshot_id, a.group_key AS from_group, b.group_key AS to_group, count(*) AS weight, bool_or(bad.from_id IS NOT NULL) AS violation,
    bool_or(coalesce({_LAYER('f.path')} < {_LAYER('t.path')}, false)) AS cross_layer_up
  FROM ce JOIN g a ON a.snapshot_id = ce.snapshot_id AND a.id = ce.from_id JOIN g b ON b.snapshot_id = ce.snapshot_id AND b.id = ce.to_id
  JOIN mods f ON f.snapshot_id = ce.snapshot_id AND f.id = ce.from_id JOIN mods t ON t.snapshot_id = ce.snapshot_id AND t.id = ce.to_id
  LEFT JOIN bad ON bad.snapshot_id = ce.snapshot_id AND bad.from_id = ce.from_id AND bad.to_id = ce.to_id
  WHERE a.group_key <> b.group_key GROUP BY ALL)"""


def _grouped(m, by):
    return rollup.group_of(m.modules, by, 2, RULES, m.components() if by == "scc" else None)


def _group_edges(m, groups):
    layers = m.modules.select("snapshot_id", "id", RULES.layer_index(F.col("path")).alias("layer_index"))
    return rollup.group_edges(m.edges, groups, m.violating(), layers)


for _by in ("directory", "layer", "scc"):
    _with = f"WITH RECURSIVE {_BASE}, {_SCC}" if _by == "scc" else f"WITH {_BASE}"

    @query(f"rollup_{_by}", f"{_with}, {_LOC}, {_GROUPS[_by]} {_NODES(_PLACE if _by == 'layer' else '0')}")
    def _(m, by=_by):
        return rollup.group_nodes(m.loc(), _grouped(m, by), RULES if by == "layer" else None)

    @query(f"rollup_edges_{_by}", f"{_with}, {_VIOLATIONS}, {_GROUPS[_by]}, {_GEDGES} SELECT *, CASE WHEN violation THEN 'violation' WHEN cross_layer_up THEN 'upward' ELSE 'normal' END AS edge_class FROM ge")
    def _(m, by=_by):
        e = _group_edges(m, _grouped(m, by))
        return e.withColumn("edge_class", rollup.group_edge_class(F.col("violation"), F.col("cross_layer_up")))


@query("group_signals", f"""WITH {_BASE}, {_LOC}, {_VIOLATIONS}, {_GROUPS['directory']}, {_GEDGES},
ends AS (SELECT snapshot_id, from_group AS group_key, 0 AS i, weight AS o, violation FROM ge UNION ALL SELECT snapshot_id, to_group, weight, 0, violation FROM ge),
s AS (SELECT snapshot_id, group_key, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out, bool_or(violation) AS v FROM ends GROUP BY ALL)
SELECT n.snapshot_id, n.group_key, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, fan_in IS NULL AS is_orphan, coalesce(v, false) AS is_violation, false AS is_cycle
FROM (SELECT DISTINCT snapshot_id, group_key FROM g) n LEFT JOIN s ON s.snapshot_id = n.snapshot_id AND s.group_key = n.group_key""")
def _(m):
    groups = _grouped(m, "directory")
    return rollup.group_signals(rollup.group_nodes(m.loc(), groups), _group_edges(m, groups))



@query("trends", f"""WITH {_BASE}, {_METRICS}, {_VIOLATIONS},
h AS (SELECT snapshot_id, max(snapshot_label) AS label, min(saved_at) AS saved_at FROM snapshots GROUP BY 1)
SELECT h.snapshot_id, h.label, h.saved_at, coalesce(m.n, 0) AS file_count, coalesce(e.n, 0) AS edge_count, round(coalesce(fi / m.n, 0), 2) AS avg_fan_in,
  round(coalesce(fo / m.n, 0), 2) AS avg_fan_out, round(coalesce(co / m.n * 100, 0), 2) AS avg_coupling, coalesce(v.n, 0) AS violation_count
FROM h LEFT JOIN (SELECT snapshot_id, count(*) AS n, sum(fan_in) AS fi, sum(fan_out) AS fo, sum(coupling) AS co FROM met GROUP BY 1) m ON m.snapshot_id = h.snapshot_id
LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM ce GROUP BY 1) e ON e.snapshot_id = h.snapshot_id
LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM vi GROUP BY 1) v ON v.snapshot_id = h.snapshot_id""")
def _(m):
    return trends.trend_points(m.t("snapshots"), m.metrics(), m.edges, m.violations())


@query("snapshot_list", f"""WITH {STEPS}
SELECT s.repo, s.snapshot_id, s.step, coalesce(s.previous_id, -1) AS previous_id, l.label, CASE WHEN length(l.label) > 12 THEN right(l.label, 10) ELSE l.label END AS short_label,
  array_to_string(list_slice(list_filter(string_split(s.repo, '/'), lambda x: x <> ''), -2, -1), '/') AS display_root
FROM steps s JOIN (SELECT snapshot_id, max(snapshot_label) AS label FROM snapshots GROUP BY 1) l ON l.snapshot_id = s.snapshot_id""")
def _(m):
    labels = m.t("snapshots").groupBy("snapshot_id").agg(F.max("snapshot_label").alias("label"))
    s = deliveries(m.t("snapshots")).join(labels, "snapshot_id")
    return s.select("repo", "snapshot_id", "step", F.coalesce("previous_id", F.lit(-1)).alias("previous_id"), "label", trends.short_label(F.col("label")).alias("short_label"), trends.display_root(F.col("repo")).alias("display_root"))


_POINTS = f"""{STEPS}, pt AS (SELECT s.repo, s.snapshot_id, h.saved_at, l.label, s.step FROM steps s JOIN heads h ON h.snapshot_id = s.snapshot_id
  JOIN (SELECT snapshot_id, max(snapshot_label) AS label FROM snapshots GROUP BY 1) l ON l.snapshot_id = s.snapshot_id),
bl AS (SELECT repo, max(label) AS label FROM pt WHERE label IS NOT NULL AND step > 1 GROUP BY 1)"""


def _points(m):
    """The deliveries of every repository with their labels, and as its baseline the last label, by text, after the first delivery."""
    labels = m.t("snapshots").groupBy("snapshot_id").agg(F.max("snapshot_label").alias("label"), F.min("saved_at").alias("saved_at"))
    points = deliveries(m.t("snapshots")).join(labels, "snapshot_id").select("repo", "snapshot_id", "saved_at", "label", "step")
    return points, points.where("label is not null and step > 1").groupBy("repo").agg(F.max("label").alias("label"))


@query("baseline_positions", f"WITH {_POINTS} SELECT pt.repo, coalesce(min(step - 1) FILTER (WHERE pt.label = bl.label), -1) AS position FROM pt LEFT JOIN bl ON bl.repo = pt.repo GROUP BY ALL")
def _(m):
    return trends.baseline_positions(*_points(m))


@query("default_from", f"""WITH {_POINTS} SELECT p.repo, coalesce(bl.label, p.label, '') AS label FROM pt p LEFT JOIN bl ON bl.repo = p.repo WHERE p.step = 1""")
def _(m):
    return trends.default_from(*_points(m))


@query("seen_labels", "SELECT snapshot_id, floor(epoch(min(saved_at)))::BIGINT AS saved_unix, 'seen_' || floor(epoch(min(saved_at)))::BIGINT AS label FROM snapshots WHERE snapshot_id IS NOT NULL GROUP BY 1")
def _(m):
    from archlake.functions.labels import seen_label, unix_seconds

    saved = m.t("snapshots").where("snapshot_id is not null").groupBy("snapshot_id").agg(F.min("saved_at").alias("saved_at"))
    return saved.select("snapshot_id", unix_seconds(F.col("saved_at")).alias("saved_unix"), seen_label(F.col("saved_at")).alias("label"))


@query("hub_thresholds", f"""WITH {_BASE}, {_METRICS}
SELECT snapshot_id, greatest(2, list_sort(list(fan_in))[floor(0.9 * count(*))::INT + 1]) AS hub_at FROM met GROUP BY 1""")
def _(m):
    return signals.hub_thresholds(m.metrics())


_SIGNALS = f"""hub AS (SELECT snapshot_id, greatest(2, list_sort(list(fan_in))[floor(0.9 * count(*))::INT + 1]) AS hub_at FROM met GROUP BY 1),
dup AS (SELECT DISTINCT r.snapshot_id, {CANON.format('p.f')} AS path FROM (SELECT report_id, file_a AS f, similarity FROM dupe_pairs WHERE file_a IS NOT NULL AND file_b IS NOT NULL UNION ALL
  SELECT report_id, file_b, similarity FROM dupe_pairs WHERE file_a IS NOT NULL AND file_b IS NOT NULL) p JOIN dupe_reports r ON r.report_id = p.report_id WHERE p.similarity >= coalesce(r.threshold, 0.60::FLOAT)),
add AS (SELECT p.snapshot_id, m.path FROM steps p JOIN mods m ON m.snapshot_id = p.snapshot_id LEFT JOIN mods o ON o.snapshot_id = p.previous_id AND o.path = m.path WHERE p.previous_id IS NOT NULL AND o.path IS NULL),
sig AS (SELECT met.snapshot_id, met.id, met.path, round(instability, 6) AS instability, fan_in >= hub_at AS is_hub, fan_in = 0 AND fan_out = 0 AS is_orphan, scc_size > 1 AS is_cycle,
  EXISTS (SELECT 1 FROM vi WHERE severity = 'Error' AND vi.snapshot_id = met.snapshot_id AND vi.from_path = met.path) AS is_violation_src,
  EXISTS (SELECT 1 FROM dup WHERE dup.snapshot_id = met.snapshot_id AND dup.path = met.path) AS is_dupe,
  CASE WHEN EXISTS (SELECT 1 FROM add WHERE add.snapshot_id = met.snapshot_id AND add.path = met.path) THEN 'added' ELSE 'unchanged' END AS change_status
  FROM met JOIN hub ON hub.snapshot_id = met.snapshot_id JOIN scc ON scc.snapshot_id = met.snapshot_id AND scc.id = met.id)"""


def _signals(m):
    from archlake.functions.paths import canonical_path

    r, p = m.t("dupe_reports"), m.t("dupe_pairs").where("file_a is not null and file_b is not null")
    linked = p.join(r.select("report_id", "snapshot_id", F.coalesce("threshold", F.lit(0.6).cast("float")).alias("t")), "report_id").where("similarity >= t and not isnan(similarity)")
    dupes = linked.select("snapshot_id", F.explode(F.array(canonical_path("file_a"), canonical_path("file_b"))).alias("path"))
    s = signals.module_signals(m.metrics(), m.components(), m.violations(), dupes, m.changed())
    return s.withColumn("instability", F.round("instability", 6))


_SIGWITH = f"WITH RECURSIVE {_BASE}, {_METRICS}, {_SCC}, {_VIOLATIONS}, {STEPS}, {_SIGNALS}"


@query("module_signals", f"{_SIGWITH} SELECT * FROM sig")
def _(m):
    return _signals(m)


@query("module_badges", f"""{_SIGWITH} SELECT snapshot_id, id, array_to_string(list_filter([CASE WHEN is_cycle THEN 'cycle' END, CASE WHEN is_hub THEN 'hub' END,
  CASE WHEN is_violation_src THEN 'violation' WHEN is_dupe THEN 'dupe' END], lambda x: x IS NOT NULL), ',') AS badges FROM sig""")
def _(m):
    return signals.badges(_signals(m)).withColumn("badges", F.array_join("badges", ","))


@query("visible_hubs", f"{_SIGWITH} SELECT snapshot_id, id, path FROM sig WHERE lower(path) LIKE '%src%' AND is_hub AND NOT is_orphan")
def _(m):
    return signals.filter_modules(_signals(m), "SRC", is_hub=True).where("not is_orphan").select("snapshot_id", "id", "path")


@query("edge_classes", f"""WITH RECURSIVE {_BASE}, {_SCC}, {_VIOLATIONS},
bad AS (SELECT DISTINCT snapshot_id, from_path, to_path FROM vi)
SELECT pe.snapshot_id, pe.from_id, pe.to_id, pe.kind, CASE WHEN bad.from_path IS NOT NULL THEN 'violation' WHEN a.scc_size > 1 AND a.scc_id = b.scc_id THEN 'cycle'
  WHEN pe.kind = 'reexports' THEN 'reexport' ELSE 'import' END AS edge_class
FROM pe LEFT JOIN bad ON bad.snapshot_id = pe.snapshot_id AND bad.from_path = pe.from_path AND bad.to_path = pe.to_path
JOIN scc a ON a.snapshot_id = pe.snapshot_id AND a.id = pe.from_id JOIN scc b ON b.snapshot_id = pe.snapshot_id AND b.id = pe.to_id""")
def _(m):
    return signals.edge_classes(m.edges, m.components(), m.violating())


@query("neighbourhood", f"""WITH {_BASE}, ch AS (SELECT snapshot_id, id FROM mods WHERE id % 20 = 0)
SELECT DISTINCT * FROM (SELECT snapshot_id, id, 'self' AS direction FROM ch UNION ALL
SELECT ce.snapshot_id, ce.to_id, 'out' FROM ce JOIN ch ON ch.snapshot_id = ce.snapshot_id AND ch.id = ce.from_id UNION ALL
SELECT ce.snapshot_id, ce.from_id, 'in' FROM ce JOIN ch ON ch.snapshot_id = ce.snapshot_id AND ch.id = ce.to_id)""")
def _(m):  # the query set is every module whose id is divisible by 20, against all edges
    return graph.neighbours(m.edges, m.modules.where("id % 20 = 0").select("snapshot_id", "id"))


@query("neighbour_modules", f"""WITH {_BASE}, ch AS (SELECT snapshot_id, id FROM mods WHERE id % 20 = 0)
SELECT n.*, m.path FROM (SELECT DISTINCT ce.snapshot_id, ch.id AS chosen_id, 'out' AS direction, ce.to_id AS id FROM ce JOIN ch ON ch.snapshot_id = ce.snapshot_id AND ch.id = ce.from_id UNION ALL
SELECT DISTINCT ce.snapshot_id, ch.id, 'in', ce.from_id FROM ce JOIN ch ON ch.snapshot_id = ce.snapshot_id AND ch.id = ce.to_id) n JOIN mods m ON m.snapshot_id = n.snapshot_id AND m.id = n.id""")
def _(m):  # the same query set
    return graph.neighbour_modules(m.edges, m.modules.where("id % 20 = 0").select("snapshot_id", "id"), m.modules)


@query("visible_edges", f"""WITH {_BASE} SELECT ce.* FROM ce JOIN mods f ON f.snapshot_id = ce.snapshot_id AND f.id = ce.from_id AND contains(lower(f.path), 'src')
JOIN mods t ON t.snapshot_id = ce.snapshot_id AND t.id = ce.to_id AND contains(lower(t.path), 'src')""")
def _(m):
    return graph.visible_edges(m.edges, m.modules.where(F.lower("path").contains("src")))


@query("display_classes", f"""WITH {_BASE}, {_METRICS}, {_LOC}
SELECT met.snapshot_id, met.id, round(least(greatest(148 + coalesce(loc, 0) / 400 * 76, 148), 224))::BIGINT AS node_width,
  CASE WHEN instability < 0.25 THEN 'stable' WHEN instability > 0.75 THEN 'unstable' ELSE 'balanced' END AS stability,
  CASE WHEN instability > 0.7 THEN 'hot' WHEN instability < 0.3 THEN 'cold' ELSE 'warm' END AS colour, round((met.id * 137.508::DOUBLE) % 360, 3) AS hue, met.id % 6 AS palette
FROM met JOIN ml ON ml.snapshot_id = met.snapshot_id AND ml.id = met.id""")
def _(m):
    rows = m.metrics().join(m.loc().select("snapshot_id", "id", "loc"), ["snapshot_id", "id"])
    return rows.select(
        "snapshot_id", "id", signals.node_width(F.coalesce("loc", F.lit(0))).alias("node_width"), signals.stability_label(F.col("instability")).alias("stability"),
        signals.instability_colour(F.col("instability")).alias("colour"), F.round(signals.module_hue(F.col("id")), 3).alias("hue"), signals.palette_index(F.col("id")).alias("palette"),
    )


def _delta_oracles() -> None:
    from archlake.plans.problems import ORACLES as problems

    delta = problems["p3_found"]
    ORACLES["delta_summary"] = f"""SELECT snapshot_id, modules_added, modules_removed, edges_added, edges_removed,
  modules_added || ' file(s) added, ' || modules_removed || ' removed | ' || edges_added || ' import edges added, ' || edges_removed || ' removed' AS summary
FROM (SELECT snapshot_id, count(*) FILTER (WHERE entity = 'module' AND delta = 'added') AS modules_added, count(*) FILTER (WHERE entity = 'module' AND delta = 'removed') AS modules_removed,
  count(*) FILTER (WHERE entity = 'edge' AND delta = 'added') AS edges_added, count(*) FILTER (WHERE entity = 'edge' AND delta = 'removed') AS edges_removed FROM ({delta}) GROUP BY 1)"""
    ORACLES["changed_paths"] = f"SELECT DISTINCT snapshot_id, path FROM ({delta}) WHERE entity = 'module' AND delta IN ('added', 'removed')"


@query("delta_summary")
def _(m):
    return trends.delta_summary(m.delta())


@query("changed_paths")
def _(m):
    return trends.changed_paths(m.delta())


_delta_oracles()


# --- texts, labels, flows -----------------------------------------------------------------------


@query("loc", """SELECT file_id, CASE WHEN content IS NULL OR content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS loc
FROM source_files""")
def _(m):
    from archlake.sources.files import line_count

    return m.t("source_files").select("file_id", line_count(F.col("content")).alias("loc"))


@query("source_modules", f"""WITH {MODULES} SELECT snapshot_id, id, path FROM mods WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs)$')
AND len(list_intersect(string_split(path, '/'), ['node_modules', '.git', 'dist', 'build', '.next', 'target', '.cache', '__pycache__', '.archlake'])) = 0""")
def _(m):
    from archlake.sources.files import is_source

    return m.modules.where(is_source(F.col("path")))


@query("label_codec", """SELECT snapshot_id, coalesce(max(snapshot_label), '') AS label, url_encode(coalesce(max(snapshot_label), '')) AS encoded, true AS round_trip FROM snapshots GROUP BY 1""")
def _(m):
    from archlake.functions.labels import decode_label, encode_label

    s = m.t("snapshots").groupBy("snapshot_id").agg(F.coalesce(F.max("snapshot_label"), F.lit("")).alias("label"))
    s = s.withColumn("encoded", encode_label(F.col("label")))
    return s.withColumn("round_trip", decode_label(F.col("encoded")) == F.col("label"))


_STEM = "split_part(split_part(path, '/', -1), '.', 1)"


@query("camel_words", rf"""WITH {MODULES}, w AS (SELECT snapshot_id, id, {_STEM} AS name FROM mods),
l AS (SELECT *, lower(regexp_replace(translate(name, '_-', '  '), '([^A-Z])([A-Z])', '\1 \2', 'g')) AS x FROM w)
SELECT snapshot_id, id, name, upper(substr(x, 1, 1)) || substr(x, 2) AS words FROM l""")
def _(m):
    from archlake.functions.labels import camel_words
    from archlake.functions.paths import basename

    name = F.split(basename(F.col("path")), r"\.")[0]
    return m.modules.select("snapshot_id", "id", name.alias("name"), camel_words(name).alias("words"))


_ENTRY = rf"""fn AS (SELECT m.snapshot_id AS part, m.id AS node, {_STEM.replace('path', 'm.path')} AS name, m.path, len(m.exports) AS exported, met.fan_out AS out_calls
  FROM mods m JOIN met ON met.snapshot_id = m.snapshot_id AND met.id = m.id),
kn AS (SELECT *, CASE WHEN lower(name) LIKE '%route%' OR lower(path) LIKE '%route%' OR lower(path) LIKE '%handler%' OR lower(name) LIKE '%handler' OR lower(name) LIKE '%controller' THEN 'route'
    WHEN name = 'main' OR lower(path) LIKE '%/cli/%' OR lower(path) LIKE '%/bin/%' THEN 'cli' WHEN lower(name) LIKE '%handler%' THEN 'handler' ELSE 'exported_entry' END AS kind FROM fn
  WHERE exported > 0 AND out_calls > 0 AND NOT contains(path, 'test') AND NOT contains(path, 'spec') AND NOT path LIKE '%.d.ts'),
en AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY kind <> 'exported_entry' DESC, out_calls DESC, name, node) AS rank FROM kn)"""


def _module_functions(m):
    """Modules read as functions: those with exports are exported, their edges are the calls."""
    from archlake.functions.paths import basename

    modules = current_modules(m.t("modules"), "exports")
    rows = m.metrics().join(modules.select("snapshot_id", "id", F.size(F.array_distinct(F.coalesce("exports", F.array().cast("array<string>")))).alias("surface")), ["snapshot_id", "id"])
    name = F.split(basename(F.col("path")), r"\.")[0]
    return rows.select(F.col("snapshot_id").alias("part"), F.col("id").alias("node"), F.col("id").alias("module"), name.alias("name"), "path", (F.col("surface") > 0).alias("exported"), F.col("fan_out").alias("out_calls"))


@query("entry_points", rf"WITH {_BASE}, {_METRICS}, {_ENTRY} SELECT part, node, path, kind, rank FROM en WHERE rank <= 30")
def _(m):
    from archlake.operators.flows import entry_points

    return entry_points(_module_functions(m)).select("part", "node", "path", "kind", "rank")


def _flows(m):
    from archlake.operators.flows import entry_points, flow_steps
    from archlake.session import Scratch

    entries = entry_points(_module_functions(m))
    calls = m.edges.select(
        F.col("snapshot_id").alias("part"), F.col("from_id").alias("caller"), F.col("to_id").alias("callee"), F.col("to_id").alias("call_order"),
        F.when(F.col("kind") == "reexports", 1).alias("branch"),
    )
    scratch = Scratch(m.spark, "flow-query")
    entries = scratch.write(entries, "entries")
    return entries, scratch.write(flow_steps(entries, calls), "steps")


def _flagged(m):
    from archlake.operators.flows import step_flags

    entries, steps = _flows(m)
    nodes = m.metrics().join(m.components(), ["snapshot_id", "id"]).select(F.col("snapshot_id").alias("part"), F.col("id").alias("node"), "path", "scc_id", "scc_size", "instability")
    bad = m.violations().select(F.col("snapshot_id").alias("part"), "from_path", "to_path")
    new = m.changed().select(F.col("snapshot_id").alias("part"), "path").distinct()
    return entries, step_flags(steps, nodes, bad, new)


# the walk as a stack machine: one move (show or leave a call) of every flow per round
_WALK = f"""{_ENTRY},
ca AS (SELECT snapshot_id AS part, from_id AS caller, to_id AS callee, CASE WHEN kind = 'reexports' THEN 1 END AS branch,
    row_number() OVER (PARTITION BY snapshot_id, from_id ORDER BY to_id, CASE WHEN kind = 'reexports' THEN 1 END NULLS FIRST) - 1 AS pos FROM ce),
mv AS (
  SELECT part, node AS entry, [{{'c': node, 'p': 0::BIGINT, 'd': 0, 's': NULL::INT}}] AS stack, [node] AS seen, 0 AS n, false AS cut, NULL::INT AS step, NULL::INT AS parent, NULL::BIGINT AS caller, NULL::BIGINT AS callee,
    NULL::INT AS depth, NULL::BOOLEAN AS recursion, NULL::INT AS branch FROM en WHERE rank <= 30
  UNION ALL
  SELECT part, entry,
    CASE WHEN NOT more THEN stack[1:len(stack) - 1] WHEN NOT shown THEN []
      ELSE stack[1:len(stack) - 1] || [{{'c': top.c, 'p': top.p + 1, 'd': top.d, 's': top.s}}] || CASE WHEN enter THEN [{{'c': callee, 'p': 0::BIGINT, 'd': top.d + 1, 's': n}}] ELSE [] END END,
    CASE WHEN enter THEN list_append(seen, callee) ELSE seen END, CASE WHEN shown THEN n + 1 ELSE n END, more AND NOT shown,
    CASE WHEN shown THEN n END, CASE WHEN shown THEN top.s END, CASE WHEN shown THEN top.c END, CASE WHEN shown THEN callee END, CASE WHEN shown THEN top.d END, CASE WHEN shown THEN again END, CASE WHEN shown THEN branch END
  FROM (SELECT *, shown AND NOT again AND top.d + 1 < 6 AS enter FROM (
    SELECT x.part, x.entry, x.stack, x.seen, x.n, x.top, k.callee, k.branch, k.callee IS NOT NULL AS more, k.callee IS NOT NULL AND x.n < 40 AS shown, coalesce(list_contains(x.seen, k.callee), false) AS again
    FROM (SELECT part, entry, stack, seen, n, stack[len(stack)] AS top FROM mv WHERE len(stack) > 0) x LEFT JOIN ca k ON k.part = x.part AND k.caller = x.top.c AND k.pos = x.top.p))),
fs AS (SELECT part, entry, step, parent, caller, callee, depth, recursion, branch, truncated FROM (SELECT *, bool_or(cut) OVER (PARTITION BY part, entry) AS truncated FROM mv) WHERE step IS NOT NULL)"""
_WALKS = f"WITH RECURSIVE {_BASE}, {_METRICS}, {_WALK}"
_FLAGS = f"""{_SCC}, {_VIOLATIONS}, {STEPS}, bd AS (SELECT DISTINCT snapshot_id, from_path, to_path FROM vi),
nm AS (SELECT p.snapshot_id, m.path FROM steps p JOIN mods m ON m.snapshot_id = p.snapshot_id WHERE p.previous_id IS NOT NULL),
om AS (SELECT p.snapshot_id, m.path FROM steps p JOIN mods m ON m.snapshot_id = p.previous_id),
ch AS ((SELECT * FROM nm EXCEPT SELECT * FROM om) UNION (SELECT * FROM om EXCEPT SELECT * FROM nm)),
nd AS (SELECT met.snapshot_id, met.id, met.path, met.instability, scc_id, scc_size FROM met JOIN scc ON scc.snapshot_id = met.snapshot_id AND scc.id = met.id),
fx AS (SELECT fs.*, f.scc_id AS fc, t.scc_id AS tc, f.scc_size AS fz, t.instability AS ti, bd.from_path IS NOT NULL AS bad, cf.path IS NOT NULL AS new_f, ct.path IS NOT NULL AS new_t
  FROM fs JOIN nd f ON f.snapshot_id = part AND f.id = caller JOIN nd t ON t.snapshot_id = part AND t.id = callee
  LEFT JOIN bd ON bd.snapshot_id = part AND bd.from_path = f.path AND bd.to_path = t.path LEFT JOIN ch cf ON cf.snapshot_id = part AND cf.path = f.path LEFT JOIN ch ct ON ct.snapshot_id = part AND ct.path = t.path),
fl AS (SELECT part, entry, step, 'metric' AS source, 'scc_cycle' AS code, 'Error' AS severity, 'This call crosses a circular dependency — both modules are in the same import cycle.' AS message FROM fx WHERE fc = tc AND fz > 1
  UNION ALL SELECT part, entry, step, 'metric', 'high_instability', 'Warning', 'Target module instability is ' || round_even(ti * 100, 0)::INT || '% — highly unstable modules change often.' FROM fx WHERE ti > 0.75
  UNION ALL SELECT part, entry, step, 'metric', 'violation', 'Error', 'This call crosses a boundary declared forbidden in the rules file.' FROM fx WHERE bad
  UNION ALL SELECT part, entry, step, 'churn', 'churn_caller', 'Warning', 'The calling module has changed since the baseline snapshot.' FROM fx WHERE new_f
  UNION ALL SELECT part, entry, step, 'churn', 'churn_callee', 'Warning', 'The called module has changed since the baseline snapshot.' FROM fx WHERE new_t),
ss AS (SELECT fs.part, fs.entry, fs.step, count(*) FILTER (WHERE severity = 'Error') AS errors, count(*) FILTER (WHERE severity = 'Warning') AS warnings,
    count(*) FILTER (WHERE source = 'metric') AS mf, count(*) FILTER (WHERE source = 'churn') AS cf
  FROM fs LEFT JOIN fl ON fl.part = fs.part AND fl.entry = fs.entry AND fl.step = fs.step GROUP BY ALL)"""


@query("flow_steps", f"{_WALKS} SELECT * FROM fs")
def _(m):
    return _flows(m)[1]


@query("flow_branch_groups", f"{_WALKS} SELECT part, entry, caller, branch, count(*) AS steps, min(step) AS first_step FROM fs WHERE branch IS NOT NULL GROUP BY ALL")
def _(m):
    from archlake.operators.flows import branch_groups

    return branch_groups(_flows(m)[1])


@query("flow_tree_edges", f"{_WALKS} SELECT part, entry, parent AS from_step, step AS to_step FROM fs WHERE parent IS NOT NULL AND NOT recursion")
def _(m):
    from archlake.operators.flows import tree_edges

    return tree_edges(_flows(m)[1])


@query("fragility_flags", f"{_WALKS}, {_FLAGS} SELECT * FROM fl")
def _(m):
    return _flagged(m)[1].select("part", "entry", "step", F.explode("flags").alias("f")).select("part", "entry", "step", "f.*")


@query("fragility_summary", rf"""{_WALKS}, {_FLAGS},
sm AS (SELECT part, entry, count(*) AS steps, count(*) FILTER (WHERE errors + warnings > 0) AS fragile_steps, sum(mf)::BIGINT AS metric_flags, sum(cf)::BIGINT AS churn_flags, max(errors) AS e, max(warnings) AS w FROM ss GROUP BY ALL)
SELECT en.part, en.node, en.name, en.path, en.kind, false AS declared, en.rank, upper(substr(x, 1, 1)) || substr(x, 2) AS flow_name, coalesce(steps, 0) AS steps, coalesce(fragile_steps, 0) AS fragile_steps,
  coalesce(metric_flags, 0) AS metric_flags, 0 AS type_flags, coalesce(churn_flags, 0) AS churn_flags, CASE WHEN e > 0 THEN 'Error' WHEN w > 0 THEN 'Warning' END AS max_severity,
  CASE WHEN steps > 0 THEN round(fragile_steps * 100 / steps)::INT ELSE 0 END AS fragile_percent
FROM (SELECT *, lower(regexp_replace(translate(name, '_-', '  '), '([^A-Z])([A-Z])', '\1 \2', 'g')) AS x FROM en WHERE rank <= 30) en LEFT JOIN sm ON sm.part = en.part AND sm.entry = en.node""")
def _(m):
    from archlake.operators.flows import flow_summaries, fragility_summary

    entries, flagged = _flagged(m)  # ids of flows are hashes that SQL can't tell; features are declared for functions only
    return flow_summaries(entries, fragility_summary(flagged)).drop("flow_id", "feature_name")


@query("flow_step_severities", f"{_WALKS}, {_FLAGS} SELECT part, entry, step, errors, warnings FROM ss")
def _(m):
    from archlake.operators.flows import step_severities

    return step_severities(_flagged(m)[1])


def _files(m):
    from archlake.functions.paths import canonical_path

    return m.t("source_files").where("report_id is not null and file_id is not null").select(
        F.col("file_id").alias("id"), F.col("report_id").alias("part"), canonical_path("path").alias("path"), "content"
    )


def _call_graph(m):
    from archlake.operators.calls import CallGraph

    reports = m.t("dupe_reports").select("report_id", "snapshot_id")
    modules = m.modules.join(reports, "snapshot_id").select(F.col("report_id").alias("part"), "path")
    return CallGraph(_files(m).dropDuplicates(["part", "path"]), modules)


# texts without other forms of imports: named imports at the start of a line
_FROM = "CASE WHEN specifier LIKE '/%' THEN specifier ELSE regexp_replace(path, '[^/]*$', '') || '/' || specifier END"
_IMPORTS = rf"""fi AS (SELECT report_id AS part, {CANON.format('path')} AS path, content FROM source_files WHERE report_id IS NOT NULL AND file_id IS NOT NULL),
im AS (SELECT part, path, unnest(s) AS specifier, generate_subscripts(s, 1) - 1 AS pos FROM (
  SELECT part, path, regexp_extract_all(content, '(?:^|\n)\s*import \{{[^}}]*\}} from [''"]([^''"]+)[''"]', 1) AS s FROM fi WHERE regexp_matches(path, '\.(ts|tsx|js|jsx|mjs|cjs)$'))),
md AS (SELECT r.report_id AS part, m.path FROM mods m JOIN dupe_reports r ON r.snapshot_id = m.snapshot_id),
ct AS (SELECT part, path, specifier, unnest(c) AS c, generate_subscripts(c, 1) AS r FROM (SELECT DISTINCT part, path, specifier, {candidates('target', True)} AS c FROM (
  SELECT *, {folded(_FROM)} AS target FROM im WHERE specifier LIKE '.%' OR specifier LIKE '/%'))),
ib AS (SELECT ct.part, ct.path, specifier, arg_min(c, r) AS target FROM ct JOIN md ON md.part = ct.part AND md.path = c GROUP BY ALL)"""


@query("import_targets", f"""WITH {MODULES}, {_IMPORTS}
SELECT im.part, im.path, im.pos, im.specifier, false AS is_reexport, target FROM im LEFT JOIN ib ON ib.part = im.part AND ib.path = im.path AND ib.specifier = im.specifier""")
def _(m):
    return _call_graph(m).imports


@query("extracted_functions")
def _(m):
    f = _call_graph(m).functions
    return f.select("part", "path", "order", "name", "start", "end", "exported", "is_default", "is_method", "class_name", F.size("params").alias("params"), "return_type")


@query("call_resolutions")
def _(m):
    c = _call_graph(m).calls
    return c.select("part", "path", "order", "call_order", "callee_text", "branchy", "branch_id", "resolution", "target_module", "target_order", F.size("arg_texts").alias("args"))


@query("call_graph_edges")
def _(m):
    return _call_graph(m).edges()


@query("call_graph_degrees")
def _(m):
    return _call_graph(m).degrees()


@query("call_graph_report")
def _(m):
    return _call_graph(m).report()


def _features(functions):
    """Declared features of the queries: of every report the first function by path and name, as path#function."""
    first = functions.where("name not like '%#%'").groupBy("part").agg(F.min(F.struct("path", "name")).alias("f"))
    return first.select("part", F.lit(0).alias("place"), F.concat(F.lit("feature of "), F.col("f.path")).alias("feature_name"), F.concat("f.path", F.lit("#"), F.col("f.name")).alias("entry"), F.lit("public_api").alias("given_kind"))


@query("parameter_arguments")
def _(m):
    from archlake.operators.shapes import paired_arguments

    g = _call_graph(m)
    return paired_arguments(g.calls, g.functions)


def _function_flows(m):
    """Walks over the functions of the texts and their resolved calls, flagged with type contracts; ``part`` is the report."""
    from archlake.operators.flows import declared_entries, entry_points, flow_steps, step_flags
    from archlake.operators.shapes import contracts
    from archlake.session import Scratch

    g, scratch = _call_graph(m), Scratch(m.spark, "function-flows")
    keys = ["part", "path", "order"]
    node = lambda path="path", order="order": F.xxhash64("part", path, order)
    resolved = scratch.write(g.calls.where("resolution = 'resolved'").select(
        "part", node().alias("caller"), node("target_module", "target_order").alias("callee"), "call_order", F.col("branch_id").cast("int").alias("branch")
    ), "calls")
    out = resolved.groupBy("part", F.col("caller").alias("node")).agg(F.count(F.lit(1)).alias("out_calls"))
    functions = g.functions.select(*keys, node().alias("node"), "name", "exported").join(out, ["part", "node"], "left").fillna(0, ["out_calls"])
    functions = scratch.write(functions.withColumn("module", F.col("path")), "functions")
    # every report declares its first function as a feature
    declared = declared_entries(_features(functions), functions)
    entries = scratch.write(entry_points(functions, declared), "entries")
    steps = scratch.write(flow_steps(entries, resolved), "steps")
    reports = m.t("dupe_reports").select("report_id", "snapshot_id").distinct()
    of = lambda t: t.join(reports, "snapshot_id").withColumnRenamed("report_id", "part")
    metrics = of(m.metrics().join(m.components(), ["snapshot_id", "id"])).select("part", "path", "scc_id", "scc_size", "instability")
    nodes = functions.select("part", "path", "node").join(metrics, ["part", "path"], "left")
    types = contracts(g.facts, g.bindings).select("part", node().alias("node"), "slot", "name", "untyped", "missing")
    return entries, steps, step_flags(steps, nodes, of(m.violations()).select("part", "from_path", "to_path"), of(m.changed()).select("part", "path").distinct(), types)


@query("function_entry_points")
def _(m):
    return _function_flows(m)[0].drop("node")


@query("function_flow_steps")
def _(m):
    return _function_flows(m)[1]


@query("function_fragility_flags")
def _(m):
    return _function_flows(m)[2].select("part", "entry", "step", F.explode("flags").alias("f")).select("part", "entry", "step", "f.*")


@query("function_fragility_summary")
def _(m):
    from archlake.operators.flows import flow_summaries, fragility_summary

    entries, _, flagged = _function_flows(m)
    return flow_summaries(entries, fragility_summary(flagged))


@query("function_step_severities")
def _(m):
    from archlake.operators.flows import step_severities

    return step_severities(_function_flows(m)[2])


@query("type_contracts")
def _(m):
    from archlake.operators.shapes import contracts

    g = _call_graph(m)
    return contracts(g.facts, g.bindings).withColumn("shape", F.to_json("shape"))


@query("resolved_specifiers", f"""WITH {_BASE},
sp AS (SELECT ce.snapshot_id AS part, f.path AS path, t.path AS to_path, ce.specifier, {folded("regexp_replace(f.path, '[^/]*$', '') || '/' || ce.specifier")} AS target
  FROM ce JOIN mods f ON f.snapshot_id = ce.snapshot_id AND f.id = ce.from_id JOIN mods t ON t.snapshot_id = ce.snapshot_id AND t.id = ce.to_id WHERE ce.specifier LIKE '.%'),
cd AS (SELECT part, path, specifier, unnest(c) AS c, generate_subscripts(c, 1) AS r FROM (SELECT DISTINCT part, path, specifier, {candidates('target', False)} AS c FROM sp)),
bs AS (SELECT cd.part, cd.path, specifier, arg_min(c, r) AS found FROM cd JOIN mods m ON m.snapshot_id = cd.part AND m.path = c GROUP BY ALL)
SELECT sp.part, count(*) AS relative, count(found) AS resolved, count(*) FILTER (WHERE found = to_path) AS as_recorded
FROM sp LEFT JOIN bs ON bs.part = sp.part AND bs.path = sp.path AND bs.specifier = sp.specifier GROUP BY 1""")
def _(m):
    """Relative specifiers of recorded edges: how many lead to a module, and to the recorded one."""
    from archlake.operators.resolve import resolve_imports

    e = rules.with_paths(m.edges, m.modules).where("specifier like '.%'")
    i = resolve_imports(e.select(F.col("snapshot_id").alias("part"), F.col("from_path").alias("path"), "specifier", "to_path"), m.modules.select(F.col("snapshot_id").alias("part"), "path"), strict=False)
    return i.groupBy("part").agg(F.count(F.lit(1)).alias("relative"), F.count("target").alias("resolved"), F.count_if(F.col("target") == F.col("to_path")).alias("as_recorded"))


def _similar(m):
    from archlake.operators.dupes import SimilarFiles

    return SimilarFiles(_files(m))


@query("source_dupe_pairs", f"WITH {CLASSES} SELECT * FROM cp")
def _(m):
    return _similar(m).pairs


@query("source_dupe_members", f"WITH {CLASSES} SELECT * FROM cm")
def _(m):
    return _similar(m).members


@query("source_dupe_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT *, row_number() OVER (PARTITION BY part ORDER BY files DESC, similarity DESC, cluster) AS place FROM cl")
def _(m):
    from archlake.operators.dupes import cluster_order

    return cluster_order(_similar(m).clusters())


_RECORDED = f"""lk AS (SELECT report_id, pa, pb, max(similarity) AS similarity FROM (
    SELECT p.report_id, least({CANON.format('file_a')}, {CANON.format('file_b')}) AS pa, greatest({CANON.format('file_a')}, {CANON.format('file_b')}) AS pb, p.similarity
    FROM dupe_pairs p JOIN dupe_reports r ON r.report_id = p.report_id WHERE file_a IS NOT NULL AND file_b IS NOT NULL AND p.similarity >= coalesce(r.threshold, 0.60::FLOAT))
  WHERE pa <> pb GROUP BY ALL),
sy AS (SELECT report_id, pa AS x, pb AS y FROM lk UNION SELECT report_id, pb, pa FROM lk),
rc(report_id, x, y) AS (SELECT report_id, x, x FROM sy UNION SELECT r.report_id, r.x, s.y FROM rc r JOIN sy s ON s.report_id = r.report_id AND s.x = r.y),
gr AS (SELECT report_id, x AS path, min(y) AS cluster FROM rc GROUP BY ALL),
cl AS (SELECT g.report_id AS part, g.cluster, count(DISTINCT g.path) AS files, round(avg(l.similarity::DOUBLE), 2) AS similarity
  FROM gr g LEFT JOIN lk l ON l.report_id = g.report_id AND l.pa = g.path GROUP BY ALL)"""


def _recorded_clusters(m):
    """Clusters of the recorded pairs; a cluster is named by its smallest path."""
    from archlake.functions.paths import canonical_path
    from archlake.operators.graph import connected_components

    r = m.t("dupe_reports").select("report_id", F.coalesce("threshold", F.lit(0.6).cast("float")).alias("t"))
    p = m.t("dupe_pairs").where("file_a is not null and file_b is not null").join(r, "report_id").where("similarity >= t and not isnan(similarity)")
    a, b = canonical_path("file_a"), canonical_path("file_b")
    links = p.select(F.col("report_id").alias("part"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "similarity").where("a <> b").groupBy("part", "a", "b").agg(F.max("similarity").alias("similarity"))
    member = connected_components(links)
    sizes = member.groupBy("part", F.col("component").alias("cluster")).agg(F.count(F.lit(1)).alias("files"))
    mean = links.join(member.withColumnRenamed("node", "a"), ["part", "a"]).groupBy("part", F.col("component").alias("cluster")).agg(F.round(F.avg(F.col("similarity").cast("double")), 2).alias("similarity"))
    return sizes.join(mean, ["part", "cluster"])


@query("dupe_clusters", f"WITH RECURSIVE {_RECORDED} SELECT * FROM cl")
def _(m):
    return _recorded_clusters(m)


@query("dupe_report", f"""WITH RECURSIVE {_RECORDED}
SELECT r.report_id, r.files_analyzed, count(cl.cluster) AS clusters, coalesce(sum(cl.files), 0)::BIGINT AS files_in_clusters,
  count(*) FILTER (WHERE cl.similarity * 100 >= 85) AS high, count(*) FILTER (WHERE cl.similarity * 100 >= 70 AND cl.similarity * 100 < 85) AS medium
FROM dupe_reports r LEFT JOIN cl ON cl.part = r.report_id GROUP BY ALL""")
def _(m):
    level = signals.similarity_severity(F.col("similarity") * 100)
    c = _recorded_clusters(m).groupBy(F.col("part").alias("report_id")).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("files").alias("files_in_clusters"), F.count_if(level == "high").alias("high"), F.count_if(level == "medium").alias("medium")
    )
    return m.t("dupe_reports").select("report_id", "files_analyzed").join(c, "report_id", "left").fillna(0, ["clusters", "files_in_clusters", "high", "medium"])


@query("edge_rates", "SELECT date_trunc('day', scanned_at) AS window_start, lower(trim(kind)) AS kind, count(*) AS edges FROM edges WHERE scanned_at IS NOT NULL GROUP BY ALL")
def _(m):
    from archlake.streaming.trends_stream import edge_rates

    return edge_rates(m.t("edges")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
