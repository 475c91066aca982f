"""Queries of the general training-data problems (3 and 4) and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archlake.operators.balanced import fan_in_mismatches
from archlake.operators.snapshot_delta import history_delta
from archlake.plans.sql import MODULES, STEPS
from archlake.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_delta(*(table(spark, sf_dir, t) for t in ("snapshots", "modules", "edges")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fan_in_mismatches(*(table(spark, sf_dir, t) for t in ("modules", "edges", "module_metrics")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p4_found": p4_found}

ORACLES = {
    "p3_found": f"""
WITH {MODULES}, {STEPS},
pairs AS (SELECT snapshot_id, previous_id FROM steps WHERE previous_id IS NOT NULL),
newm AS (SELECT p.snapshot_id, m.path, m.sha, m.exports FROM pairs p JOIN mods m ON m.snapshot_id = p.snapshot_id),
oldm AS (SELECT p.snapshot_id, m.path, m.sha, m.exports FROM pairs p JOIN mods m ON m.snapshot_id = p.previous_id),
dm AS (
  SELECT coalesce(n.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(n.path, o.path) AS path,
         CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
              WHEN coalesce(o.sha <> n.sha, false) OR o.exports <> n.exports THEN 'changed' END AS delta
  FROM newm n FULL JOIN oldm o ON n.snapshot_id = o.snapshot_id AND n.path = o.path),
e AS (
  SELECT DISTINCT e.snapshot_id, f.path AS path, t.path AS to_path FROM edges e
  JOIN mods f ON f.snapshot_id = e.snapshot_id AND f.id = e.from_id
  JOIN mods t ON t.snapshot_id = e.snapshot_id AND t.id = e.to_id),
newe AS (SELECT p.snapshot_id, e.path, e.to_path FROM pairs p JOIN e ON e.snapshot_id = p.snapshot_id),
olde AS (SELECT p.snapshot_id, e.path, e.to_path FROM pairs p JOIN e ON e.snapshot_id = p.previous_id),
de AS (
  SELECT coalesce(n.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(n.path, o.path) AS path,
         coalesce(n.to_path, o.to_path) AS to_path,
         CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' END AS delta
  FROM newe n FULL JOIN olde o ON n.snapshot_id = o.snapshot_id AND n.path = o.path AND n.to_path = o.to_path)
SELECT snapshot_id, 'module' AS entity, path, '' AS to_path, delta FROM dm WHERE delta IS NOT NULL
UNION ALL
SELECT snapshot_id, 'edge', path, to_path, delta FROM de WHERE delta IS NOT NULL""",
    "p4_found": f"""
WITH {MODULES},
c AS (
  SELECT e.snapshot_id, e.to_id AS id, count(DISTINCT (e.from_id, lower(trim(e.kind)))) AS n FROM edges e
  JOIN mods m ON m.snapshot_id = e.snapshot_id AND m.id = e.from_id GROUP BY ALL)
SELECT DISTINCT mm.snapshot_id, mm.id FROM module_metrics mm
LEFT JOIN c ON c.snapshot_id = mm.snapshot_id AND c.id = mm.id
WHERE mm.fan_in IS NOT NULL AND mm.snapshot_id IS NOT NULL AND mm.id IS NOT NULL AND mm.fan_in <> coalesce(c.n, 0)""",
}
