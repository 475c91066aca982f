"""Shared SQL fragments of the DuckDB oracles."""

# DuckDB view text of canonical paths and current modules, used as CTEs
CANON = r"regexp_replace(regexp_replace(replace({0}, '\', '/'), '/+', '/', 'g'), '^\./', '')"

MODULES = f"""mods AS (
  SELECT snapshot_id, id, path, sha, exports FROM (
    SELECT snapshot_id, id, {CANON.format('path')} AS path, lower(content_sha) AS sha,
           list_sort(list_distinct(coalesce(exports, []))) AS exports,
           row_number() OVER (PARTITION BY snapshot_id, {CANON.format('path')} ORDER BY scanned_at DESC NULLS LAST, id DESC) AS rn
    FROM modules WHERE snapshot_id IS NOT NULL AND path IS NOT NULL AND id IS NOT NULL) WHERE rn = 1)"""

STEPS = """heads AS (
  SELECT snapshot_id, min(rtrim(repo_root, '/')) AS repo, min(saved_at) AS saved_at FROM snapshots
  WHERE snapshot_id IS NOT NULL GROUP BY snapshot_id),
steps AS (
  SELECT snapshot_id, repo, row_number() OVER w AS step, lag(snapshot_id) OVER w AS previous_id FROM heads
  WINDOW w AS (PARTITION BY repo ORDER BY saved_at NULLS FIRST, snapshot_id))"""
