"""Queries of the training-data operators and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archlake.llm import components, encoding, generated, leakage, mixing
from archlake.llm.neardup import NearDuplicates
from archlake.plans.sql import CANON
from archlake.plans.text_sql import SHINGLES
from archlake.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.file_groups(table(spark, sf_dir, "dupe_reports"), table(spark, sf_dir, "dupe_pairs"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.group_report(table(spark, sf_dir, "dupe_reports"), table(spark, sf_dir, "dupe_pairs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "dupe_reports"), table(spark, sf_dir, "source_files")).expanded()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.not_hand_written(table(spark, sf_dir, "source_files")).select("file_id")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.not_hand_written(table(spark, sf_dir, "source_files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).unreachable()


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).copies()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares()


def p7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).targets_met()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found,
    "p5_found": p5_found, "p5_reasons": p5_reasons,
    "p6_found": p6_found, "p6_items": p6_items,
    "p7_found": p7_found, "p7_copies": p7_copies, "p7_shares": p7_shares, "p7_targets": p7_targets,
    "p8_found": p8_found, "p8_restored": p8_restored,
}

_LINKS = f"""links AS (
  SELECT report_id, pa, pb, max(similarity) AS similarity FROM (
    SELECT p.report_id, least({CANON.format('file_a')}, {CANON.format('file_b')}) AS pa,
           greatest({CANON.format('file_a')}, {CANON.format('file_b')}) AS pb, p.similarity
    FROM dupe_pairs p JOIN dupe_reports r ON r.report_id = p.report_id
    WHERE file_a IS NOT NULL AND file_b IS NOT NULL AND p.similarity IS NOT NULL
      AND p.similarity >= coalesce(r.threshold, CAST(0.60 AS FLOAT)))
  WHERE pa <> pb GROUP BY ALL),
sym AS (SELECT report_id, pa AS x, pb AS y FROM links UNION SELECT report_id, pb, pa FROM links),
reach(report_id, x, y) AS (
  SELECT report_id, x, x FROM sym UNION
  SELECT r.report_id, r.x, s.y FROM reach r JOIN sym s ON s.report_id = r.report_id AND s.x = r.y),
groups AS (SELECT report_id, x AS path, min(y) AS group_path FROM reach GROUP BY ALL)"""

_WINDOWS = r"""
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ip AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
dp AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
hits AS (SELECT DISTINCT doc_id, item_id FROM dp JOIN ip USING (p))"""

ORACLES = {
    "p6_found": f"WITH {_WINDOWS} SELECT doc_id, item_id FROM hits",
    "p6_items": f"""WITH {_WINDOWS}
SELECT e.item_id, e.suite, count(h.doc_id) AS documents FROM eval_items e LEFT JOIN hits h ON h.item_id = e.item_id GROUP BY ALL""",
    # any tokenizer gives the same rows, so characters stand for tokens here
    "p7_found": """
WITH d AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS n FROM documents GROUP BY 1),
m AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(d.n, 0) AS n
      FROM mix_targets t LEFT JOIN d ON d.source = lower(trim(t.source)))
SELECT source FROM m WHERE max_repeats * n < target_share * (SELECT sum(n) FROM m)""",
    "p2_found": f"""WITH {SHINGLES},
t AS (SELECT report_id, least(greatest(coalesce(threshold, 0.60::FLOAT), 0.1::FLOAT), 1.0::FLOAT) AS t FROM dupe_reports)
SELECT a AS file_id_a, b AS file_id_b FROM js JOIN t ON t.report_id = js.report_id WHERE similarity >= t""",
    "p7_targets": """
WITH d AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS n FROM documents GROUP BY 1),
m AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(d.n, 0) AS n
      FROM mix_targets t LEFT JOIN d ON d.source = lower(trim(t.source))),
r AS (SELECT source, target_share, max_repeats * n >= target_share * (SELECT sum(n) FROM m) AS reachable FROM m)
SELECT source, target_share, reachable, reachable AS met FROM r""",
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT report_id, path, group_path FROM groups",
    "p1_groups": f"""WITH RECURSIVE {_LINKS}
SELECT g.report_id, g.group_path, count(DISTINCT g.path) AS files,
       round(sum(l.similarity::DOUBLE) / count(l.similarity), 2) AS similarity
FROM groups g LEFT JOIN links l ON l.report_id = g.report_id AND l.pa = g.path GROUP BY ALL""",
}
