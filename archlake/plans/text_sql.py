"""SQL of the text operators' oracles: tokens, shingles, classes of equal sets, and the folding of relative specifiers."""

from __future__ import annotations

_TOKEN = (
    r"[\p{L}_$]+|//[^\n]*|/\*(?s:.*?)\*/"
    r'|"(?:\\(?s:.)|[^"\\])*"?'
    r"|''(?:\\(?s:.)|[^''\\])*''?"
    r"|`(?:\\(?s:.)|[^`\\])*`?"
    r"|[0-9][0-9A-Za-z._]*|\S"
)

#: sh: report_id, file_id, s (four tokens), one row per distinct run; sz: its number; js: similarity of all pairs that share one.
#: Texts without regular-expression literals and divisions are read as the library reads them.
SHINGLES = f"""tk AS (SELECT report_id, file_id, list_transform(list_filter(regexp_extract_all(content, '{_TOKEN}'), lambda x: NOT starts_with(x, '//') AND NOT (starts_with(x, '/*') AND len(x) > 1)),
    lambda x: CASE WHEN x[1] IN ('"', '''', '`') THEN 'STR' WHEN x[1] BETWEEN '0' AND '9' THEN 'NUM' ELSE lower(x) END) AS w
  FROM source_files WHERE file_id IS NOT NULL AND report_id IS NOT NULL AND content IS NOT NULL),
sh AS (SELECT DISTINCT report_id, file_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS s FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM tk WHERE len(w) >= 4)),
sz AS (SELECT report_id, file_id, count(*) AS n FROM sh GROUP BY ALL),
js AS (SELECT p.report_id, a, b, i::FLOAT / (x.n + y.n - i)::FLOAT AS similarity FROM (
    SELECT a.report_id, a.file_id AS a, b.file_id AS b, count(*) AS i FROM sh a JOIN sh b ON b.report_id = a.report_id AND b.s = a.s AND a.file_id < b.file_id GROUP BY ALL) p
  JOIN sz x ON x.report_id = p.report_id AND x.file_id = a JOIN sz y ON y.report_id = p.report_id AND y.file_id = b)"""

#: cm: part, rep, id; cp: part, a, b, similarity between classes at the default threshold
CLASSES = f"""{SHINGLES},
hs AS (SELECT report_id, file_id, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM sh GROUP BY ALL),
cm AS (SELECT report_id AS part, min(file_id) OVER (PARTITION BY report_id, h) AS rep, file_id AS id FROM hs),
cp AS (SELECT report_id AS part, a, b, similarity FROM js WHERE similarity >= 0.60::FLOAT AND a IN (SELECT rep FROM cm) AND b IN (SELECT rep FROM cm))"""

CLUSTERS = f"""{CLASSES},
pr AS (SELECT report_id AS part, a, b, similarity FROM js WHERE similarity >= 0.60::FLOAT),
sy AS (SELECT part, a AS x, b AS y FROM pr UNION SELECT part, b, a FROM pr),
rc(part, x, y) AS (SELECT part, x, x FROM sy UNION SELECT r.part, r.x, s.y FROM rc r JOIN sy s ON s.part = r.part AND s.x = r.y),
gr AS (SELECT part, x AS id, min(y) AS cluster FROM rc GROUP BY ALL),
cl AS (SELECT g.part, g.cluster, count(DISTINCT g.id) AS files, round(sum(p.similarity::DOUBLE) / count(p.similarity), 2) AS similarity
  FROM gr g LEFT JOIN pr p ON p.part = g.part AND p.a = g.id GROUP BY ALL)"""

EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def folded(path: str) -> str:
    """``.`` and ``..`` of a path folded away; ``..`` above the root is dropped."""
    out = f"regexp_replace({path} || '/', '/+', '/', 'g')"
    for _ in range(3):
        out = rf"regexp_replace({out}, '(^|/)\./', '\1', 'g')"
    for _ in range(8):
        out = rf"regexp_replace({out}, '(^|/)[^/]+/\.\./', '\1')"
    return rf"rtrim(ltrim(regexp_replace({out}, '^(\.\./)+', ''), '/'), '/')"


def candidates(target: str, strict: bool) -> str:
    """List of the paths a specifier can lead to, best first."""
    stem = rf"regexp_replace({target}, '([^/])\.[^./]*$', '\1')"
    paths = [target, *[f"{stem} || '.{x}'" for x in EXTENSIONS]]
    if not strict:
        paths += [f"{target} || '.{x}'" for x in EXTENSIONS]
    return "[" + ", ".join([*paths, *[f"{target} || '/index.{x}'" for x in EXTENSIONS]]) + "]"
