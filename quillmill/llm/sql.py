"""DuckDB SQL that the queries must equal, where SQL can express their results."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM items)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, s, n, item_id FROM starts JOIN windows USING (n, k)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN ids i ON d.doc_id = i.doc_id
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (("assign", _ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, b AS start, b + length(m[i]) AS stop FROM (
      SELECT *, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b FROM (
        SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS g
          FROM documents WHERE regexp_matches(text, '{pattern}')))) WHERE length(g[i]) >= {least}"""


SECRETS = f"""
WITH found AS ({" UNION ALL ".join(_spans(i, *k) for i, k in enumerate(_KINDS))}),
listed AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in _KINDS)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS l FROM found GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in _KINDS)}, sha256(coalesce(l, '')) AS base_sha256, coalesce(l, '') AS spans
FROM documents d LEFT JOIN listed s ON d.doc_id = s.doc_id
"""

GROUPS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least l ON w.doc_id = l.doc_id
"""
