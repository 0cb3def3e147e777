"""The truncation query in SQL whose regexes have no lookaround, so breaks are marked in three steps.

States the rules of truncation.py's docstring over rows, one per token, in place of arrays and hashes.
"""

from __future__ import annotations


def build(closed: int = 40, expected: float = 4.0, share: float = 0.1, seen: int = 5) -> str:
    """WITH clauses that end in `cut` (id, reason)."""
    opened = " OR ".join(f"length(replace(bare, '{a}', '')) < length(replace(bare, '{b}', ''))" for a, b in ("{}", "()", "[]"))
    quoted = r'''"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|`[^`]*`|//[^\n]*|#[^\n]*'''
    mark = r"(?i)(?:\x{FFFD}|…\s*[(\[](?:truncated|cut off|continued)[)\]])$"

    def judged(n: str, e: str) -> str:
        return f"WHEN ({n} - 1) * rate >= {expected} THEN {e} - 1 <= {share} * rate * ({n} - 1) WHEN {e} > 1 AND {n} * {share} * rate < {e} - 1 THEN false"

    return rf"""
WITH tx AS (SELECT DISTINCT id, text, coalesce(entry_type, '') AS kind, category FROM entries WHERE id IS NOT NULL AND length(trim(text)) > 0),
ds AS (SELECT row_number() OVER () AS doc, kind, text FROM (SELECT DISTINCT kind, text FROM tx)),
ow AS (SELECT DISTINCT id, doc, kind, category, length(text) AS n_chars FROM tx JOIN ds USING (kind, text)),
tu AS (SELECT doc, kind, CASE WHEN kind = 'code' THEN [t] ELSE string_split(regexp_replace(t, '\n+((?:User|Assistant): )', chr(1) || '\1', 'g'), chr(1)) END AS turns FROM (SELECT doc, kind, translate(text, '¶↵', '  ') AS t FROM ds)),
sg AS (SELECT doc, kind, len(turns) AS n_turns, unnest(turns) AS raw, generate_subscripts(turns, 1) AS turn FROM tu),
rw AS (SELECT doc, kind, turn = n_turns AS last_turn, regexp_replace(raw, '\s+$', '') AS raw, regexp_replace(raw, '(?i)(?:\s|\x{{FFFD}}|…\s*[(\[](?:truncated|cut off|continued)[)\]])+$', '') AS cut FROM sg),
fl AS (SELECT *, regexp_matches(raw, '{mark}') AS marked, CASE WHEN kind = 'code' THEN regexp_replace(cut, '{quoted}', '', 'g') ELSE '' END AS bare FROM rw),
se AS (SELECT row_number() OVER () AS seg, doc, kind, last_turn, marked, NOT marked AND regexp_matches(cut, '[.!?]$') AND NOT regexp_matches(cut, '[.][.]+$') AS stopped,
  kind = 'code' AND ({opened} OR len(string_split(cut, repeat(chr(34), 3))) % 2 = 0) AS open, regexp_matches(cut, CASE WHEN kind = 'code' THEN '[}}]$' ELSE '[.!?…]$' END) AS ended,
  regexp_extract_all(lower(CASE WHEN kind = 'code' THEN replace(cut, chr(10), ' ↵ ') ELSE regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(cut, '[.!?…]+(\s|$)', ' ¶ \1', 'g'), '\n(\s*(?:[-*•]|\p{{N}}+[.)])\s)', ' ¶ \1', 'g'), '\n\s*\n', ' ¶ ', 'g'), '(?:¶\s*)+$|^\s*(?:User|Assistant):', ' ', 'g') END), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]') AS w FROM fl),
po AS (SELECT seg, kind, unnest(list_concat(['¶'], w)) AS t, generate_subscripts(list_concat(['¶'], w), 1) AS i FROM se WHERE len(w) > 0),
nx AS (SELECT *, coalesce(lead(t) OVER s, '¶') = '¶' AS ends, lead(t) OVER s IS NULL AS final FROM po WINDOW s AS (PARTITION BY seg ORDER BY i)),
wd AS (SELECT kind, t AS word, count(*) AS n, count(*) FILTER (ends) AS ends FROM nx WHERE t <> '¶' GROUP BY 1, 2),
ra AS (SELECT kind, sum(ends) / sum(n) AS rate FROM wd GROUP BY kind),
cl AS (SELECT kind = 'code' AS code, word FROM (SELECT kind = 'code' AS code, kind, word, row_number() OVER (PARTITION BY kind = 'code' ORDER BY sum(n) DESC, word) AS r FROM wd WHERE regexp_matches(word, '^\p{{L}}+$') GROUP BY kind, word) WHERE r <= {closed}),
ct AS (SELECT nx.*, CASE WHEN NOT regexp_matches(t, '^[\p{{L}}\p{{N}}]') OR cl.word IS NOT NULL THEN t WHEN regexp_matches(t, '^\p{{L}}+$') THEN 'w' WHEN regexp_matches(t, '^\p{{N}}+$') THEN '0' ELSE 'x' END AS f,
  CASE WHEN NOT regexp_matches(t, '^[\p{{L}}\p{{N}}]') OR regexp_matches(t, '^\p{{L}}+$') THEN t WHEN regexp_matches(t, '^\p{{N}}+$') THEN '0' ELSE 'x' || length(t) END AS g FROM nx LEFT JOIN cl ON cl.word = t AND cl.code = (kind = 'code')),
tr AS (SELECT *, lag(t, 2) OVER s AS t2, lag(t) OVER s AS t1, lag(f, 4) OVER s AS f4, lag(f, 3) OVER s AS f3, lag(f, 2) OVER s AS f2, lag(f) OVER s AS f1 FROM ct WINDOW s AS (PARTITION BY seg ORDER BY i)),
p AS (SELECT * FROM tr WHERE t <> '¶'),
g1 AS (SELECT kind, t2, t1, t, count(*) AS n, count(*) FILTER (ends) AS e FROM p WHERE t2 IS NOT NULL GROUP BY ALL),
g2 AS (SELECT kind, f2, f1, f, g, count(*) AS n, count(*) FILTER (ends) AS e FROM p WHERE f2 IS NOT NULL GROUP BY ALL),
g3 AS (SELECT kind, f2, f1, f, sum(n) AS n, sum(e) AS e FROM g2 GROUP BY ALL),
g5 AS (SELECT kind, f4, f3, f2, f1, f, count(*) AS n, count(*) FILTER (ends) AS e FROM p WHERE f4 IS NOT NULL GROUP BY ALL),
be AS (SELECT kind, f2, f1, prefix, sum(m) AS n FROM (SELECT kind, f2, f1, n - e AS m, unnest(list_transform(range(1, length(g)), lambda j: substr(g, 1, j))) AS prefix FROM g2 WHERE n > e AND length(g) > 1 AND regexp_matches(g, '^\p{{L}}+$')) GROUP BY ALL),
pt AS (SELECT kind, prefix, max(m) AS n FROM (SELECT kind, n - ends AS m, unnest(list_transform(range(1, length(word)), lambda j: substr(word, 1, j))) AS prefix FROM wd WHERE n - ends >= {seen} AND length(word) > 1 AND regexp_matches(word, '^\p{{L}}+$')) GROUP BY ALL),
fi AS (SELECT * FROM tr WHERE final),
fa AS (SELECT fi.seg, rate, coalesce(g1.n, 0) AS n1, coalesce(g1.e, 0) AS e1, coalesce(g2.n, 0) AS n2, coalesce(g2.e, 0) AS e2, coalesce(g3.n, 0) AS n3, coalesce(g3.e, 0) AS e3, coalesce(g5.n, 0) AS n5, coalesce(g5.e, 0) AS e5,
  coalesce(wd.n - 1, 0) AS nw, coalesce(wd.ends - 1, 0) AS ew, coalesce(be.n, 0) AS nb, coalesce(pt.n, 0) AS np, fi.f = 'x' AND (coalesce(g3.n, 0) - 1) * rate >= {expected} AND coalesce(g2.n, 0) - 1 <= 0.01 * g3.n AS odd
  FROM fi JOIN ra USING (kind) LEFT JOIN g1 ON g1.kind = fi.kind AND g1.t2 = fi.t2 AND g1.t1 = fi.t1 AND g1.t = fi.t LEFT JOIN g2 ON g2.kind = fi.kind AND g2.f2 = fi.f2 AND g2.f1 = fi.f1 AND g2.f = fi.f AND g2.g = fi.g
  LEFT JOIN g3 ON g3.kind = fi.kind AND g3.f2 = fi.f2 AND g3.f1 = fi.f1 AND g3.f = fi.f LEFT JOIN g5 ON g5.kind = fi.kind AND g5.f4 = fi.f4 AND g5.f3 = fi.f3 AND g5.f2 = fi.f2 AND g5.f1 = fi.f1 AND g5.f = fi.f
  LEFT JOIN wd ON wd.kind = fi.kind AND wd.word = fi.t LEFT JOIN be ON be.kind = fi.kind AND be.f2 = fi.f2 AND be.f1 = fi.f1 AND be.prefix = fi.g LEFT JOIN pt ON pt.kind = fi.kind AND pt.prefix = fi.t),
ve AS (SELECT seg, CASE WHEN nb >= {seen} AND (nw - ew) * 100 <= greatest(np, nb) OR odd THEN 'trigram within a word' WHEN nw >= 5 AND ew >= 0.5 * nw THEN NULL
  WHEN CASE {judged("n1", "e1")} {judged("n2", "e2")} {judged("n3", "e3")} ELSE false END THEN 'trigram'
  WHEN np > 0 AND (nw - ew) * 100 <= np THEN 'part of a word' WHEN CASE {judged("n5", "e5")} ELSE false END THEN 'longer n-gram' END AS said FROM fa),
le AS (SELECT kind = 'code' AS code, category, n_chars, count(*) AS n FROM (SELECT DISTINCT doc, kind, category, n_chars FROM ow) GROUP BY 1, 2, 3),
li AS (SELECT a.code, a.category, a.n_chars FROM le a LEFT JOIN le b ON a.code = b.code AND a.category IS NOT DISTINCT FROM b.category AND abs(a.n_chars - b.n_chars) BETWEEN 1 AND 20
  WHERE a.n >= 4 GROUP BY a.code, a.category, a.n_chars, a.n HAVING a.n >= 8 * (coalesce(sum(b.n), 0) / 40 + 0.1)),
re AS (SELECT o.id, coalesce(CASE WHEN said IS NOT NULL AND NOT (stopped AND s.kind <> 'code') THEN said WHEN open THEN 'open bracket' WHEN marked THEN 'marker' END,
  CASE WHEN l.n_chars IS NOT NULL AND NOT (stopped AND s.kind <> 'code') THEN 'at the limit' END) AS reason
  FROM se s JOIN ve USING (seg) JOIN ow o ON o.doc = s.doc LEFT JOIN li l ON s.last_turn AND NOT s.ended AND l.code = (o.kind = 'code') AND l.category IS NOT DISTINCT FROM o.category AND l.n_chars = o.n_chars),
cut AS (SELECT DISTINCT id, reason FROM re WHERE reason IS NOT NULL)
"""
