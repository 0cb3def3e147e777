"""Queries p2 to p5 and p7 to p10, over whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.llm import history_dedup, ideal_rank, leakage, neighbours, packing, reading, secrets, secrets_sql, truncation, truncation_sql
from tesselite.session import table


def p2_repeats(spark: SparkSession, d: str) -> DataFrame:
    return history_dedup.repeats(table(spark, d, "entries"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_repeats(spark, d).select(F.least("id", "repeat_of").alias("id_a"), F.greatest("id", "repeat_of").alias("id_b")).distinct()


# accepted entries are found one after the other: whoever has an earlier partner that isn't rejected is rejected
_REPEATS = r"""
WITH RECURSIVE e AS (SELECT id, min(entry_type) AS k, min(text) AS t, min(created_at) AS born FROM entries WHERE text IS NOT NULL GROUP BY id),
w AS (SELECT id, born, k, list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS ws, regexp_replace(t, '\s+', '', 'g') AS bare FROM e),
n AS (SELECT *, row_number() OVER (ORDER BY born NULLS FIRST, id) AS pos FROM w WHERE CASE WHEN k = 'code' THEN bare <> '' ELSE len(ws) > 0 END),
p AS (SELECT a.pos AS first, b.pos AS later FROM n a JOIN n b ON a.bare = b.bare AND a.pos < b.pos WHERE a.k = 'code' AND b.k = 'code'
  UNION ALL SELECT a.pos, b.pos FROM n a JOIN n b ON a.pos < b.pos WHERE a.k <> 'code' AND b.k <> 'code'
  AND least(len(a.ws), len(b.ws)) >= 0.8 * greatest(len(a.ws), len(b.ws)) AND len(list_intersect(a.ws, b.ws)) >= 0.8 * greatest(len(a.ws), len(b.ws))),
s AS (SELECT later, list(first) AS firsts, row_number() OVER (ORDER BY later) AS i FROM p GROUP BY later),
r(i, rejected) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT s.i, CASE WHEN len(list_filter(firsts, lambda x: NOT list_contains(rejected, x))) > 0 THEN list_append(rejected, later) ELSE rejected END FROM r JOIN s ON s.i = r.i + 1),
f AS (SELECT unnest(rejected) AS pos FROM (SELECT rejected FROM r ORDER BY i DESC LIMIT 1)),
t AS (SELECT later, min(first) AS first FROM p WHERE later IN (SELECT pos FROM f) AND first NOT IN (SELECT pos FROM f) GROUP BY later),
found AS (SELECT b.id, a.id AS repeat_of FROM t JOIN n a ON a.pos = t.first JOIN n b ON b.pos = t.later)
"""
P2_SQL = {
    "p2_found": _REPEATS + "SELECT DISTINCT least(id, repeat_of) AS id_a, greatest(id, repeat_of) AS id_b FROM found",
    "p2_repeats": _REPEATS + "SELECT DISTINCT id, repeat_of FROM found",
}

HIT_SCORES = {"bm25": 1, "cosine": 1, "caller_count": 1, "age_days": -1}


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    closed = ideal_rank.closeness(table(spark, d, "hit_scores"), group="query_id", item="entry_id", better=HIT_SCORES)
    return ideal_rank.ranked(closed, group="query_id", item="entry_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    closed = ideal_rank.closeness(table(spark, d, "hit_scores"), group="query_id", item="entry_id", better=HIT_SCORES)
    return ideal_rank.ranked(closed, group="query_id", item="entry_id", top=5).select("query_id", "entry_id")


def _p3_sql() -> str:
    """Ideal-point closeness in SQL."""
    names = list(HIT_SCORES)

    def each(form: str, sep: str = ", ") -> str:
        return sep.join(form.format(n=n, s=HIT_SCORES[n]) for n in names)

    return f"""
WITH r AS (SELECT query_id, entry_id, {each("max(CAST({n} AS DOUBLE) * {s}) {n}")} FROM hit_scores WHERE query_id IS NOT NULL AND entry_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT query_id, {each("quantile_disc({n}, 0.2) lo_{n}, quantile_disc({n}, 0.8) hi_{n}")} FROM r GROUP BY 1),
c AS (SELECT query_id, entry_id, {each("CASE WHEN {n} IS NOT NULL THEN greatest(least({n}, hi_{n}), lo_{n}) END {n}")} FROM r JOIN l USING (query_id)),
a AS (SELECT query_id, {each("avg({n}) a_{n}, min({n}) w_{n}, max({n}) b_{n}")} FROM c GROUP BY 1),
m AS (SELECT query_id, {each("sqrt(sum(({n} - a_{n}) ** 2)) n_{n}")} FROM c JOIN a USING (query_id) GROUP BY 1),
d AS (SELECT query_id, entry_id, sqrt({each("CASE WHEN b_{n} > w_{n} THEN ((b_{n} - coalesce({n}, w_{n})) / n_{n}) ** 2 ELSE 0 END", " + ")}) p,
  sqrt({each("CASE WHEN b_{n} > w_{n} THEN ((coalesce({n}, w_{n}) - w_{n}) / n_{n}) ** 2 ELSE 0 END", " + ")}) q FROM c JOIN a USING (query_id) JOIN m USING (query_id)),
k AS (SELECT query_id, entry_id, round(CASE WHEN p + q > 0 THEN q / (p + q) ELSE 0 END, 9) closeness FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, entry_id) AS rank FROM k)
"""


P3_SQL = _p3_sql()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "entries")).select("id").distinct()


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "entries")
    return truncation.shares(entries, truncation.truncated(entries))


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "entries"))


_CUT = truncation_sql.build()
P4_SQL = {
    "p4_found": _CUT + "SELECT DISTINCT id FROM cut",
    "p4_reasons": _CUT + "SELECT id, reason FROM cut",
    "p4_shares": _CUT
    + """, ent AS (SELECT DISTINCT id, category FROM entries), ids AS (SELECT DISTINCT id FROM cut)
SELECT category, count(*) AS n_entries, count(ids.id) AS n_cut, round(count(ids.id) / count(*), 6) AS cut_share FROM ent LEFT JOIN ids ON ids.id = ent.id GROUP BY category""",
}


def _code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").where(F.col("entry_type") == "code")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(_code(spark, d)).select("id", "line_no").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(_code(spark, d), redacted=True)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "vectors"), min_cosine=0.9, visits=4)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


P7_SQL = """
WITH v AS (SELECT DISTINCT id, CAST(embedding AS DOUBLE[]) e FROM vectors WHERE len(embedding) = 64),
n AS (SELECT id, e, sqrt(list_dot_product(e, e)) s FROM v WHERE list_dot_product(e, e) > 0 AND NOT isnan(list_dot_product(e, e))),
c AS (SELECT a.id x, b.id y, list_dot_product(a.e, b.e) / a.s / b.s cos FROM n a, n b WHERE a.id <> b.id),
r AS (SELECT x, y, cos, row_number() OVER (PARTITION BY x ORDER BY round(cos, 9) DESC, y) k FROM c WHERE cos >= 0.9)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE k <= 10
"""


def p8_fillings(spark: SparkSession, d: str) -> DataFrame:
    return packing.fillings(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_fillings(spark, d), table(spark, d, "context_windows"))


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.overlaps(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_overlaps(spark, d).where(F.col("run") >= 13).select("doc_id", "item_id").distinct()


def p9_leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(p9_overlaps(spark, d).where(F.col("run") >= 13))


_GRAMS = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) p FROM dw)),
ig AS (SELECT item_id, n, q, array_to_string(w[q:q + 12], ' ') g FROM (SELECT item_id, w, len(w) n, unnest(range(1, len(w) - 11)) q FROM iw)),
h AS (SELECT DISTINCT doc_id, item_id, n, p, q FROM dg JOIN ig USING (g))
"""
P9_SQL = _GRAMS + "SELECT DISTINCT doc_id, item_id FROM h"
# a run of r words holds r - 12 grams on one diagonal, one after the other
P9_LEAKED_SQL = (
    _GRAMS
    + """, i AS (SELECT doc_id, item_id, n, p - q d, q - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY q) isle FROM h),
r AS (SELECT doc_id, item_id, n, count(*) + 12 run FROM i GROUP BY doc_id, item_id, n, d, isle)
SELECT item_id, count(DISTINCT doc_id) AS n_documents, max(run) AS longest_run, round(max(run / n), 6) AS share FROM r GROUP BY item_id
"""
)


def _p9_overlaps_sql() -> str:
    """Overlaps of documents and items on every diagonal that some mask hits, word by word."""

    def masked(words: str, at: str) -> str:
        return " UNION ALL ".join(f"SELECT k, {m} AS m, {at}, " + " || ' ' || ".join(f"w[{at} + {i}]" for i, bit in enumerate(mask) if bit == "1") + f" AS g FROM (SELECT k, w, unnest(range(1, len(w) - 11)) AS {at} FROM {words})" for m, mask in enumerate(leakage.SEEDS))

    return f"""
WITH dw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
iw AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT DISTINCT item_id, text FROM eval_items WHERE text IS NOT NULL)),
dg AS ({masked("dw", "p")}), ig AS ({masked("iw", "q")}),
h AS (SELECT row_number() OVER () AS n, * FROM (SELECT DISTINCT dg.k AS dk, ig.k AS ik, p - q AS d FROM dg JOIN ig USING (m, g))),
e AS (SELECT n, j, dw.w[j + 1] = iw.w[j - d + 1] AS same FROM (SELECT h.*, unnest(range(greatest(0, d), least(len(dw.w), len(iw.w) + d))) AS j FROM h JOIN dw ON dw.k = dk JOIN iw ON iw.k = ik) x JOIN dw ON dw.k = dk JOIN iw ON iw.k = ik),
t AS (SELECT *, sum(CASE WHEN same THEN 200 ELSE -800 END) OVER w AS total, j - row_number() OVER (PARTITION BY n, same ORDER BY j) AS isle FROM e WINDOW w AS (PARTITION BY n ORDER BY j)),
r AS (SELECT n, max(c) AS run FROM (SELECT n, count(*) AS c FROM t WHERE same GROUP BY n, isle) GROUP BY n),
g AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY n ORDER BY j)) AS gain FROM t),
z AS (SELECT n, min(j) AS last FROM g JOIN (SELECT n, max(gain) AS gain FROM g GROUP BY n) USING (n, gain) WHERE gain > 0 GROUP BY n),
b AS (SELECT n, last, least(0, min(total)) AS low FROM t JOIN z USING (n) WHERE j <= last GROUP BY n, last),
f AS (SELECT n, last, coalesce(min(j) FILTER (low < 0 AND total = low) + 1, min(j)) AS first FROM t JOIN b USING (n) WHERE j <= last GROUP BY n, last),
s AS (SELECT n, last - first + 1 AS stretch, count(*) FILTER (same) AS stretch_equal FROM t JOIN f USING (n) WHERE j BETWEEN first AND last GROUP BY n, last, first),
o AS (SELECT dk, ik, max(coalesce(run, 0)) AS run, max((coalesce(stretch, 0), coalesce(stretch_equal, 0))) AS best FROM h LEFT JOIN r USING (n) LEFT JOIN s USING (n) GROUP BY dk, ik)
SELECT DISTINCT doc_id, item_id, len(iw.w) AS item_words, run, best[1] AS stretch, best[2] AS stretch_equal FROM o JOIN dw ON dw.k = dk JOIN iw ON iw.k = ik WHERE run >= 13 OR best[1] >= 13
"""


P9_OVERLAPS_SQL = _p9_overlaps_sql()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_bands(table(spark, d, "documents"), table(spark, d, "graded_passages"))


QUERIES = {"p2_found": p2_found, "p2_repeats": p2_repeats, "p3_found": p3_found, "p3_ranking": p3_ranking, "p4_found": p4_found, "p4_shares": p4_shares, "p4_reasons": p4_reasons, "p5_found": p5_found, "p5_redacted": p5_redacted, "p7_found": p7_found, "p8_fillings": p8_fillings, "p8_usage": p8_usage, "p9_found": p9_found, "p9_overlaps": p9_overlaps, "p9_leaked": p9_leaked, "p10_found": p10_found}
SQL = {**P2_SQL, **P4_SQL, "p5_found": secrets_sql.build(), "p3_found": P3_SQL + "SELECT query_id, entry_id FROM f WHERE rank <= 5", "p3_ranking": P3_SQL + "SELECT query_id, entry_id, closeness, rank FROM f", "p7_found": P7_SQL, "p9_found": P9_SQL, "p9_overlaps": P9_OVERLAPS_SQL, "p9_leaked": P9_LEAKED_SQL}
