"""Queries p1 and p6, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.functions.keys import PATH_KEY_SQL, PROJECT_KEY_SQL, path_key, project_key
from tesselite.operators.changes import latest_indexed, reread_points, unprocessed
from tesselite.operators.references import Reference, looked_up, orphan_report, orphans
from tesselite.session import table


def references(spark: SparkSession, d: str) -> list[Reference]:
    """The references of entries and call_edges."""
    entries, edges = table(spark, d, "entries"), table(spark, d, "call_edges")
    projects, files, runtime = table(spark, d, "projects"), table(spark, d, "file_hashes"), table(spark, d, "runtime_symbols")
    known_files = files.select(project_key("project_id"), path_key("path"))
    symbols = entries.where((F.col("entry_type") == "code") & F.col("symbol").isNotNull() & F.col("project_id").isNotNull()).select("symbol", project_key("project_id"))
    edge_key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("project_id", "path", "caller_symbol", "callee")])
    times = latest_indexed(projects).select(F.col("project_key").alias("_pk"), "indexed_at")
    dated = looked_up(edges.withColumn("_pk", project_key("project_id")), times, "_pk")
    month, run_month = F.date_format("created_at", "yyyy-MM"), F.date_format("indexed_at", "yyyy-MM")
    p, f = project_key("project_id"), path_key("path")
    entry_id = F.col("id").cast("string")
    return [
        Reference("entries.project_id", entries, [p], [projects.select(project_key("project_id"))], entry_id, month),
        Reference("entries.path", entries, [p, f], [known_files], entry_id, month),
        Reference("call_edges.path", dated, [p, f], [known_files], edge_key, run_month),
        Reference("call_edges.callee", dated, [F.col("callee"), p], [symbols, runtime.select("symbol")], edge_key, run_month),
    ]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(references(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(references(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    files = unprocessed(table(spark, d, "file_scans"), table(spark, d, "file_hashes"), table(spark, d, "projects"))
    return files.select("project_id", "path")


def p6_reread(spark: SparkSession, d: str) -> DataFrame:
    """The files among them that arrived since each project's last run: a scan is a transaction, begun when it was seen and visible when it arrived; the run is the project's indexed_at."""
    scans, projects = table(spark, d, "file_scans"), table(spark, d, "projects")
    transactions = scans.select("project_id", F.col("seen_at").alias("began_at"), F.col("arrived_at").alias("ended_at"))
    points = reread_points(transactions, latest_indexed(projects).withColumnRenamed("indexed_at", "last_success"))
    return unprocessed(scans, table(spark, d, "file_hashes"), projects, reread_from=points)


_P, _F = PROJECT_KEY_SQL.format, PATH_KEY_SQL.format

P1_REFERENCES_SQL = f"""
WITH f AS (SELECT DISTINCT {_P("project_id")} p, {_F("path")} f FROM file_hashes),
pr AS (SELECT {_P("project_id")} p, max(indexed_at) t FROM projects GROUP BY 1),
sy AS (SELECT DISTINCT {_P("project_id")} p, symbol s FROM entries WHERE entry_type = 'code' AND symbol IS NOT NULL),
e AS (SELECT DISTINCT id, {_P("project_id")} p, {_F("path")} f, strftime(created_at, '%Y-%m') m FROM entries),
c AS (SELECT DISTINCT {_P("x.project_id")} p, {_F("x.path")} f, x.callee, coalesce(strftime(pr.t, '%Y-%m'), 'none') m,
  concat_ws('|', coalesce(x.project_id, ''), coalesce(x.path, ''), coalesce(x.caller_symbol, ''), coalesce(x.callee, '')) k
  FROM call_edges x LEFT JOIN pr ON pr.p = {_P("x.project_id")}),
r AS (
SELECT 'entries.project_id' ref_field, CAST(id AS VARCHAR) record_key, coalesce(m, 'none') period, p AS k1, NULL AS k2 FROM e WHERE p IS NOT NULL AND p NOT IN (SELECT p FROM pr WHERE p IS NOT NULL)
UNION ALL SELECT 'entries.path', CAST(id AS VARCHAR), coalesce(m, 'none'), p, f FROM e WHERE p IS NOT NULL AND f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.p = e.p AND f.f = e.f)
UNION ALL SELECT 'call_edges.path', k, m, p, f FROM c WHERE p IS NOT NULL AND f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.p = c.p AND f.f = c.f)
UNION ALL SELECT 'call_edges.callee', k, m, p, callee FROM c WHERE p IS NOT NULL AND callee IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sy WHERE sy.p = c.p AND sy.s = c.callee)
  AND callee NOT IN (SELECT symbol FROM runtime_symbols WHERE symbol IS NOT NULL))
"""

P6_SQL = f"""
WITH s AS (SELECT project_id, path, content_hash, {_P("project_id")} p, {_F("path")} f,
  row_number() OVER (PARTITION BY {_P("project_id")}, {_F("path")} ORDER BY seen_at DESC, scan_id DESC) n FROM file_scans),
i AS (SELECT {_P("project_id")} p FROM projects GROUP BY 1 HAVING max(indexed_at) IS NOT NULL)
SELECT project_id, path FROM s WHERE n = 1 AND content_hash IS NOT NULL AND (p NOT IN (SELECT p FROM i) OR NOT EXISTS (
  SELECT 1 FROM file_hashes h WHERE {_P("h.project_id")} = s.p AND {_F("h.path")} = s.f AND lower(h.content_hash) = lower(s.content_hash)))
"""

_P6_REREAD_SQL = f"""
WITH k AS (SELECT *, {_P("project_id")} p, {_F("path")} f FROM file_scans),
i AS (SELECT {_P("project_id")} p, max(indexed_at) t FROM projects GROUP BY 1 HAVING max(indexed_at) IS NOT NULL),
o AS (SELECT i.p, least(any_value(i.t), min(k.seen_at) FILTER (k.seen_at <= i.t AND (k.arrived_at IS NULL OR k.arrived_at > i.t))) AS since FROM i LEFT JOIN k ON k.p = i.p GROUP BY i.p),
a AS (SELECT DISTINCT k.p, k.f FROM k LEFT JOIN o ON o.p = k.p WHERE o.since IS NULL OR k.arrived_at >= o.since),
s AS (SELECT *, row_number() OVER (PARTITION BY p, f ORDER BY seen_at DESC, scan_id DESC) n FROM k)
SELECT project_id, path, content_hash FROM s WHERE n = 1 AND content_hash IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.p = s.p AND a.f = s.f) AND (p NOT IN (SELECT p FROM i) OR NOT EXISTS (
  SELECT 1 FROM file_hashes h WHERE {_P("h.project_id")} = s.p AND {_F("h.path")} = s.f AND lower(h.content_hash) = lower(s.content_hash)))
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p6_found": p6_found, "p6_reread": p6_reread}
SQL = {
    "p1_found": P1_REFERENCES_SQL + "SELECT DISTINCT ref_field, record_key, period FROM r",
    "p1_report": P1_REFERENCES_SQL
    + "SELECT ref_field, period, count(DISTINCT (k1, k2)) AS n_keys, count(*) AS n_records FROM (SELECT DISTINCT * FROM r) GROUP BY 1, 2",
    "p6_found": P6_SQL,
    "p6_reread": _P6_REREAD_SQL,
}
