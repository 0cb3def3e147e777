"""Queries of the retrieval engine over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.functions import tags as tag_codec
from tesselite.functions.keys import PATH_KEY_SQL, PROJECT_KEY_SQL, project_key_of
from tesselite.functions.text import tokens
from tesselite.functions.vectors import hash_embed, hash_embedding
from tesselite.operators import conversation, identity, maintenance, ranking, recall, source_code, syntax
from tesselite.session import table
from tesselite.sources.words import word_index

QUERY = "retention schedule for the main storage queue queue"
BUSY_PROJECT = "git:forge.tidewater.example/harborworks/anchor-memory"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return recall.distinct_entries(table(spark, d, "entries"))


def _code(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where("entry_type = 'code'")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("tokens"))


def _embedded(entries: DataFrame) -> DataFrame:
    return entries.select("id", hash_embedding("text").alias("embedding"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as id, embedding."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query_vector(vectors: DataFrame, i: int = 0) -> list[float]:
    return list(vectors.where(F.col("id") == i).select("embedding").first()[0])


# --- ranking

def _code_words(spark, d):
    """The stored words of code, as an engine keeps them."""
    return word_index(spark, "code", f"{d}/entries.parquet", _code(spark, d))


def bm25_topk(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("project_id"), F.lit(None).cast("string").alias("symbol"), "text")
    return ranking.bm25_stored(*word_index(spark, "documents", f"{d}/documents.parquet", texts), QUERY, 10)


def bm25_topk_project(spark, d):
    return ranking.bm25_stored(*_code_words(spark, d), "poll main queue", 10, project_key_of(BUSY_PROJECT))


def bm25_all(spark, d):
    return ranking.bm25(ranking.tokenized(_entries(spark, d)), QUERY)


def bm25_batch(spark, d):
    return ranking.bm25_batch_stored(*_code_words(spark, d), table(spark, d, "recall_queries"), 10)


def bm25_corpus_stats(spark, d):
    return ranking.corpus_stats(_docs(spark, d))


def bm25_term_idf(spark, d):
    return ranking.term_stats(_docs(spark, d))


def token_counts(spark, d):
    return _docs(spark, d).select("id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_terms"))


def vector_topk(spark, d):
    v = _vectors(spark, d)
    return ranking.vector_topk(v, _query_vector(v), 10)


def vector_topk_filtered(spark, d):
    v = _vectors(spark, d)
    return ranking.vector_topk(v.where("label IN (1, 3, 5)"), _query_vector(v), 10)


def vector_topk_batch(spark, d):
    v = _vectors(spark, d)
    return ranking.vector_topk_batch(v, v.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 10)


def quantized_topk(spark, d):
    v = _vectors(spark, d)
    return ranking.quantized_topk(v, _query_vector(v), 10)


def hash_embed_search(spark, d):
    return ranking.vector_topk(_embedded(_entries(spark, d)), hash_embed(QUERY), 10)


def rrf_fusion(spark, d):
    e = _code(spark, d)
    near, words = ranking.vector_topk(_embedded(e), hash_embed(QUERY), 24), ranking.bm25_stored(*_code_words(spark, d), QUERY, 24)
    return ranking.rrf(near, words)


def _hybrid(spark, d):
    e = _code(spark, d)
    near, words = ranking.vector_topk(_embedded(e), hash_embed(QUERY), 24), ranking.bm25_stored(*_code_words(spark, d), QUERY, 24)
    return ranking.fused(near, words, 8), e


def hybrid_search(spark, d):
    return _hybrid(spark, d)[0]


def code_recall(spark, d):
    hits, e = _hybrid(spark, d)
    return recall.rendered(hits, e)


def hybrid_peek(spark, d):
    hits, e = _hybrid(spark, d)
    return recall.rendered(hits, e, peek=True)


def _recalled(spark, d, **filters):
    e = recall.selected(_entries(spark, d), **filters)
    return ranking.vector_topk(_embedded(e), hash_embed(QUERY), 8).withColumn("is_low", F.lit(False)), e


def recall_filtered(spark, d):
    hits, _ = _recalled(spark, d, types=["experience"], exclude_categories=["conversation", "compression"], tags=["topic:column", "topic:experience", " topic:release ", ""])
    return hits.drop("is_low")


def format_hits(spark, d):
    hits, e = _recalled(spark, d)
    return recall.rendered(hits, e)


def prefetch(spark, d):
    hits, e = _recalled(spark, d, types=["experience"], exclude_categories=["conversation", "compression"])
    return conversation.prefetch_text(recall.rendered(hits.where("rank <= 5"), e))


# --- listings

def tag_codec_query(spark, d):
    return _entries(spark, d).select("id", F.size(tag_codec.decode("tags")).alias("n_tags"), F.array_join(tag_codec.decode("tags"), "|").alias("tags"), tag_codec.encode(tag_codec.decode("tags")).isNull().alias("empty"))


def tag_overlap(spark, d):
    return _entries(spark, d).where(tag_codec.overlap("tags", ["conversation", " ", "compression"])).select("id", "category")


def list_experiences(spark, d):
    return recall.list_experiences(_entries(spark, d), 20)


def list_experiences_tagged(spark, d):
    return recall.list_experiences(_entries(spark, d), 20, category="conversation", tags=["conversation"])


def project_catalog(spark, d):
    return recall.project_catalog(table(spark, d, "projects"))


def index_status(spark, d):
    return recall.index_status(_entries(spark, d), table(spark, d, "projects"))


def indexed_projects(spark, d):
    return table(spark, d, "projects").groupBy("project_id").agg((F.count("indexed_at") > 0).alias("is_indexed"))


def entry_lookup(spark, d):
    return table(spark, d, "hit_scores").select("entry_id").distinct().join(_entries(spark, d).select(F.col("id").alias("entry_id"), "entry_type", "symbol", "path"), "entry_id")


def project_identity(spark, d):
    return table(spark, d, "projects").select("root_path", "git_remote", identity.project_id("root_path", "git_remote").alias("resolved_id")).distinct()


# --- source code

def file_scope(spark, d):
    files = table(spark, d, "file_scans").select("path", "n_bytes").distinct()
    odd = spark.createDataFrame([("node_modules/a.js", 10), ("src/.env.py", 10), (".env.py", 10), ("a/b.min.js", 10), ("a/B.PY", 512000), ("a/c.py", 512001), ("tmp/keep.go", 5), ("tmp/x.go", 5), ("a/x.lock", 3), ("README", 1)], "path string, n_bytes long")
    scoped = source_code.in_scope(files.unionByName(odd), ["tmp/", "!tmp/keep.go", "# note", "*_skip.py"])
    return scoped.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def content_hash(spark, d):
    return _code(spark, d).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


def chunk_source(spark, d):
    out = source_code.chunks(_code(spark, d).select("id", "text"), "id")
    return out.select("id", "chunk_no", "symbol", "start_line", "end_line", F.length("text").alias("n_chars"), "content_hash")


def call_edges(spark, d):
    return source_code.call_edges(_code(spark, d).select("id", "path", "text"), "id")


def chunk_syntax(spark, d):
    out = syntax.chunks(_code(spark, d).select("id", "path", "text"), "id")
    return out.select("id", "chunk_no", "symbol", "start_line", "end_line", F.length("text").alias("n_chars"), "content_hash")


def call_edges_syntax(spark, d):
    return syntax.call_edges(_code(spark, d).select("id", "path", "text"), "id")


def _hot(spark, d, column: str) -> str:
    """The most frequent name of a column, the first of equals."""
    return table(spark, d, "call_edges").groupBy(column).count().orderBy(F.desc("count"), column).first()[0]


def callers(spark, d):
    return source_code.edges_of(table(spark, d, "call_edges"), _hot(spark, d, "callee"), "callers").select("caller_symbol", "path", "caller_start_line", "callee_line")


def callees(spark, d):
    return source_code.edges_of(table(spark, d, "call_edges"), _hot(spark, d, "caller_symbol"), "callees").select("callee", "path", "caller_start_line", "callee_line")


def language_gate(spark, d):
    from functools import reduce

    names = ["team", ".java", ".py", "nowhere_at_all"]
    return reduce(DataFrame.unionByName, [source_code.call_language(_entries(spark, d), n).withColumn("name", F.lit(n)) for n in names])


# --- maintenance

def incremental_diff(spark, d):
    return maintenance.diff(maintenance.latest(table(spark, d, "file_scans")), table(spark, d, "file_hashes")).select("project_id", "path", "change")


def index_counters(spark, d):
    return maintenance.counters(incremental_diff(spark, d))


def apply_increment(spark, d):
    state = table(spark, d, "file_hashes").select("project_id", "path", F.lower("content_hash").alias("content_hash")).distinct()
    return maintenance.next_hashes(state, maintenance.diff(maintenance.latest(table(spark, d, "file_scans")), state))


def replace_changed(spark, d):
    """n_kept, n_new per project: entries after each file to index gives way to one new row, as at a scan that finds it a single chunk."""
    e = _entries(spark, d).select("id", "project_id", "path")
    changes = maintenance.diff(maintenance.latest(table(spark, d, "file_scans")), table(spark, d, "file_hashes"))
    new = changes.select(F.lit(None).cast("long").alias("id"), "project_id", "path")
    return maintenance.replaced(e, new, changes).groupBy("project_id").agg(F.count("id").alias("n_kept"), (F.count(F.lit(1)) - F.count("id")).alias("n_new"))


def _health(spark, d):
    scans = table(spark, d, "file_scans")
    projects = table(spark, d, "projects")
    return maintenance.health(_entries(spark, d), table(spark, d, "file_hashes"), table(spark, d, "call_edges"), projects, scans.where("content_hash IS NOT NULL"), projects.where("indexed_at IS NOT NULL"))


def health_check(spark, d):
    return _health(spark, d)["report"]


def health_message(spark, d):
    return maintenance.report_text(_health(spark, d)["report"])


def health_entries(spark, d):
    return _health(spark, d)["entries"].select("id")


def health_edges(spark, d):
    return _health(spark, d)["call_edges"].groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n_edges"))


# --- conversations

def _messages(spark, d):
    return conversation.messages_of(table(spark, d, "documents").where("kind = 'session'"))


def turn_retention(spark, d):
    return conversation.retained_turns(_messages(spark, d), 1)


def turn_retention_every_2(spark, d):
    return conversation.retained_turns(_messages(spark, d), 2)


def compression_summary(spark, d):
    return conversation.compression_summaries(_messages(spark, d))


def session_summary(spark, d):
    return conversation.session_summaries(_messages(spark, d))


def memory_write_mirror(spark, d):
    writes = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "add").otherwise("remove").alias("action"), F.when(F.col("user_id") % 2 == 0, "user").otherwise("store").alias("target"), F.col("props").alias("content"))
    return conversation.mirrored_writes(writes).select("event_id", "category")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_topk_project, bm25_all, bm25_batch, bm25_corpus_stats, bm25_term_idf, token_counts, vector_topk, vector_topk_filtered,
        vector_topk_batch, quantized_topk, hash_embed_search, rrf_fusion, hybrid_search, code_recall, hybrid_peek, recall_filtered, format_hits, prefetch,
        tag_overlap, list_experiences, list_experiences_tagged, project_catalog, index_status, indexed_projects, entry_lookup, project_identity, file_scope,
        content_hash, chunk_source, chunk_syntax, call_edges, call_edges_syntax, callers, callees, language_gate, incremental_diff, index_counters, apply_increment, replace_changed,
        health_check, health_message, health_entries, health_edges, turn_retention, turn_retention_every_2, compression_summary, session_summary,
        memory_write_mirror,
    )
} | {"tag_codec": tag_codec_query}

# --- the same in SQL

_TOK = r"regexp_extract_all(lower({0}), '[a-zA-Z_][\p{{L}}\p{{N}}_]*')".format
_E = "(SELECT DISTINCT * FROM entries)"
_DOCS = f"SELECT doc_id AS id, coalesce({_TOK('text')}, []) AS tokens FROM documents"


def _code_docs(where: str) -> str:
    return f"SELECT id, {_TOK('''CASE WHEN coalesce(symbol, '') <> '' THEN symbol || ' ' || coalesce(text, '') ELSE text END''')} AS tokens FROM {_E} WHERE {where}"


def _bm25_sql(docs: str, query: str, k: int | None) -> str:
    """WITH clauses that end in `bm` (id, score, rank)."""
    asked = ranking.query_tokens(query)
    terms = list(dict.fromkeys(asked))
    values = ", ".join(f"('{t}', {asked.count(t)}, {i})" for i, t in enumerate(terms))
    return f"""docs AS ({docs}), q(term, times, pos) AS (VALUES {values}),
corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs),
post AS (SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM docs) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score, min(pos) AS pos
  FROM post JOIN q USING (term) JOIN df USING (term), corpus GROUP BY id),
bm AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, pos, id) AS rank FROM sc{"" if k is None else f" QUALIFY rank <= {k}"})"""


def _near_sql(source: str, query: str, k: int) -> str:
    """WITH clauses that end in `near` (id, cosine, rank)."""
    return f"""src AS ({source}), qv AS ({query}),
cs AS (SELECT id, round(list_dot_product(e, v) / sqrt(list_dot_product(e, e) * list_dot_product(v, v)), 6) AS cosine FROM src, qv),
near AS (SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) AS rank FROM cs WHERE cosine IS NOT NULL AND NOT isnan(cosine) QUALIFY rank <= {k})"""


_EMB = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings"
_Q0 = "SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0"
_QH = f"SELECT {hash_embed(QUERY)}::DOUBLE[] AS v"


def _hashed(where: str = "true") -> str:
    raw = "list_transform(range(16), lambda i: ('0x' || substr(sha256(text), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT::DOUBLE)"
    return f"SELECT id, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS e FROM (SELECT id, {raw} AS r FROM {_E} WHERE {where})"


_HYBRID = f"""{_near_sql(_hashed("entry_type = 'code'"), _QH, 24)}, {_bm25_sql(_code_docs("entry_type = 'code'"), QUERY, 24)},
fused AS (SELECT id, round(coalesce(1 / (60 + near.rank), 0) + coalesce(1 / (60 + bm.rank), 0), 9) AS rrf, near.rank AS first_rank, bm.rank AS second_rank, coalesce(cosine, 0) AS cosine
  FROM near FULL JOIN bm USING (id)),
hits AS (SELECT id, cosine, rrf, cosine < 0.3 AS is_low, row_number() OVER (ORDER BY rrf DESC, first_rank NULLS LAST, second_rank NULLS LAST) AS rank FROM fused QUALIFY rank <= 8)"""

_HEAD = "printf('%.3f', round(cosine, 3)) || CASE WHEN is_low THEN ' [LOW-CONFIDENCE]' ELSE '' END || ']' || chr(10)"
_PLACE = "coalesce(nullif(symbol, ''), '(file)') || ' @ ' || coalesce(path, 'None') || ':' || coalesce(CAST(start_line AS VARCHAR), 'None') || '-' || coalesce(CAST(end_line AS VARCHAR), 'None')"
_CODE_HIT = f"'[code | ' || coalesce(nullif(project_id, ''), 'unknown') || ' | score ' || {_HEAD} || {_PLACE}"
_FACT_HIT = f"'[experience | ' || coalesce(nullif(category, ''), 'general') || CASE WHEN coalesce(project_id, '') <> '' THEN ' | ' || project_id ELSE '' END || ' | score ' || {_HEAD}"
_HIT = f"CASE WHEN entry_type = 'code' THEN {_CODE_HIT} || chr(10) || substr(coalesce(text, ''), 1, 400) ELSE {_FACT_HIT} || coalesce(text, '') END"
_PEEK = f"CASE WHEN entry_type = 'code' THEN {_CODE_HIT} ELSE {_FACT_HIT} || '(peek)' END"

_TAGS = "(CASE WHEN ltrim(tags) LIKE '[%' AND json_valid(tags) THEN list_filter(json_extract_string(tags, '$[*]'), lambda t: t IS NOT NULL AND regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '') ELSE [] END)"


def _overlap(*tags: str) -> str:
    return f"list_has_any(list_transform({_TAGS}, lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), [{', '.join(repr(t) for t in tags)}])"


_NO_TALK = "entry_type = 'experience' AND (category IS NULL OR category NOT IN ('conversation', 'compression'))"
_WHEN = "coalesce(strftime({0}, '%Y-%m-%d %H:%M'), 'never')".format

_MESSAGES = r"""parts AS (SELECT doc_id AS conv_id, unnest(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(^|\n)(User|Assistant): ', chr(1) || '\2: ', 'g'), chr(1))) AS part,
  generate_subscripts(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(^|\n)(User|Assistant): ', chr(1) || '\2: ', 'g'), chr(1)), 1) - 1 AS turn FROM documents WHERE kind = 'session' AND text IS NOT NULL),
m AS (SELECT conv_id, turn, CASE WHEN part LIKE 'User: %' THEN 'user' ELSE 'assistant' END AS role, regexp_replace(regexp_replace(part, '^(User|Assistant): ', ''), '\s+$', '') AS content
  FROM parts WHERE part LIKE 'User: %' OR part LIKE 'Assistant: %')"""


def _turns_sql(every: int) -> str:
    return f"""WITH {_MESSAGES},
l AS (SELECT *, lead(content) OVER w AS reply, lead(role) OVER w AS next_role FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM l WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn_no, 'User: ' || substr(content, 1, 1200) || chr(10) || 'Assistant: ' || substr(reply, 1, 1200) AS text, 'conversation' AS category,
  '["conversation","session:' || conv_id || '"]' AS tags FROM t WHERE turn_no % {every} = 0"""


def _summary_sql(source: str) -> str:
    return f"""s AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(content, 1, 500), chr(10) ORDER BY turn) AS text
  FROM {source} WHERE trim(content) <> '' GROUP BY conv_id)"""


_W = r"[\p{L}\p{N}_]+"
_LINES = "string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))"
_DECL = rf"^(?:export\s+)?(?:async\s+)?(?:def|class|func|fn|interface|struct|enum|type)\s+({_W})"
_LANG_SQL = "CASE regexp_extract(lower({0}), '(\\.[^./\\\\]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in source_code.LANGUAGES.items()) + " END"
_P, _F = PROJECT_KEY_SQL.format, PATH_KEY_SQL.format
# the newest sighting of each file by seen_at, then scan_id, unreadable or not; projects and paths in canonical form
_CHANGES = f"""new AS (SELECT * FROM (SELECT project_id, path, lower(content_hash) AS hash, {_P("project_id")} AS p, {_F("path")} AS f, row_number() OVER (PARTITION BY {_P("project_id")}, {_F("path")} ORDER BY seen_at DESC, scan_id DESC) AS n FROM file_scans) WHERE n = 1),
old AS (SELECT p, f, max(hash) AS hash, arg_max(project_id, hash || chr(1) || project_id || chr(1) || path) AS project_id, arg_max(path, hash || chr(1) || project_id || chr(1) || path) AS path
  FROM (SELECT project_id, path, lower(content_hash) AS hash, {_P("project_id")} AS p, {_F("path")} AS f FROM file_hashes) GROUP BY p, f),
ch AS (SELECT coalesce(new.p, old.p) AS p, coalesce(new.f, old.f) AS f, coalesce(new.project_id, old.project_id) AS project_id, coalesce(new.path, old.path) AS path, new.hash AS new_hash,
  CASE WHEN new.f IS NULL THEN 'gone' WHEN new.hash IS NULL THEN 'unreadable' WHEN old.f IS NULL THEN 'added' WHEN new.hash = old.hash THEN 'unchanged' ELSE 'changed' END AS change
  FROM new FULL JOIN old ON new.p = old.p AND new.f = old.f),
redone AS (SELECT p, f, project_id, path, new_hash FROM ch WHERE change IN ('added', 'changed'))"""


def _keyed_sql(name: str, path: bool = True) -> str:
    return f"(SELECT *, {_P('project_id')} AS p{', ' + _F('path') + ' AS f' if path else ''} FROM {name})"


_HEALTH = f"""live AS (SELECT DISTINCT {_P("project_id")} AS p FROM projects WHERE indexed_at IS NOT NULL AND project_id IS NOT NULL),
known AS (SELECT DISTINCT {_P("project_id")} AS p FROM projects WHERE project_id IS NOT NULL),
absent AS (SELECT p FROM known WHERE p NOT IN (SELECT p FROM live)),
present AS (SELECT p FROM known WHERE p IN (SELECT p FROM live)),
files AS (SELECT DISTINCT p, f FROM {_keyed_sql("file_scans")} WHERE content_hash IS NOT NULL),
stale AS (SELECT DISTINCT id, p, f FROM {_keyed_sql(_E)} e WHERE entry_type = 'code' AND path IS NOT NULL AND p IN (SELECT p FROM present)
  AND NOT EXISTS (SELECT 1 FROM files x WHERE x.p = e.p AND x.f = e.f)),
oh AS (SELECT * FROM {_keyed_sql("file_hashes")} h WHERE p IN (SELECT p FROM present) AND NOT EXISTS (SELECT 1 FROM files x WHERE x.p = h.p AND x.f = h.f)),
se AS (SELECT * FROM {_keyed_sql("call_edges")} c WHERE EXISTS (SELECT 1 FROM stale s WHERE s.p = c.p AND s.f = c.f)),
rep AS (SELECT (SELECT count(DISTINCT id) FROM stale) AS stale_entries, (SELECT count(*) FROM oh) AS orphan_hashes, (SELECT count(*) FROM se) AS stale_edges, (SELECT count(*) FROM absent) AS absent_projects)"""

SQL = {
    "bm25_topk": f"WITH {_bm25_sql(_DOCS, QUERY, 10)} SELECT * FROM bm",
    "bm25_topk_project": f"""WITH {_bm25_sql(_code_docs(f"entry_type = 'code' AND {PROJECT_KEY_SQL.format('project_id')} = '{project_key_of(BUSY_PROJECT)}'"), "poll main queue", 10)} SELECT * FROM bm""",
    "bm25_all": f"WITH {_bm25_sql(_code_docs('true'), QUERY, None)} SELECT * FROM bm",
    "bm25_batch": f"""WITH docs AS ({_code_docs("entry_type = 'code'")}),
qt AS (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT query_id, {_TOK('query_text')} AS t FROM recall_queries)),
q AS (SELECT query_id, term, count(*) AS times, min(pos) AS pos FROM qt GROUP BY 1, 2), corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs),
post AS (SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM docs) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score, min(pos) AS pos
  FROM post JOIN q USING (term) JOIN df USING (term), corpus GROUP BY 1, 2)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, id) AS rank FROM sc QUALIFY rank <= 10""",
    "bm25_corpus_stats": f"SELECT count(*) AS n, round(avg(len(tokens)), 6) AS avgdl FROM ({_DOCS})",
    "bm25_term_idf": f"""WITH docs AS ({_DOCS}), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM docs) GROUP BY term), c AS (SELECT count(*) AS n FROM docs)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, c""",
    "token_counts": f"SELECT id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_terms FROM ({_DOCS})",
    "vector_topk": f"WITH {_near_sql(_EMB, _Q0, 10)} SELECT * FROM near",
    "vector_topk_filtered": f"WITH {_near_sql(_EMB + ' WHERE label IN (1, 3, 5)', _Q0, 10)} SELECT * FROM near",
    "vector_topk_batch": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT q.id AS query_id, v.id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS cosine FROM v q, v WHERE q.id % 50 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM c QUALIFY rank <= 10""",
    "quantized_topk": f"""WITH src AS ({_EMB}), qv AS ({_Q0}),
cd AS (SELECT id, e, list_transform(e, lambda x: least(greatest(floor((x + 1.0) / 2.0 * 15 + 0.5), 0), 15) / 15 * 2.0 - 1.0) AS ce FROM src),
cq AS (SELECT v, list_transform(v, lambda x: least(greatest(floor((x + 1.0) / 2.0 * 15 + 0.5), 0), 15) / 15 * 2.0 - 1.0) AS cv FROM qv),
f AS (SELECT id, e, v FROM cd, cq ORDER BY round(list_dot_product(ce, cv) / sqrt(list_dot_product(ce, ce) * list_dot_product(cv, cv)), 6) DESC, id LIMIT 40),
s AS (SELECT id, round(list_dot_product(e, v) / sqrt(list_dot_product(e, e) * list_dot_product(v, v)), 6) AS cosine FROM f)
SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "hash_embed_search": f"WITH {_near_sql(_hashed(), _QH, 10)} SELECT * FROM near",
    "rrf_fusion": f"WITH {_HYBRID} SELECT id, rrf, first_rank, second_rank FROM fused",
    "hybrid_search": f"WITH {_HYBRID} SELECT * FROM hits",
    "code_recall": f"WITH {_HYBRID} SELECT id, rank, {_HIT} AS hit FROM hits JOIN {_E} USING (id)",
    "hybrid_peek": f"WITH {_HYBRID} SELECT id, rank, {_PEEK} AS hit FROM hits JOIN {_E} USING (id)",
    "recall_filtered": f"WITH {_near_sql(_hashed(_NO_TALK + ' AND ' + _overlap('topic:column', 'topic:experience', 'topic:release')), _QH, 8)} SELECT * FROM near",
    "format_hits": f"WITH {_near_sql(_hashed(), _QH, 8)} SELECT id, rank, {_HIT} AS hit FROM (SELECT *, false AS is_low FROM near) JOIN {_E} USING (id)",
    "prefetch": f"""WITH {_near_sql(_hashed(_NO_TALK), _QH, 5)}, j AS (SELECT string_agg({_HIT}, chr(10) || chr(10) ORDER BY rank) AS t FROM (SELECT *, false AS is_low FROM near) JOIN {_E} USING (id))
SELECT '## memory' || chr(10) || CASE WHEN length(t) > 4000 THEN substr(t, 1, 4000) || chr(10) || '…(truncated)' ELSE t END AS context FROM j WHERE t <> ''""",
    "tag_codec": f"SELECT id, len({_TAGS}) AS n_tags, array_to_string({_TAGS}, '|') AS tags, len({_TAGS}) = 0 AS empty FROM {_E}",
    "tag_overlap": f"SELECT id, category FROM {_E} WHERE {_overlap('conversation', 'compression')}",
    "list_experiences": f"""SELECT id, category, substr(text, 1, 200) AS text, created_at, '- #' || id || ' [' || coalesce(category, 'general') || '] ' || substr(text, 1, 200) AS line
FROM {_E} WHERE entry_type = 'experience' ORDER BY created_at DESC, id DESC LIMIT 20""",
    "list_experiences_tagged": f"""SELECT id, category, substr(text, 1, 200) AS text, created_at, '- #' || id || ' [' || coalesce(category, 'general') || '] ' || substr(text, 1, 200) AS line
FROM {_E} WHERE entry_type = 'experience' AND category = 'conversation' AND {_overlap('conversation')} ORDER BY created_at DESC, id DESC LIMIT 20""",
    "project_catalog": f"""WITH p AS (SELECT project_id, max(indexed_at) AS indexed_at, arg_max(root_path, (CASE WHEN indexed_at IS NULL THEN '0' ELSE '1' || strftime(indexed_at, '%Y%m%d%H%M%S%f') END) || root_path) AS root_path FROM projects GROUP BY project_id)
SELECT project_id, root_path, indexed_at, {_WHEN("indexed_at")} AS indexed, row_number() OVER (ORDER BY indexed_at DESC NULLS LAST, project_id) AS position FROM p""",
    "index_status": f"""WITH c AS (SELECT p AS project_id, count(*) FILTER (entry_type = 'code') AS code_entries, count(*) FILTER (entry_type = 'experience') AS experiences FROM (SELECT coalesce(project_id, '(none)') AS p, entry_type FROM {_E}) GROUP BY ROLLUP (p)),
t AS (SELECT project_id, max(indexed_at) AS x FROM projects GROUP BY ROLLUP (project_id))
SELECT c.project_id, code_entries, experiences, {_WHEN("x")} AS last_indexed FROM c LEFT JOIN t ON c.project_id IS NOT DISTINCT FROM t.project_id""",
    "indexed_projects": "SELECT project_id, count(indexed_at) > 0 AS is_indexed FROM projects GROUP BY project_id",
    "entry_lookup": f"SELECT entry_id, entry_type, symbol, path FROM (SELECT DISTINCT entry_id FROM hit_scores) JOIN {_E} e ON e.id = entry_id",
    "project_identity": r"""WITH r AS (SELECT DISTINCT root_path, git_remote, trim(git_remote) AS u FROM projects),
a AS (SELECT *, CASE WHEN u LIKE 'https://%' THEN substr(u, 9) ELSE u END AS u1 FROM r), b AS (SELECT *, CASE WHEN u1 LIKE 'http://%' THEN substr(u1, 8) ELSE u1 END AS u2 FROM a),
c AS (SELECT *, CASE WHEN u2 LIKE 'git@%' THEN substr(u2, 5) ELSE u2 END AS u3 FROM b), e AS (SELECT *, CASE WHEN u3 LIKE 'ssh://%' THEN substr(u3, 7) ELSE u3 END AS u4 FROM c)
SELECT root_path, git_remote, CASE WHEN coalesce(u, '') <> '' THEN 'git:' || lower(regexp_replace(u4, '\.git$', '')) ELSE 'local:' || root_path END AS resolved_id FROM e""",
    "file_scope": f"""WITH f AS (SELECT DISTINCT path, n_bytes FROM file_scans UNION ALL VALUES ('a/B.PY', 512000), ('tmp/keep.go', 5), ('src/.env.py', 10))
SELECT {_LANG_SQL.format("path")} AS language, count(*) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM f
WHERE {_LANG_SQL.format("path")} IS NOT NULL AND n_bytes <= 512000 AND NOT list_has_any(string_split(path, '/'), {list(source_code.DENIED_PARTS)}) GROUP BY 1""",
    "content_hash": f"SELECT id, sha256(text) AS content_hash FROM {_E} WHERE entry_type = 'code'",
    "chunk_source": f"""WITH l AS (SELECT id, {_LINES} AS ls FROM {_E} WHERE entry_type = 'code' AND text IS NOT NULL),
x AS (SELECT id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
a AS (SELECT id, n, i, regexp_extract(line, '{_DECL}', 1) AS symbol FROM x WHERE regexp_matches(line, '{_DECL}')),
c AS (SELECT id, n, i, symbol, row_number() OVER w AS chunk_no, lead(i) OVER w AS nxt FROM a WINDOW w AS (PARTITION BY id ORDER BY i)),
b AS (SELECT c.id, chunk_no, symbol, i AS start_line, coalesce(nxt, n) AS end_line, array_to_string(ls[i:coalesce(nxt - 1, n)], chr(10)) || CASE WHEN nxt IS NULL THEN '' ELSE chr(10) END AS t FROM c JOIN l USING (id) WHERE chunk_no <= 200
  UNION ALL SELECT id, 1, NULL, 1, greatest(1, CASE WHEN ls[-1] = '' THEN len(ls) - 1 ELSE len(ls) END), array_to_string(ls, chr(10)) FROM l WHERE id NOT IN (SELECT id FROM a))
SELECT id, chunk_no, symbol, start_line, end_line, least(length(t), 12000) AS n_chars, sha256(t) AS content_hash FROM b""",
    "call_edges": rf"""WITH l AS (SELECT id, {_LANG_SQL.format("path")} AS lang, {_LINES} AS ls FROM {_E} WHERE entry_type = 'code' AND text IS NOT NULL),
x AS (SELECT id, lang, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l WHERE lang IN {tuple(source_code.FUNCTION_KEYWORDS)}),
d AS (SELECT *, CASE WHEN lang = 'python' THEN regexp_extract(line, '^def\s+({_W})\s*\(', 1) WHEN lang = 'go' THEN regexp_extract(trim(line, ' ' || chr(9)), '^func\s+({_W})\s*\(', 1)
  WHEN lang = 'rust' THEN regexp_extract(trim(line, ' ' || chr(9)), '^fn\s+({_W})\s*\(', 1) ELSE regexp_extract(trim(line, ' ' || chr(9)), '^function\s+({_W})\s*\(', 1) END AS def FROM x),
s AS (SELECT *, last_value(nullif(def, '') IGNORE NULLS) OVER w AS caller, last_value(CASE WHEN def <> '' THEN i END IGNORE NULLS) OVER w AS start FROM d WINDOW w AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)),
c AS (SELECT id, lang, caller, start, i, unnest(regexp_extract_all(line, '\b([A-Za-z_][\p{{L}}\p{{N}}_]*)\s*\(', 1)) AS callee FROM s WHERE def = '' AND caller IS NOT NULL)
SELECT id, caller AS caller_symbol, callee, start AS caller_start_line, i AS caller_end_line, i AS callee_line FROM c
WHERE callee <> caller AND callee NOT IN {source_code.NO_CALLS} AND (lang = 'python' OR callee NOT IN ('function', 'func', 'fn'))""",
    "callers": """SELECT caller_symbol, path, caller_start_line, callee_line FROM call_edges
WHERE callee = (SELECT callee FROM call_edges GROUP BY callee ORDER BY count(*) DESC, callee LIMIT 1)""",
    "callees": """SELECT callee, path, caller_start_line, callee_line FROM call_edges
WHERE caller_symbol = (SELECT caller_symbol FROM call_edges GROUP BY caller_symbol ORDER BY count(*) DESC, caller_symbol LIMIT 1)""",
    "language_gate": f"""WITH n(name) AS (VALUES ('team'), ('.java'), ('.py'), ('nowhere_at_all')),
m AS (SELECT name, id, {_LANG_SQL.format("path")} AS lang, row_number() OVER (PARTITION BY name ORDER BY id, path) AS r FROM {_E}, n WHERE entry_type = 'code' AND (symbol = name OR lower(path) LIKE '%' || name || '%'))
SELECT m.id, e.path, coalesce(lang, 'unknown') AS language, coalesce(lang IN {tuple(source_code.FUNCTION_KEYWORDS)}, false) AS supported, name FROM m JOIN {_E} e USING (id) WHERE r = 1""",
    "incremental_diff": f"WITH {_CHANGES} SELECT project_id, path, change FROM ch",
    "index_counters": f"WITH {_CHANGES} SELECT change, count(*) AS n_files FROM ch GROUP BY change",
    "apply_increment": f"""WITH {_CHANGES}
SELECT project_id, path, hash AS content_hash FROM (SELECT DISTINCT project_id, path, lower(content_hash) AS hash, {_P("project_id")} AS p, {_F("path")} AS f FROM file_hashes) h
WHERE NOT EXISTS (SELECT 1 FROM redone n WHERE n.p = h.p AND n.f = h.f) UNION ALL SELECT project_id, path, new_hash FROM redone""",
    "replace_changed": f"""WITH {_CHANGES}, kept AS (SELECT id, project_id, path FROM {_keyed_sql(_E)} e WHERE NOT EXISTS (SELECT 1 FROM redone n WHERE n.p = e.p AND n.f = e.f)),
fresh AS (SELECT NULL AS id, project_id, path FROM redone)
SELECT project_id, count(id) AS n_kept, count(*) - count(id) AS n_new FROM (SELECT * FROM kept UNION ALL SELECT * FROM fresh) GROUP BY project_id""",
    "health_check": f"WITH {_HEALTH} SELECT * FROM rep",
    "health_message": f"""WITH {_HEALTH}, p AS (SELECT array_to_string(list_filter([CASE WHEN stale_entries > 0 THEN stale_entries || ' stale Code Entries' END, CASE WHEN orphan_hashes > 0 THEN orphan_hashes || ' orphaned file hashes' END,
  CASE WHEN stale_edges > 0 THEN stale_edges || ' stale call graph edges' END, CASE WHEN absent_projects > 0 THEN absent_projects || ' absent project(s) removed' END], lambda x: x IS NOT NULL), ', ') AS t FROM rep)
SELECT CASE WHEN t = '' THEN 'Index health check complete: no stale entries found.' ELSE 'Index health check complete. Removed ' || t || '.' END AS message FROM p""",
    "health_entries": f"WITH {_HEALTH} SELECT id FROM {_keyed_sql(_E, False)} WHERE (p IS NULL OR p NOT IN (SELECT p FROM absent)) AND id NOT IN (SELECT id FROM stale)",
    "health_edges": f"""WITH {_HEALTH} SELECT project_id, path, count(*) AS n_edges FROM {_keyed_sql("call_edges")} c WHERE p NOT IN (SELECT p FROM absent)
  AND NOT EXISTS (SELECT 1 FROM stale s WHERE s.p = c.p AND s.f = c.f) GROUP BY 1, 2""",
    "turn_retention": _turns_sql(1),
    "turn_retention_every_2": _turns_sql(2),
    "compression_summary": f"""WITH {_MESSAGES}, z AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10), {_summary_sql("z")}
SELECT conv_id, text, 'compression' AS category, '["compression","session:' || conv_id || '"]' AS tags FROM s""",
    "session_summary": f"""WITH {_MESSAGES}, {_summary_sql("m")}
SELECT conv_id, CASE WHEN length(text) > 4800 THEN substr(text, 1, 4800) || chr(10) || '…(truncated)' ELSE text END AS text, 'conversation' AS category, '["session-end","conversation","session:' || conv_id || '"]' AS tags FROM s""",
    "memory_write_mirror": "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'user_pref' ELSE 'general' END AS category FROM events WHERE event_type = 'click' AND coalesce(props, '') <> ''",
}
