"""Okapi BM25, exact and coded vector search, and reciprocal rank fusion.

Defined results: NULL texts have no tokens and NULL, zero or wrong-length vectors no score; rows
without a match get no rank; every order is total (ties by first matching query term, then id), so
equal scores rank the same everywhere; scores are rounded to six places before they are compared.
A query without tokens, or an empty table, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselite.functions.keys import project_key
from tesselite.functions.text import TOKEN, document_text, tokens
from tesselite.functions.vectors import codes, cosine, decoded, unpacked
from tesselite.operators.ordering import range_ranked
from tesselite.session import materialize

# fixed values: the constants of the formula
K1, B = 1.5, 0.75


def tokenized(entries: DataFrame) -> DataFrame:
    """id, tokens of every entry, its symbol before its text."""
    return entries.select("id", F.coalesce(tokens(document_text("symbol", "text")), F.array().cast("array<string>")).alias("tokens"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n, avgdl in one row. docs: id, tokens."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("tokens")), 6).alias("avgdl"))


def postings(docs: DataFrame) -> DataFrame:
    """id, term, tf: the inverted index."""
    return docs.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """term, df, idf of every term. Distinct terms of a document are found in place, so one shuffle of counts is all."""
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def query_tokens(query: str) -> list[str]:
    """Tokens of a query on the driver, as tokens() makes them; the pattern is a fixed value."""
    return regex.findall(TOKEN, query.lower())


BUCKETS = 64


def indexed(entries: DataFrame) -> DataFrame:
    """id, project_key, term, tf, dl, bucket: the inverted index of entries (id, project_id, symbol, text) as it is stored, in order of term within a bucket."""
    docs = entries.select("id", project_key("project_id").alias("project_key"), F.coalesce(tokens(document_text("symbol", "text")), F.array().cast("array<string>")).alias("tokens"))
    rows = docs.select("id", "project_key", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    post = rows.groupBy("id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("project_key").alias("project_key"), F.first("dl").alias("dl"))
    return post.withColumn("bucket", bucket_of(F.col("term"))).repartition("bucket").sortWithinPartitions("bucket", "term").select("id", "project_key", "term", "tf", "dl", "bucket")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def corpus_counts(entries: DataFrame) -> DataFrame:
    """project_key, n, n_tokens: what the entries add to the corpus."""
    sized = entries.select(project_key("project_id").alias("project_key"), F.coalesce(F.size(tokens(document_text("symbol", "text"))), F.lit(0)).alias("dl"))
    return sized.groupBy("project_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("dl", F.lit(0))).cast("long").alias("n_tokens"))


def bm25_stored(postings: DataFrame, corpus: DataFrame, query: str, k: int | None = None, project: str | None = None) -> DataFrame:
    """id, score, rank as bm25 gives them, from a stored index: only the buckets of the query's terms are opened, and of them the terms' rows.

    project: the canonical form of a project whose entries are the corpus; None takes all.
    """
    asked = query_tokens(query)
    terms = list(dict.fromkeys(asked))
    spark = postings.sparkSession
    empty = spark.createDataFrame([], "id long, score double, rank int")
    if project is not None:
        postings, corpus = postings.where(F.col("project_key") == project), corpus.where(F.col("project_key") == project)
    n, total = corpus.agg(F.sum("n"), F.sum("n_tokens")).first()
    if not terms or not n or not total:
        return empty
    # over an inline table, which the optimizer computes without a job
    buckets = sorted(set(spark.sql("SELECT 0 FROM VALUES (0)").select(F.array(*[bucket_of(F.lit(t)) for t in terms])).first()[0]))
    rows = postings.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))
    docs = rows.groupBy("id").agg(F.first("dl").alias("dl"), *[F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(terms)])
    docs = materialize(docs, "hits")
    df = docs.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    return _scored(docs, asked, terms, n, total / n, [df[f"df{i}"] for i in range(len(terms))], k)


def _scored(rows: DataFrame, asked: list[str], terms: list[str], n: int, avgdl: float, dfs: list[int], k: int | None) -> DataFrame:
    """rows: id, dl, tf0, tf1 and so on."""
    score, first = F.lit(0.0), F.lit(None).cast("int")
    for i, (w, df) in enumerate(zip(terms, dfs)):
        if df:
            weight = asked.count(w) * math.log(1.0 + (n - df + 0.5) / (df + 0.5)) * (K1 + 1)
            score = score + F.lit(weight) * F.col(f"tf{i}") / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / avgdl))
        first = F.coalesce(first, F.when(F.col(f"tf{i}") > 0, F.lit(i)))
    scored = rows.select("id", F.round(score, 6).alias("score"), first.alias("first")).where(F.col("first").isNotNull())
    return ranked(scored, k, [F.desc("score"), F.col("first"), F.col("id")]).select("id", "score", "rank")


def _equals(word: str):
    return lambda t: t == F.lit(word)


def bm25(docs: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """id, score, rank of the best k documents, or all that match.

    The terms of one query are few and known, so a row keeps only those of its own tokens, with its
    length, in a narrow table; the texts are read once. From that table come n, average length and the
    terms' document frequencies in one row, then the scores. No posting is shuffled; the best k are kept
    per task before they meet.
    """
    asked = query_tokens(query)
    terms = list(dict.fromkeys(asked))
    spark = docs.sparkSession
    if not terms:
        return spark.createDataFrame([], "id long, score double, rank int")
    docs = materialize(docs.select("id", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(*terms)).alias("tokens")), "hits")
    tf = [F.size(F.filter("tokens", _equals(w))) for w in terms]
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.array_contains("tokens", w)).alias(f"df{i}") for i, w in enumerate(terms)]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 0.0
    if not n or not avgdl:
        return spark.createDataFrame([], "id long, score double, rank int")
    rows = docs.where(F.size("tokens") > 0).select("id", "dl", *[t.alias(f"tf{i}") for i, t in enumerate(tf)])
    return _scored(rows, asked, terms, n, avgdl, [stats[f"df{i}"] for i in range(len(terms))], k)


def ranked(scored: DataFrame, k: int | None, order: list) -> DataFrame:
    """With a rank by `order`. The best k are taken before the window, which then sees k rows only; all are ranked by ranges."""
    if k is None:
        return range_ranked(scored, order)
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int = 10, salts: int = 8) -> DataFrame:
    """query_id, id, score, rank for a table of queries (query_id, query_text); docs: id, tokens. Postings are made of the queries' terms only."""
    wanted = queries.select(F.explode(tokens("query_text")).alias("term")).distinct()
    rows = docs.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    post = rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    corpus = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("n_tokens"))
    return bm25_batch_stored(post, corpus, queries, k, salts)


def bm25_batch_stored(postings: DataFrame, corpus: DataFrame, queries: DataFrame, k: int = 10, salts: int = 8) -> DataFrame:
    """The same from a stored index: postings id, term, tf, dl; corpus n, n_tokens, which add up.

    Postings of the queries' terms meet the queries by term, are summed with partial sums per task, and each
    query's best k are kept per task before the last shuffle. A term that most documents hold is spread over
    `salts` tasks.
    """
    asked = queries.select("query_id", F.posexplode(tokens("query_text")).alias("pos", "term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"), F.min("pos").alias("first"))
    post = postings.select("id", "term", "tf", "dl").join(asked.select("term").distinct(), "term", "left_semi")
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = corpus.agg(F.sum("n").alias("n"), (F.sum("n_tokens") / F.sum("n")).alias("avgdl"))
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
    terms = asked.join(df, "term").crossJoin(F.broadcast(sizes)).select("*", salt)
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = post.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).join(terms, ["term", "salt"]).groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"), F.min("first").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int | None) -> DataFrame:
    """id, cosine, rank of the k nearest. vectors: id, embedding."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("id", F.round(cosine("embedding", wanted), 6).alias("cosine")).where(F.col("cosine").isNotNull())
    return ranked(scored, k, [F.desc("cosine"), F.col("id")])


def _packed(size: int):
    """Batches of ids and vectors as rows: one for each length of vector and at most `size` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, out = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), []
            sizes = np.array([-1 if x is None else x for x in pc.list_value_length(lists).to_pylist()])
            for n in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == n)
                x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(rows), n)
                out += [(int(n), ids[rows[s : s + size]].astype("i8").tobytes(), x[s : s + size].tobytes()) for s in range(0, len(rows), size)]
            cols = list(zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["n", "ids", "x"])

    return run


def _block_topk(k: int):
    """Of each pair of a pack of vectors and a pack of queries the k best of each query, by one matrix product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, found, cosines = [], [], []
            for n, ids, x, q_ids, q in zip(*(c.to_pylist() for c in batch.columns)):
                ids, q_ids = np.frombuffer(ids, "i8"), np.frombuffer(q_ids, "i8")
                x, q = np.frombuffer(x, "f8").reshape(-1, n), np.frombuffer(q, "f8").reshape(-1, n)
                with np.errstate(invalid="ignore", divide="ignore"):
                    sims = np.round((q @ x.T) / np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)[None, :]), 6)
                for i, s in zip(q_ids, sims):
                    good = np.flatnonzero(~np.isnan(s))
                    best = good[np.lexsort((ids[good], -s[good]))[:k]]
                    queries.append(np.full(len(best), i)), found.append(ids[best]), cosines.append(s[best])
            cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((queries, "i8"), (found, "i8"), (cosines, "f8"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "id", "cosine"])

    return run


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 256) -> DataFrame:
    """query_id, id, cosine, rank. queries: query_id, query; a stated set, taken in blocks of `block` against all vectors.

    Both sides are packed, `block` vectors to a row, and every pack of vectors meets every pack of queries; the
    driver sees neither. Of each pair every query keeps its k best. The product is a matrix product, which array
    functions can't express.
    """
    schema = "n int, ids binary, x binary"
    packs = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("id").isNotNull()).mapInArrow(_packed(block), schema)
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("query").cast("array<double>").alias("v")).where(F.col("id").isNotNull()).mapInArrow(_packed(block), schema)
    # no equality, which would gather all packs of one length in one task
    both = packs.join(asked.select(F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("x").alias("q")), F.col("n") - F.col("q_n") == 0)
    found = both.select("n", "ids", "x", "q_ids", "q").mapInArrow(_block_topk(k), "query_id long, id long, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantized_topk(vectors: DataFrame, query: Sequence[float], k: int, bits: int = 4, widen: int = 4) -> DataFrame:
    """id, cosine, rank: the best widen * k by scalar codes, reranked exactly.

    Where the vectors have a column `codes` (see functions.vectors.packed), the first step reads the codes
    alone and the second the vectors of what it found; else the codes are made of the vectors.
    """
    wanted = decoded(codes(F.array(*[F.lit(float(x)) for x in query]), bits), bits)
    stored = "codes" in vectors.columns
    own = decoded(unpacked("codes", bits) if stored else codes("embedding", bits), bits)
    coded = vectors.select("id", *([] if stored else ["embedding"]), F.round(cosine(own, wanted), 6).alias("coded"))
    first = coded.where(F.col("coded").isNotNull()).orderBy(F.desc("coded"), "id").limit(widen * k)
    return vector_topk(vectors.select("id", "embedding").join(first.select("id"), "id", "left_semi") if stored else first, query, k)


def rrf(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """id, rrf, first_rank, second_rank of the union of two rankings (id, rank from 1): the sum of 1 / (k + rank)."""
    a, b = first.select("id", F.col("rank").alias("first_rank")), second.select("id", F.col("rank").alias("second_rank"))
    both = a.join(b, "id", "full_outer")
    part = F.coalesce(1.0 / (F.lit(k) + F.col("first_rank")), F.lit(0.0)) + F.coalesce(1.0 / (F.lit(k) + F.col("second_rank")), F.lit(0.0))
    return both.select("id", F.round(part, 9).alias("rrf"), "first_rank", "second_rank")


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], k: int = 8, widen: int = 3, low: float = 0.3) -> DataFrame:
    """fused of widen * k of either search."""
    return fused(vector_topk(vectors, query_vector, widen * k), bm25(docs, query, widen * k), k, low)


def fused(near: DataFrame, words: DataFrame, k: int, low: float = 0.3) -> DataFrame:
    """id, cosine, rrf, is_low, rank of a ranking by vectors and one by words; a hit of BM25 alone has cosine 0 and is low."""
    both = rrf(near, words).join(near.select("id", "cosine"), "id", "left")
    scored = both.select("id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), "rrf", (F.coalesce("cosine", F.lit(0.0)) < low).alias("is_low"), "first_rank", "second_rank")
    return ranked(scored, k, [F.desc("rrf"), F.asc_nulls_last("first_rank"), F.asc_nulls_last("second_rank")]).drop("first_rank", "second_rank")
