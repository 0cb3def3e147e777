"""Filters on entries, listings, catalog, status and the text of hits.

Defined results: an absent filter passes every row; a NULL category is never excluded; a limit of None
or 0 is the default, a negative one is an error; project rows of one id count by their newest time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselite.functions import tags as tag_codec
from tesselite.functions.keys import project_key, project_key_of
from tesselite.operators.ordering import range_ranked

DEFAULT_LIMIT = 8


def limit_of(limit: int | None, default: int = DEFAULT_LIMIT) -> int:
    if limit is not None and limit < 0:
        raise ValueError("a limit can't be negative")
    return limit or default


def distinct_entries(entries: DataFrame) -> DataFrame:
    """Rows delivered twice once."""
    return entries.dropDuplicates(["id"])


def selected(
    entries: DataFrame,
    *,
    project_id: str | None = None,
    types: Sequence[str] | None = None,
    category: str | None = None,
    exclude_categories: Sequence[str] | None = None,
    tags: Sequence[str] | None = None,
) -> DataFrame:
    """The entries that pass every given filter; conditions are added only where given, so they reach the scan. Projects are compared in canonical form."""
    if project_id:
        entries = entries.where(project_key("project_id") == project_key_of(project_id))
    if types:
        entries = entries.where(F.col("entry_type").isin(*types))
    if category:
        entries = entries.where(F.col("category") == category)
    if exclude_categories:
        entries = entries.where(F.col("category").isNull() | ~F.col("category").isin(*exclude_categories))
    if tags:
        entries = entries.where(tag_codec.overlap("tags", tags))
    return entries


def list_experiences(entries: DataFrame, limit: int | None = 20, category: str | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """id, category, text (200 characters), created_at, line: the newest facts."""
    rows = selected(entries, types=["experience"], category=category, tags=tags)
    newest = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit_of(limit, 20))
    short = F.substring("text", 1, 200)
    return newest.select("id", "category", short.alias("text"), "created_at", F.format_string("- #%d [%s] %s", "id", F.coalesce("category", F.lit("general")), short).alias("line"))


def when(c: Column) -> Column:
    """Minutes, or `never`."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("never"))


def project_catalog(projects: DataFrame) -> DataFrame:
    """project_id, root_path, indexed_at, indexed, position: each project's newest row, the latest first."""
    rows = projects.groupBy("project_id").agg(F.max("indexed_at").alias("indexed_at"), F.max_by("root_path", F.struct(F.col("indexed_at").isNotNull(), "indexed_at", "root_path")).alias("root_path"))
    named = rows.select("project_id", "root_path", "indexed_at", when(F.col("indexed_at")).alias("indexed"))
    return range_ranked(named, [F.desc_nulls_last("indexed_at"), F.col("project_id")], rank="position")


def is_indexed(projects: DataFrame, project_id: str) -> bool:
    return not projects.where((project_key("project_id") == project_key_of(project_id)) & F.col("indexed_at").isNotNull()).isEmpty()


def index_status(entries: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id (NULL: the whole store), code_entries, experiences, last_indexed; counts and the total come from one rollup."""
    counts = entries.withColumn("project_id", F.coalesce("project_id", F.lit("(none)"))).rollup("project_id").agg(F.count_if(F.col("entry_type") == "code").alias("code_entries"), F.count_if(F.col("entry_type") == "experience").alias("experiences"))
    times = projects.rollup("project_id").agg(F.max("indexed_at").alias("last_indexed"))
    on = counts["project_id"].eqNullSafe(times["project_id"])
    return counts.join(times, on, "left").select(counts["project_id"], "code_entries", "experiences", when(F.col("last_indexed")).alias("last_indexed"))


def hit_text(score: Column | str, is_low: Column | str, peek: bool = False) -> Column:
    """The text of a hit: head with project or category and score, place, body. Peeks have no body."""
    score = F.col(score) if isinstance(score, str) else score
    is_low = F.col(is_low) if isinstance(is_low, str) else is_low
    value = F.format_string("%.3f", F.round(score, 3))
    flag = F.when(is_low, F.lit(" [LOW-CONFIDENCE]")).otherwise("")
    place = F.concat(F.coalesce(F.nullif(F.col("symbol"), F.lit("")), F.lit("(file)")), F.lit(" @ "), F.coalesce("path", F.lit("None")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("None")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("None")))
    code = F.concat(F.lit("[code | "), F.coalesce(F.nullif(F.col("project_id"), F.lit("")), F.lit("unknown")), F.lit(" | score "), value, flag, F.lit("]\n"), place)
    project = F.when(F.coalesce("project_id", F.lit("")) != "", F.concat(F.lit(" | "), "project_id")).otherwise("")
    fact = F.concat(F.lit("[experience | "), F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("general")), project, F.lit(" | score "), value, flag, F.lit("]\n"))
    if peek:
        return F.when(F.col("entry_type") == "code", code).otherwise(F.concat(fact, F.lit("(peek)")))
    return F.when(F.col("entry_type") == "code", F.concat(code, F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 400))).otherwise(F.concat(fact, F.coalesce("text", F.lit(""))))


def rendered(hits: DataFrame, entries: DataFrame, peek: bool = False) -> DataFrame:
    """id, rank, hit: the ranked hits (id, cosine, is_low, rank) as text; a hit without its entry is dropped."""
    return hits.join(entries, "id").select("id", "rank", hit_text("cosine", "is_low", peek).alias("hit"))
