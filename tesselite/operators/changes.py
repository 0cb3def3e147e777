"""Processing only new or changed records.

A run rereads from the oldest transaction that was open when the last successful run began (rows that
became visible late carry a later arrival but may belong before it), and drops by an anti-join of
key and version what the ledger of processed versions already holds. Nothing is skipped, since the
reread covers every transaction that the last run could not see; nothing is repeated, since the
ledger removes the overlap. The ledger is written after a run has succeeded, so a run that breaks
off leaves it unchanged and its records come again. A record that arrives late and is older than one
processed before it is not processed, and does not hide the newer one.

Defined results: keys are compared in canonical form, versions without letter case; rows delivered
twice count once; a newest observation without a version (unreadable) is not processed; an empty
ledger makes everything new; empty observations give no rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselite.functions.keys import path_key, project_key


def newest(observed: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order`; one aggregation, whose partial step leaves a row per key and task."""
    ordering = F.struct(*[F.col(c) for c in order])
    row = F.max_by(F.struct(*[F.col(c) for c in keep]), ordering)
    return observed.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def latest_indexed(projects: DataFrame) -> DataFrame:
    """project_key, indexed_at: the newest non-NULL time of each project, of any spelling."""
    return projects.where(F.col("project_id").isNotNull()).groupBy(project_key("project_id").alias("project_key")).agg(F.max("indexed_at").alias("indexed_at"))


def oldest_open(transactions: DataFrame, last_success: dt.datetime | None) -> dt.datetime | None:
    """From when to reread: the earliest begin of a transaction not committed when the last run began, else that run's begin.

    transactions: began_at TIMESTAMP, ended_at TIMESTAMP (NULL: still open). None: no run has succeeded, so from the start.
    """
    if last_success is None:
        return None
    open_then = transactions.where((F.col("began_at") <= F.lit(last_success)) & (F.col("ended_at").isNull() | (F.col("ended_at") > F.lit(last_success))))
    first = open_then.agg(F.min("began_at")).first()[0]
    return min(first, last_success) if first is not None else last_success


def reread_points(transactions: DataFrame, last_runs: DataFrame) -> DataFrame:
    """project_key, reread_from: oldest_open of every project at once.

    transactions: project_id, began_at, ended_at (NULL: still open). last_runs: project_key, last_success; a
    project without one has no point and is read from the start.
    """
    runs = last_runs.where(F.col("last_success").isNotNull()).select("project_key", "last_success")
    begun = transactions.select(project_key("project_id").alias("project_key"), "began_at", "ended_at")
    open_then = begun.join(runs, "project_key").where((F.col("began_at") <= F.col("last_success")) & (F.col("ended_at").isNull() | (F.col("ended_at") > F.col("last_success"))))
    first = open_then.groupBy("project_key").agg(F.min("began_at").alias("first"))
    return runs.join(first, "project_key", "left").select("project_key", F.least("last_success", "first").alias("reread_from"))


def unprocessed(scans: DataFrame, ledger: DataFrame, projects: DataFrame | None = None, reread_from: dt.datetime | DataFrame | None = None, arrived: DataFrame | None = None) -> DataFrame:
    """project_id, path, content_hash of each file to process, once each; and seen_at, scan_id where the ledger has them.

    scans: project_id, path, content_hash, seen_at, scan_id, arrived_at; the newest by seen_at, then
    scan_id, holds. ledger: project_id, path, content_hash processed with success. projects: where
    given, ledger rows of a project that was never indexed with success do not count. reread_from: only
    files with an arrival at or after it are looked at (see oldest_open), one time or one for each project
    (see reread_points); None reads all. arrived: these arrivals themselves, as a stream brings them.

    What arrived late may be older than what was processed before. So the newest scan of a file is sought
    among all its scans, not just those that arrived since; or, where the ledger carries seen_at and
    scan_id, among the arrivals, and one that isn't newer than the processed scan is dropped.
    """
    keys, order = ["_p", "_f"], ["seen_at", "scan_id"]
    dated = set(order) <= set(ledger.columns)

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_p": project_key("project_id"), "_f": path_key("path")}).where(F.col("_p").isNotNull() & F.col("_f").isNotNull())

    rows = keyed(scans)
    if reread_from is not None:
        if isinstance(reread_from, DataFrame):
            points = reread_from.select(F.col("project_key").alias("_p"), "reread_from")
            late = rows.join(points, "_p", "left").where(F.col("reread_from").isNull() | (F.col("arrived_at") >= F.col("reread_from"))).drop("reread_from")
        else:
            late = rows.where(F.col("arrived_at") >= F.lit(reread_from))
    elif arrived is not None:
        late = keyed(arrived)
    else:
        late = None
    if late is not None:
        rows = late if dated else rows.join(late.select(*keys).distinct(), keys, "left_semi")
    seen = newest(rows.select(*keys, "project_id", "path", "content_hash", *order), keys, order, ["project_id", "path", "content_hash", *order])
    seen = seen.where(F.col("content_hash").isNotNull()).withColumn("_v", F.lower("content_hash"))
    done = keyed(ledger).withColumn("_v", F.lower("content_hash"))
    if projects is not None:
        indexed = latest_indexed(projects).where(F.col("indexed_at").isNotNull()).select(F.col("project_key").alias("_p"))
        done = done.join(indexed, "_p", "left_semi")
    out = seen.join(done.select(*keys, "_v").distinct(), [*keys, "_v"], "left_anti")
    if dated:
        last = done.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
        out = out.join(last, keys, "left").where(F.col("_last").isNull() | (F.struct(*order) > F.col("_last")))
    return out.select("project_id", "path", "content_hash", *(order if dated else []))


def committed(ledger: DataFrame, processed: DataFrame) -> DataFrame:
    """The ledger after a successful run: the processed versions replace those of the same file. A ledger with seen_at and scan_id keeps them."""
    cols = [c for c in ("project_id", "path", "content_hash", "seen_at", "scan_id") if c in ledger.columns]
    new = processed.select(*cols, project_key("project_id").alias("_p"), path_key("path").alias("_f"))
    kept = ledger.select(*cols, project_key("project_id").alias("_p"), path_key("path").alias("_f")).join(new.select("_p", "_f").distinct(), ["_p", "_f"], "left_anti")
    return kept.select(*cols).unionByName(new.select(*cols)).distinct()
