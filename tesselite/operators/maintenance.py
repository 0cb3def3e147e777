"""Incremental indexing and the removal of what no longer exists: joins of a scan with the stored state.

Defined results: projects and paths are compared in canonical form, and come out as the scan spells them
(files that are gone: as the state does); rows without project or path are no files; a repeated row of the
stored state or the scan counts once; of several sightings of a file the newest holds (see `latest`); a
NULL hash of a scan is an unreadable file, which is skipped and leaves the state as it is; empty tables are
fine on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselite.functions.keys import key_names, keyed, project_key_of
from tesselite.operators.changes import newest

FILE = ["project_id", "path"]
KEYS = key_names(*FILE)
# fixed values: the texts of the report
COUNTED = {
    "stale_entries": "%d stale Code Entries",
    "orphan_hashes": "%d orphaned file hashes",
    "stale_edges": "%d stale call graph edges",
    "absent_projects": "%d absent project(s) removed",
}
NOTHING_STALE = "Index health check complete: no stale entries found."
REMOVED = "Index health check complete. Removed "


def _files(df: DataFrame) -> DataFrame:
    return keyed(df, *FILE).na.drop(subset=KEYS)


def latest(scans: DataFrame) -> DataFrame:
    """project_id, path, content_hash of each file's newest sighting by seen_at, then scan_id; a NULL hash holds too."""
    return newest(_files(scans), KEYS, ["seen_at", "scan_id"], [*FILE, "content_hash"]).select(*FILE, "content_hash")


def diff(scan: DataFrame, state: DataFrame) -> DataFrame:
    """project_id, path, change: `added`, `changed`, `unchanged`, `unreadable` for scanned files, `gone` for others of the state.

    scan, state: project_id, path, content_hash. One full outer join on the file. A log of sightings
    goes through `latest` first.
    """
    row = F.max(F.struct(F.lower("content_hash").alias("hash"), *FILE))
    new, old = _files(scan).groupBy(*KEYS).agg(row.alias("new")), _files(state).groupBy(*KEYS).agg(row.alias("old"))
    change = (
        F.when(F.col("new").isNull(), "gone")
        .when(F.col("new.hash").isNull(), "unreadable")
        .when(F.col("old").isNull(), "added")
        .when(F.col("new.hash") == F.col("old.hash"), "unchanged")
        .otherwise("changed")
    )
    names = [F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in FILE]
    return new.join(old, KEYS, "full_outer").select(*names, change.alias("change"), F.col("new.hash").alias("new_hash"))


def counters(changes: DataFrame) -> DataFrame:
    """change, n_files."""
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n_files"))


def replaced(rows: DataFrame, new_rows: DataFrame, changes: DataFrame, force: bool = False) -> DataFrame:
    """Rows of a table after an index run: those of changed files (or, by force, of every readable scanned one) are replaced."""
    redo = ["added", "changed", "unchanged"] if force else ["added", "changed"]
    files = keyed(changes.where(F.col("change").isin(*redo)), *FILE).select(*KEYS)
    return without(rows, files, FILE).unionByName(within(new_rows, files, FILE))


def without(rows: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """The rows whose key isn't among `gone` (columns of key_names)."""
    return keyed(rows, *names).join(gone, key_names(*names), "left_anti").select(*rows.columns)


def within(rows: DataFrame, there: DataFrame, names: list[str]) -> DataFrame:
    """The rows whose key is among `there` (columns of key_names)."""
    return keyed(rows, *names).join(there, key_names(*names), "left_semi").select(*rows.columns)


def upserted(rows: DataFrame, new_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key."""
    return without(rows, keyed(new_rows, *keys).select(*key_names(*keys)).distinct(), keys).unionByName(new_rows)


def next_hashes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored hashes after an index run."""
    new = changes.where(F.col("change").isin("added", "changed")).select(*FILE, F.col("new_hash").alias("content_hash"))
    return upserted(state.select(*FILE, "content_hash"), new, FILE)


def health(entries: DataFrame, hashes: DataFrame, edges: DataFrame, projects: DataFrame, live_files: DataFrame, live_projects: DataFrame, project_id: str | None = None) -> dict[str, DataFrame]:
    """The tables without what has gone, and `report` with four counters in one row.

    live_files: project_id, path of existing files; live_projects: project_id of existing roots. Of an
    absent project everything goes, facts too; of a present one the code entries and hashes of files
    that are gone, and the edges of the paths that lost an entry. project_id: look at that project only.
    """
    project, file = ["project_id"], FILE
    known = keyed(projects, *project).select(*key_names(*project)).na.drop().distinct()
    if project_id is not None:
        known = known.where(F.col(key_names(*project)[0]) == project_key_of(project_id))
    roots = keyed(live_projects, *project).select(*key_names(*project)).distinct()
    absent, present = known.join(roots, key_names(*project), "left_anti"), known.join(roots, key_names(*project), "left_semi")
    files = keyed(live_files, *file).select(*KEYS).distinct()
    code = within(entries.where((F.col("entry_type") == "code") & F.col("path").isNotNull()), present, project)
    stale = without(code, files, file).select("id", *FILE).distinct()
    stale_paths = keyed(stale, *file).select(*KEYS).distinct()
    orphan_hashes = without(within(hashes, present, project), files, file)
    stale_edges = within(edges, stale_paths, file)
    counts = [stale.agg(F.countDistinct("id").alias("stale_entries")), orphan_hashes.agg(F.count(F.lit(1)).alias("orphan_hashes")), stale_edges.agg(F.count(F.lit(1)).alias("stale_edges")), absent.agg(F.count(F.lit(1)).alias("absent_projects"))]
    report = counts[0]
    for c in counts[1:]:
        report = report.crossJoin(c)  # single rows

    def left(table: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
        return without(without(table, absent, project), gone, on)

    return {
        "entries": left(entries, keyed(stale, "id").select("_k_id").distinct(), ["id"]),
        "file_hashes": left(hashes, keyed(orphan_hashes, *file).select(*KEYS).distinct(), FILE),
        "call_edges": left(edges, stale_paths, FILE),
        "projects": without(projects, absent, project),
        "report": report,
    }


def report_text(report: DataFrame) -> DataFrame:
    """The counters as one sentence."""
    said = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.format_string(form, c)) for c, form in COUNTED.items()])
    return report.select(F.when(said == "", NOTHING_STALE).otherwise(F.concat(F.lit(REMOVED), said, F.lit("."))).alias("message"))
