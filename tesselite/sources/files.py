"""Source files of a checkout as a table: path, n_bytes, text, content_hash."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.operators.source_code import DENIED_PARTS, MAX_BYTES, in_scope
from tesselite.session import materialize

IGNORE_FILES = (".gitignore", ".tesseliteignore")


def tracked(root: str) -> list[str] | None:
    """Paths that git tracks below a root, or None where there is no repository; asked on the driver."""
    # a worktree's `.git` file counts at the root itself, further up only a directory does
    if not ((Path(root) / ".git").exists() or any((p / ".git").is_dir() for p in Path(root).parents)):
        return None
    try:
        said = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, text=True, timeout=10, check=True)
    except (subprocess.SubprocessError, OSError):
        return None
    return [p for p in said.stdout.split("\0") if p] or None


def ignore_lines(root: str) -> list[str]:
    """Lines of the root's ignore files."""
    lines: list[str] = []
    for name in IGNORE_FILES:
        path = Path(root) / name
        if path.is_file():
            lines += path.read_text(encoding="utf-8", errors="ignore").splitlines()
    return lines


def _content(root: str):
    """The bytes of files below a root that all executors see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n_bytes, language in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    content = (Path(root) / path).read_bytes()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n_bytes], pa.int64()), pa.array([language]), pa.array([content], pa.binary())], names=["path", "n_bytes", "language", "content"])

    return run


def _below(root: str, prune: frozenset[str]) -> Iterator[tuple[str, int]]:
    """Path and size of the files below a root, without what lies in pruned directories."""
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n not in prune]
        for name in files:
            full = os.path.join(folder, name)
            try:
                yield os.path.relpath(full, root).replace(os.sep, "/"), os.path.getsize(full)
            except OSError:
                continue


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files in scope. Where git tracks a root its list counts, else the ignore files do.

    Files are listed first, without denied directories, then filtered by path and size, and only those in
    scope are read. A file that is not valid UTF-8 has NULL text and hash.
    """
    root = os.path.abspath(os.path.expanduser(root))
    listed = tracked(root)
    wanted = None if listed is None else set(listed)
    files = [(p, n) for p, n in _below(root, frozenset(DENIED_PARTS)) if wanted is None or p in wanted]
    rows = in_scope(spark.createDataFrame(files, "path string, n_bytes long"), () if listed is not None else ignore_lines(root), max_bytes)
    read = rows.select("path", "n_bytes", "language").repartition(spark.sparkContext.defaultParallelism).mapInArrow(_content(root), "path string, n_bytes long, language string, content binary")
    whole = F.col("content").cast("string")
    text = F.regexp_replace(F.when(F.is_valid_utf8(whole), whole), "\r\n?", "\n")
    return read.select("path", "language", "n_bytes", text.alias("text")).withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))


source_files = scan  # another name of the same


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for project, root in zip(*(c.to_pylist() for c in batch.columns)):
            if root and os.path.isdir(root):
                # a row without a path tells that the root is there
                paths = [None, *(p for p, _ in _below(root, frozenset()))]
                yield pa.RecordBatch.from_arrays([pa.array([project] * len(paths), pa.string()), pa.array(paths, pa.string())], names=["project_id", "path"])


def live(spark: SparkSession, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files (project_id, path) and projects (project_id) that exist, for a health check: roots are listed in tasks, files aren't read."""
    roots = projects.select("project_id", "root_path").distinct().repartition(spark.sparkContext.defaultParallelism)
    found = materialize(roots.mapInArrow(_live, "project_id string, path string"), "live")
    return found.where(F.col("path").isNotNull()), found.where(F.col("path").isNull()).select("project_id")
