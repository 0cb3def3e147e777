"""Inverted indexes: of a store's code, which grow and shrink with it, and of tables in files.

The index of a table is named by the paths, lengths and times of the files it was built from: files that
change have another name, and so another index. It is stored in the shared folder and goes when the driver
ends.

Defined results: entries without a text count as documents without tokens; an entry that is added twice
counts twice until it is removed; an empty index has no hits.
"""

from __future__ import annotations

import atexit
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.operators import ranking
from tesselite.session import forget, shared_dir
from tesselite.sources.store import SCHEMAS, Change, Store


class Words:
    """The corpus of a store. Entries are id, project_id, symbol, text; without a change of the caller each call is one."""

    def __init__(self, store: Store):
        self.store = store

    def add(self, entries: DataFrame, change: Change | None = None) -> None:
        """Add one or many entries; only their terms are written."""
        if change is None:
            with self.store.change() as change:
                return self.add(entries, change)
        change.add("postings", ranking.indexed(entries))
        change.add("corpus", ranking.corpus_counts(entries))

    def remove(self, entries: DataFrame, change: Change | None = None) -> None:
        """Take entries back as they were added."""
        if change is None:
            with self.store.change() as change:
                return self.remove(entries, change)
        change.drop("postings", entries.select("id"))
        gone = ranking.corpus_counts(entries)
        change.add("corpus", gone.select("project_key", (-F.col("n")).alias("n"), (-F.col("n_tokens")).alias("n_tokens")))

    def clear(self) -> None:
        with self.store.change() as change:
            for name in ("postings", "corpus"):
                change.replace(name, self.store.spark.createDataFrame([], SCHEMAS[name]))

    def n_docs(self) -> int:
        return self.store.read("corpus").agg(F.sum("n")).first()[0] or 0

    def search(self, query: str, k: int | None = None, project: str | None = None) -> DataFrame:
        """id, score, rank; project: a canonical id whose entries are the corpus."""
        return ranking.bm25_stored(self.store.read("postings"), self.store.read("corpus"), query, k, project)


def _state(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in (fs.listStatus(at) if fs.exists(at) else [])]


def word_index(spark: SparkSession, name: str, path: str, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings, corpus of the entries (id, project_id, symbol, text), which are made of the files at `path`; built where they aren't stored."""
    digest = hashlib.sha256("\n".join([name, *sorted(_state(spark, path))]).encode()).hexdigest()[:24]
    folder = f"{shared_dir(spark)}/tesselite/words-{digest}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/corpus/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        ranking.indexed(entries).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        ranking.corpus_counts(entries).write.mode("overwrite").parquet(f"{folder}/corpus")  # last: its mark tells that all is there
        atexit.register(forget, spark, folder)
    return tuple(spark.read.schema(SCHEMAS[t]).parquet(f"{folder}/{t}") for t in ("postings", "corpus"))
