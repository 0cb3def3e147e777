"""Tables as Parquet folders under one manifest: a change writes what is new, and its manifest last.

A table is a list of folders: added rows, and keys of dropped ones, which hide the rows added before them.
So a change costs what it changes, whatever the size of the table; compact() folds the folders of a table
into one. The manifest names the folders of all tables, so a change of several tables is seen whole or not
at all: a run that breaks off leaves the manifest before it in force, and readers are not disturbed.

Defined results: a table before its first write is empty; keys are compared in canonical form; rows whose
key is NULL can't be dropped; two writers of one manifest number don't both succeed.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.functions.keys import key_names, keyed
from tesselite.session import forget

# fixed values: the schemas of the store
SCHEMAS = {
    "entries": "id long, entry_type string, project_id string, text string, category string, path string, symbol string, start_line int, end_line int, created_at timestamp, tags string",
    "projects": "project_id string, root_path string, git_remote string, indexed_at timestamp",
    "file_hashes": "project_id string, path string, content_hash string",
    "call_edges": "project_id string, path string, caller_symbol string, callee string, caller_start_line int, caller_end_line int, callee_line int",
    "vectors": "id long, embedding array<float>, codes binary",
    "index_metadata": "key string, value string",
    # the inverted index of code: one row for each term of an entry, and counts of each change that add up
    "postings": "id long, project_key string, term string, tf int, dl int, bucket int",
    "corpus": "project_key string, n long, n_tokens long",
    "logs": "at timestamp, level string, category string, message string",
}
KEYS = {"entries": ["id"], "vectors": ["id"], "postings": ["id"], "projects": ["project_id"], "file_hashes": ["project_id", "path"], "call_edges": ["project_id", "path"], "index_metadata": ["key"]}
#: Folders of these tables are parted by a column, so a reader opens only the parts it asks for.
PARTED = {"postings": "bucket"}
MANIFEST = "seq int, name string, op string, folder string, top_id long"


def columns_of(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


class Change:
    """What a `with store.change()` block adds to and drops from tables; it holds once the block has ended without an error."""

    def __init__(self, store: Store):
        self.store, self.version = store, store.version()
        self.rows, self.top = store.manifest(), store.next_id() - 1
        self.written: list[str] = []

    def _put(self, name: str, op: str, df: DataFrame) -> None:
        folder = f"{name}/{op}-{uuid.uuid4().hex}"
        self.written.append(folder)
        writer = df.write
        if op == "add" and name in PARTED:
            writer = writer.partitionBy(PARTED[name])
        writer.parquet(f"{self.store.path}/{folder}")
        self.rows.append((max([0, *(r[0] for r in self.rows)]) + 1, name, op, folder))

    def add(self, name: str, df: DataFrame) -> None:
        self._put(name, "add", df.select(*columns_of(name)))

    def drop(self, name: str, keys: DataFrame) -> None:
        """Hide the rows of the table that have one of these keys (its KEYS as columns)."""
        self._put(name, "drop", keyed(keys, *KEYS[name]).select(*key_names(*KEYS[name])).na.drop().distinct())

    def replace(self, name: str, df: DataFrame) -> None:
        """The rows become the whole table; `df` may read its current state."""
        old = [r for r in self.rows if r[1] == name]
        self.add(name, df)
        self.rows = [r for r in self.rows if r not in old]

    def upsert(self, name: str, df: DataFrame) -> None:
        self.drop(name, df)
        self.add(name, df)

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.store._commit(self.version + 1, self.rows, self.top)
        else:
            for folder in self.written:
                forget(self.store.spark, f"{self.store.path}/{folder}")


class Store:
    """The tables of a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(1, keep)

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/manifest/{n}/_SUCCESS")[1]))

    def version(self) -> int:
        """The manifest that holds, 0 before the first change."""
        return max([0, *self._versions()])

    def _rows(self, version: int) -> list[tuple]:
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{version}").collect()] if version else []

    def manifest(self) -> list[tuple]:
        """seq, name, op, folder in order; as many rows as changes since the last compaction."""
        return sorted(r[:4] for r in self._rows(self.version()) if r[2] != "top")

    def next_id(self) -> int:
        """One more than the greatest entry id; the manifest holds it."""
        return max([0, *(r[4] for r in self._rows(self.version()) if r[2] == "top")]) + 1

    def _commit(self, version: int, rows: list[tuple], top: int) -> None:
        table = self.spark.createDataFrame([(*r, None) for r in rows] + [(0, "", "top", "", top)], MANIFEST)
        target, (fs, at) = f"{self.path}/manifest/v{version}", self._fs(f"{self.path}/manifest/v{version}")
        if fs.exists(at) and not fs.exists(self._fs(f"{target}/_SUCCESS")[1]):
            fs.delete(at, True)  # what a run left that broke off
        table.coalesce(1).write.parquet(target)
        versions = self._versions()
        held = {r[3] for v in versions[-self.keep :] for r in self._rows(v)}
        for v in versions[: -self.keep]:
            for folder in {r[3] for r in self._rows(v)} - held - {""}:
                fs.delete(self._fs(f"{self.path}/{folder}")[1], True)
            fs.delete(self._fs(f"{self.path}/manifest/v{v}")[1], True)

    def change(self) -> Change:
        return Change(self)

    def read(self, name: str) -> DataFrame:
        """A table: its added rows without those that were dropped after."""
        rows = [r for r in self.manifest() if r[1] == name]
        drops = [(seq, folder) for seq, _, op, folder in rows if op == "drop"]
        adds = [(seq, folder) for seq, _, op, folder in rows if op == "add"]
        if not adds:
            return self.spark.createDataFrame([], SCHEMAS[name])
        last_drop = max([0, *(seq for seq, _ in drops)])

        def load(folders: list[str]) -> DataFrame:
            reader = self.spark.read.schema(SCHEMAS[name])
            if name in PARTED:  # folders that are parted are read one by one
                return reduce(DataFrame.unionByName, [reader.parquet(f"{self.path}/{f}") for f in folders])
            return reader.parquet(*[f"{self.path}/{f}" for f in folders])

        newer = [folder for seq, folder in adds if seq > last_drop]
        older = [(seq, folder) for seq, folder in adds if seq < last_drop]
        parts = [load(newer)] if newer else []
        if older:
            names = KEYS[name]
            hidden = reduce(DataFrame.unionByName, [self._keys(folder, name).withColumn("_at", F.lit(seq)) for seq, folder in drops])
            hidden = hidden.groupBy(*key_names(*names)).agg(F.max("_at").alias("_at"))
            old = reduce(DataFrame.unionByName, [load([folder]).withColumn("_seq", F.lit(seq)) for seq, folder in older])
            kept = keyed(old, *names).join(hidden, key_names(*names), "left").where(F.col("_at").isNull() | (F.col("_at") < F.col("_seq")))
            parts.append(kept.select(*columns_of(name)))
        return reduce(DataFrame.unionByName, parts)

    def _keys(self, folder: str, name: str) -> DataFrame:
        kinds = dict(c.split()[:2] for c in SCHEMAS[name].split(", "))
        return self.spark.read.schema(", ".join(f"_k_{k} {kinds[k]}" for k in KEYS[name])).parquet(f"{self.path}/{folder}")

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table in a change of its own."""
        with self.change() as c:
            c.replace(name, df)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows in a change of its own; only they are written."""
        with self.change() as c:
            c.add(name, df)

    def compact(self, *names: str) -> None:
        """Fold the folders of tables (of all, without names) into one each."""
        with self.change() as c:
            for name in names or SCHEMAS:
                if sum(r[1] == name for r in c.rows) > 1:
                    df = self.read(name)
                    if name == "corpus":  # counts add up
                        df = df.groupBy("project_key").agg(F.sum("n").alias("n"), F.sum("n_tokens").alias("n_tokens"))
                    c.replace(name, df)
