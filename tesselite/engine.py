"""The engine over a store: remember, recall, index, look up, check. Every method returns a DataFrame.

`tool` gives the same as text by a tool's name, as an agent would call it.
"""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselite.config import Config
from tesselite.functions import tags as tag_codec
from tesselite.functions.keys import key_names, keyed, project_key, project_key_of
from tesselite.functions.text import document_text
from tesselite.functions.vectors import codes, hash_embed, hash_embedding, packed
from tesselite.operators import conversation, identity, maintenance, ranking, recall, source_code
from tesselite.operators.ordering import range_ranked
from tesselite.session import materialize
from tesselite.sources import files
from tesselite.sources.store import KEYS, SCHEMAS, Change, Store
from tesselite.sources.words import Words
from tesselite.tools import TOOL_NAMES

NO_HIT = " Try index_status to check the index, index_health_check to clean stale entries, or index_codebase to rebuild it."


class Engine:
    """embed_text, embed_column: an embedder for one query text and for a text column; the default hashes.

    chunks, call_edges: what cuts files and finds calls; by lines, or by trees with those of operators.syntax.
    """

    def __init__(
        self, spark: SparkSession, config: Config | None = None, path: str | None = None, embed_text: Callable[[str], list[float]] = hash_embed, embed_column=hash_embedding,
        chunks=source_code.chunks, call_edges=source_code.call_edges,
    ):
        self.chunks, self.call_edges = chunks, call_edges
        self.spark, self.config = spark, config or Config()
        self.store = Store(spark, path or self.config.data_dir)
        self.words = Words(self.store)
        self.embed_text, self.embed_column, self.loaded = embed_text, embed_column, False

    # --- facts

    def remember(self, rows: DataFrame) -> DataFrame:
        """Add facts (text, category, tags as arrays; project_id may be there) and their vectors; returns the new entries."""
        have = set(rows.columns)
        base = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(
            F.trim("text").alias("text"),
            (F.col("category") if "category" in have else F.lit("general")).alias("category"),
            (F.col("project_id") if "project_id" in have else F.lit(None).cast("string")).alias("project_id"),
            (tag_codec.encode("tags") if "tags" in have else F.lit(None).cast("string")).alias("tags"),
        )
        now = self._now()
        added = self._numbered(base, "text").withColumns({"entry_type": F.lit("experience"), "path": F.lit(None).cast("string"), "symbol": F.lit(None).cast("string"), "start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int"), "created_at": F.lit(now)})
        added = materialize(added, "facts")
        with self.store.change() as change:
            self._add(change, added, F.col("text"))
        return added

    def _numbered(self, rows: DataFrame, *order: str) -> DataFrame:
        """With ids after the greatest one, in order."""
        ranked = range_ranked(rows, [F.col(c) for c in order], rank="_n")
        return ranked.withColumn("id", (F.lit(self.store.next_id() - 1) + F.col("_n")).cast("long")).drop("_n")

    def _add(self, change: Change, entries: DataFrame, source: Column) -> None:
        """The entries with their vectors and codes; code goes into the inverted index too."""
        change.add("entries", entries)
        vectors = entries.select("id", self.embed_column(source).cast("array<float>").alias("embedding"))
        change.add("vectors", vectors.withColumn("codes", packed(codes("embedding", self.config.bit_width), self.config.bit_width)))
        self.words.add(entries.where(F.col("entry_type") == "code"), change)
        change.top = max(change.top, entries.agg(F.max("id")).first()[0] or 0)

    def _remove(self, change: Change, entries: DataFrame) -> None:
        """Entries of the store leave every table that has their ids; what they added to the corpus is taken back."""
        for name in ("entries", "vectors"):
            change.drop(name, entries.select("id"))
        self.words.remove(entries.where(F.col("entry_type") == "code"), change)

    def _log(self, change: Change, category: str, message: str, level: str = "INFO") -> None:
        change.add("logs", self.spark.createDataFrame([(self._now(), level, category, message)], SCHEMAS["logs"]))

    @staticmethod
    def _now() -> dt.datetime:
        return dt.datetime.now(dt.UTC).replace(tzinfo=None)

    @staticmethod
    def _project(project_id: str | None, project_path: str | None) -> str | None:
        return project_id or (identity.resolve(project_path)[0] if project_path else None)

    def recall(self, query: str, limit: int | None = None, **filters) -> DataFrame:
        """id, rank, hit of the nearest entries of either kind that pass the filters; a blank query has none."""
        k = recall.limit_of(limit, self.config.default_limit)
        if not query.strip():
            return self._no_hits()
        entries = recall.selected(self.store.read("entries"), **filters)
        vectors = self.store.read("vectors").select("id", "embedding").join(entries.select("id"), "id", "left_semi")
        hits = ranking.vector_topk(vectors, self.embed_text(query.strip()), k).withColumn("is_low", F.lit(False))
        return recall.rendered(hits, entries)

    def list_experiences(self, limit: int | None = 20, category: str | None = None, tags: Sequence[str] | None = None) -> DataFrame:
        return recall.list_experiences(self.store.read("entries"), limit, category, tags)

    # --- code

    def index_codebase(self, root: str, force: bool = False) -> DataFrame:
        """Index a checkout: only files whose content changed are chunked again. project_id, root_path, added, skipped, removed.

        added, removed: chunks; skipped: files that are unchanged or can't be read. All tables change together or not at all.
        """
        project, top, remote = identity.resolve(root)
        if not os.path.isdir(top):
            raise ValueError(f"no such directory: {top}")
        scanned = materialize(files.scan(self.spark, top).withColumn("project_id", F.lit(project)), "scan")
        state = recall.selected(self.store.read("file_hashes"), project_id=project)
        changes = materialize(maintenance.diff(scanned, state).where(F.col("change") != "gone"), "changes")
        redo = ["added", "changed", "unchanged"] if force else ["added", "changed"]
        todo = scanned.join(changes.where(F.col("change").isin(*redo)).select("project_id", "path"), ["project_id", "path"], "left_semi")
        keys = keyed(todo, *maintenance.FILE).select(*maintenance.KEYS).distinct()
        chunks = self.chunks(todo.select("project_id", "path", "text"), "project_id", "path").drop("content_hash")
        code = recall.selected(self.store.read("entries"), types=["code"], project_id=project)
        replaced = materialize(maintenance.within(code, keys, maintenance.FILE), "replaced")
        now = self._now()
        added = self._numbered(chunks, "path", "start_line").withColumns({"entry_type": F.lit("code"), "category": F.lit(None).cast("string"), "tags": F.lit(None).cast("string"), "created_at": F.lit(now)})
        added = materialize(added, "chunks")
        n_files, n_todo = changes.count(), todo.count()
        counts = [(project, top, added.count(), n_files - n_todo, replaced.count())]
        with self.store.change() as change:
            self._remove(change, replaced)
            self._add(change, added, document_text("symbol", "text", "\n"))
            change.drop("call_edges", todo.select(*maintenance.FILE))
            change.add("call_edges", self.call_edges(todo.select("project_id", "path", "text"), "project_id", "path"))
            change.upsert("file_hashes", todo.select("project_id", "path", "content_hash"))
            row = self.spark.createDataFrame([(project, top, remote, now)], SCHEMAS["projects"])
            others = maintenance.without(self.store.read("projects"), keyed(row, "project_id").select("_k_project_id"), ["project_id"]).isEmpty()
            change.upsert("projects", row)
            # the settings hold for the whole store: they change only once nothing in it was made with others
            if self.store.read("index_metadata").isEmpty() or (force and others and recall.selected(self.store.read("entries"), types=["experience"]).isEmpty()):
                change.replace("index_metadata", self.spark.createDataFrame(self._settings(), SCHEMAS["index_metadata"]))
            self._log(change, "index", f"{project}: {counts[0][2]} added, {counts[0][3]} skipped, {counts[0][4]} removed")
        return self.spark.createDataFrame(counts, "project_id string, root_path string, added long, skipped long, removed long")

    def _settings(self) -> list[tuple[str, str]]:
        """What an index is made with: a store holds vectors of one model, one length and one width of codes."""
        return [("embedding_model", self.config.embedding_model), ("dimension", str(len(self.embed_text("dimension")))), ("bit_width", str(self.config.bit_width))]

    def config_mismatch(self) -> DataFrame:
        """key, value, configured of settings that differ from those the index was built with."""
        own = self.spark.createDataFrame(self._settings(), "key string, configured string")
        return self.store.read("index_metadata").join(own, "key").where(F.col("value") != F.col("configured"))

    def code_recall(self, query: str, limit: int | None = None, project_id: str | None = None, peek: bool = False) -> DataFrame:
        """id, rank, hit of code by words and vectors; peek leaves the body out. A blank query has no hit. Words are looked up in the stored index."""
        k = recall.limit_of(limit, self.config.default_limit)
        code = recall.selected(self.store.read("entries"), types=["code"], project_id=project_id)
        if not query.strip():
            return self._no_hits()
        vectors = self.store.read("vectors").join(code.select("id"), "id", "left_semi")
        near = ranking.vector_topk(vectors.select("id", "embedding"), self.embed_text(query.strip()), 3 * k)
        words = self.words.search(query, 3 * k, project_key_of(project_id) if project_id else None)
        return recall.rendered(ranking.fused(near, words, k, self.config.low_confidence), code, peek)

    def _no_hits(self) -> DataFrame:
        return self.spark.createDataFrame([], "id long, rank int, hit string")

    def code_call_graph(self, name: str, direction: str = "callers", project_id: str | None = None) -> DataFrame:
        return source_code.edges_of(self.store.read("call_edges"), name, direction, project_id)

    def unsupported_language(self, name: str, project_id: str | None = None) -> str | None:
        """Why the call graph has nothing for a name: its file's language; None if it may have."""
        first = source_code.call_language(self.store.read("entries"), name, project_id).first()
        if first is None or first["supported"]:
            return None
        return f"No call graph for '{first['path']}' (language: {first['language']}). Supported languages: {', '.join(sorted(set(source_code.FUNCTION_KEYWORDS)))}."

    # --- catalog and upkeep

    def list_projects(self) -> DataFrame:
        return recall.project_catalog(self.store.read("projects"))

    def index_status(self, project_id: str | None = None) -> DataFrame:
        status = recall.index_status(self.store.read("entries"), self.store.read("projects"))
        return status.where(F.col("project_id").isNull() if project_id is None else project_key("project_id") == project_key_of(project_id))

    def index_health_check(self, live_files: DataFrame, live_projects: DataFrame, project_id: str | None = None) -> DataFrame:
        """Remove what is gone from every table, of one project or all; message."""
        names = ("entries", "file_hashes", "call_edges", "projects")
        old = {n: self.store.read(n) for n in names}
        tables = maintenance.health(*[old[n] for n in names], live_files, live_projects, project_id)
        message = materialize(maintenance.report_text(tables["report"]), "report")
        if message.first()[0] == maintenance.NOTHING_STALE:
            return message
        gone = materialize(old["entries"].join(tables["entries"].select("id"), "id", "left_anti"), "gone")
        dropped = {n: materialize(keyed(old[n], *KEYS[n]).join(keyed(tables[n], *KEYS[n]).select(*key_names(*KEYS[n])).distinct(), key_names(*KEYS[n]), "left_anti").select(*KEYS[n]), n) for n in names[1:]}
        with self.store.change() as change:
            self._remove(change, gone)
            for n, keys in dropped.items():
                change.drop(n, keys)
            self._log(change, "health", message.first()[0])
        return message

    def auto_index(self, root: str | None) -> bool:
        """Index a checkout on its first use, where the settings say so; whether it was done."""
        if not root or not self.config.auto_index or recall.is_indexed(self.store.read("projects"), identity.resolve(root)[0]):
            return False
        self.index_codebase(root)
        return True

    def index_metrics(self) -> DataFrame:
        """name, n_rows, version of every table of the store."""
        counted = [self.store.read(n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows", F.lit(self.store.version()).alias("version")) for n in ("entries", "vectors", "projects", "file_hashes", "call_edges")]
        return reduce(DataFrame.unionByName, counted)

    def index_logs(self, category: str | None = None, level: str | None = None, limit: int | None = 50) -> DataFrame:
        """at, level, category, message: the newest entries of the log."""
        rows = self.store.read("logs")
        for name, value in (("category", category), ("level", level and level.upper())):
            rows = rows.where(F.col(name) == value) if value else rows
        return rows.orderBy(F.desc("at"), "message").limit(recall.limit_of(limit, 50))

    def compact(self) -> None:
        """Fold the folders that changes left into one for each table; to be run now and then."""
        self.store.compact()

    # --- conversations

    def retain_turns(self, messages: DataFrame) -> DataFrame:
        turns = conversation.retained_turns(messages, self.config.retain_every_n_turns, self.config.retain_max_chars)
        return self.remember(conversation.to_remember(turns))

    def prefetch(self, query: str, limit: int = 5) -> DataFrame:
        hits = self.recall(query, limit, types=["experience"], exclude_categories=["conversation", "compression"])
        return conversation.prefetch_text(hits, self.config.recall_max_chars)

    # --- tools

    def tool(self, name: str, args: dict | None = None) -> str:
        """The text answer of a tool, or a JSON error."""
        args = dict(args or {})
        run = getattr(self, f"_tool_{name}", None) if name in TOOL_NAMES else None
        if run is None:
            return json.dumps({"error": f"unknown tool: {name}"})
        try:
            return run(args)
        except KeyError as e:
            return json.dumps({"error": f"{name} needs {e.args[0]}"})
        except (TypeError, ValueError) as e:
            return json.dumps({"error": str(e)})

    def _tool_memory_store(self, args: dict) -> str:
        action, path = args["action"], args.get("project_path")
        if action == "retain":
            text = str(args.get("text") or "").strip()
            if not text:
                return json.dumps({"error": "retain needs a text"})
            self.auto_index(path)
            project = self._project(None, path)
            rows = self.spark.createDataFrame([(text, args.get("category") or "general", project, args.get("tags"))], "text string, category string, project_id string, tags array<string>")
            return f"Remembered #{self.remember(rows).first()['id']}" + (f" for project {project}." if project else ".")
        if action == "recall":
            if not str(args.get("query") or "").strip():
                return json.dumps({"error": "recall needs a query"})
            self.auto_index(path)
            hits = self.recall(args["query"], args.get("limit"), types=["experience"], project_id=self._project(None, path), tags=args.get("tags"))
            return self._said(hits, "hit", "Nothing in memory matches." + NO_HIT)
        if action == "list":
            none = "No facts have these tags." if args.get("tags") else "No facts are stored."
            return self._said(self.list_experiences(args.get("limit", 20), args.get("category"), args.get("tags")), "line", none, "\n")
        return json.dumps({"error": f"unknown action: {action}"})

    def _code(self, args: dict, peek: bool) -> str:
        query, path = str(args["query"]), args.get("project_path")
        if not query.strip():
            return "The query is empty."
        self.auto_index(path)
        if self.store.read("projects").isEmpty():
            return "The catalog is empty: index a checkout with index_codebase first." + NO_HIT
        if (wrong := self.config_mismatch().first()) is not None:
            return f"The index was built with {wrong['key']} = {wrong['value']}, not {wrong['configured']}. Rebuild it with force."
        if self.store.read("vectors").isEmpty():
            return "The index is empty." + NO_HIT
        return self._said(self.code_recall(query, args.get("limit"), self._project(args.get("project_id"), path), peek), "hit", "No code matches." + NO_HIT)

    def _tool_code_recall(self, args: dict) -> str:
        return self._code(args, False)

    def _tool_code_peek(self, args: dict) -> str:
        return self._code(args, True)

    def _tool_code_call_graph(self, args: dict) -> str:
        name, direction = args["name"], args.get("direction", "callers")
        project = self._project(args.get("project_id"), args.get("project_path"))
        edges = self.code_call_graph(name, direction, project)
        if (reason := self.unsupported_language(name, project)) is not None:
            return reason
        if direction == "callers":
            line = F.format_string("  %s @ %s:%s-%s", "caller_symbol", "path", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("caller_start_line", "caller_end_line")])
        else:
            line = F.concat(F.format_string("  %s @ %s", "callee", "path"), F.coalesce(F.concat(F.lit(":"), F.col("callee_line").cast("string")), F.lit("")))
        said = self._said(edges.select(line.alias("line")), "line", "", "\n")
        return f"{direction.capitalize()}:\n{said}" if said else f"No {direction} found for '{name}'."

    def _tool_index_codebase(self, args: dict) -> str:
        r = self.index_codebase(args["path"], args.get("force", False)).first()
        return f"Indexed {r['project_id']} at {r['root_path']}: {r['added']} chunks added, {r['skipped']} files skipped, {r['removed']} chunks removed."

    def _tool_list_code_projects(self, args: dict) -> str:
        rows = self.list_projects().orderBy("position").select(F.format_string("- %s\n  root: %s\n  indexed: %s", "project_id", "root_path", "indexed").alias("line"))
        return self._said(rows, "line", "The catalog is empty.", "\n")

    def _tool_index_status(self, args: dict) -> str:
        rows = self.index_status(self._project(args.get("project_id"), args.get("project_path")))
        return self._said(rows.select(F.format_string("Code entries: %d\nExperiences: %d\nLast indexed: %s", "code_entries", "experiences", "last_indexed").alias("line")), "line", "The project is not in the catalog.", "\n")

    def _tool_index_health_check(self, args: dict) -> str:
        projects = self.store.read("projects")
        return self._said(self.index_health_check(*files.live(self.spark, projects), self._project(args.get("project_id"), args.get("project_path"))), "message", "Nothing to check.")

    def _tool_index_logs(self, args: dict) -> str:
        rows = self.index_logs(args.get("category"), args.get("level"), args.get("limit", 50))
        return self._said(rows.select(F.format_string("%s %s [%s] %s", F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "level", "category", "message").alias("line")), "line", "The log is empty.", "\n")

    def _tool_index_metrics(self, args: dict) -> str:
        return self._said(self.index_metrics().select(F.format_string("%s: %d rows, version %d", "name", "n_rows", "version").alias("line")), "line", "The store is empty.", "\n")

    def _tool_preload_models(self, args: dict) -> str:
        cached, self.loaded = self.loaded, True
        return f"Embedder '{self.config.embedding_model}' is ready with {len(self.embed_text('ready'))} dimensions (cached: {str(cached).lower()})."

    @staticmethod
    def _said(rows: DataFrame, column: str, none: str, sep: str = "\n\n") -> str:
        lines = [r[0] for r in (rows.orderBy("rank") if "rank" in rows.columns else rows).select(column).collect()]
        return sep.join(lines) if lines else none
