"""The engine as a memory provider of an agent: settings, tools, and what happens around turns and sessions.

Defined results: before initialize() and after shutdown() nothing is kept and every answer is empty or an
error; blank contents are not kept; turns are counted per session; work in the background is done in order, by
one thread, and shutdown() and the end of a session wait for it.
"""

from __future__ import annotations

import importlib.util
import json
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tesselite import config, tools
from tesselite.engine import Engine
from tesselite.operators import conversation

MESSAGE = "conv_id string, turn long, role string, content string"
#: Settings of the provider that a user is asked for: name, what it is, choices.
_ASKED = {
    "auto_retain_turns": ("Keep each completed turn", ["true", "false"]),
    "recall_max_chars": ("Most characters that a prefetch gives", None),
    "retain_max_chars": ("Most characters of either side of a kept turn", None),
    "retain_every_n_turns": ("Keep every n-th completed turn of a session", None),
}


class Provider:
    name = "tesselite"

    def __init__(self, spark: SparkSession):
        self.spark, self.engine, self.session_id = spark, None, ""
        self._turns: dict[str, int] = {}
        self._cache, self._queue = "", None

    # --- settings and life

    def is_available(self) -> bool:
        return all(importlib.util.find_spec(m) for m in ("pyspark", "pyarrow", "numpy", "yaml"))

    def get_config_schema(self) -> list[dict[str, Any]]:
        defaults = {f.name: f.default for f in fields(config.Config)}
        out = []
        for name, (description, choices) in _ASKED.items():
            value = str(defaults[name]).lower()
            out.append({"key": name, "description": description, "default": value, **({"choices": choices} if choices else {})})
        return out

    def save_config(self, values: dict[str, Any], data_dir: str) -> None:
        """Write settings, given as text or values, over those of a data folder."""
        kinds = {f.name: type(f.default) for f in fields(config.Config)}
        unknown = set(values) - set(kinds)
        if unknown:
            raise ValueError(f"unknown setting {sorted(unknown)[0]!r}")
        read = {k: (str(v).lower() == "true" if kinds[k] is bool else kinds[k](v)) for k, v in values.items()}
        config.save(replace(config.load(data_dir), **read))

    def initialize(self, session_id: str, data_dir: str, agent_context: str = "primary") -> None:
        """Open the store of a data folder; agents other than the primary one keep nothing."""
        if agent_context != "primary":
            return
        self.engine, self.session_id = Engine(self.spark, config.load(data_dir)), session_id.strip()
        self._queue = ThreadPoolExecutor(1)

    def shutdown(self) -> None:
        if self._queue is not None:
            self._queue.shutdown(wait=True)
        self.engine, self._queue, self._cache = None, None, ""

    def system_prompt_block(self) -> str:
        return f"# {self.name}\nA local memory of facts and code. Tools: {', '.join(sorted(tools.TOOL_NAMES))}. Facts that fit are given before each turn."

    # --- tools

    def get_tool_schemas(self) -> list[dict[str, Any]]:
        return tools.schemas()

    def handle_tool_call(self, tool_name: str, args: dict[str, Any]) -> str:
        if self.engine is None:
            return json.dumps({"error": f"{self.name} is not initialized"})
        return self.engine.tool(tool_name, args)

    # --- turns

    def _later(self, work, *args) -> Future | None:
        return self._queue.submit(work, *args) if self._queue is not None else None

    def prefetch(self, query: str) -> str:
        """The facts that fit a query, as text; what queue_prefetch has brought is given first."""
        if self._cache:
            return self._cache
        if self.engine is None or not query.strip():
            return ""
        found = self.engine.prefetch(query).first()
        return found[0] if found else ""

    def queue_prefetch(self, query: str) -> Future | None:
        """Fetch in the background for the next prefetch."""

        def fetch() -> None:
            self._cache = self.prefetch(query)

        return self._later(fetch) if query.strip() else None

    def _messages(self, messages: list[dict[str, Any]]) -> DataFrame:
        rows = [(self.session_id, i, m.get("role"), m.get("content") if isinstance(m.get("content"), str) else None) for i, m in enumerate(messages)]
        return self.spark.createDataFrame(rows, MESSAGE)

    def _keep(self, facts: DataFrame) -> None:
        self.engine.remember(conversation.to_remember(facts))

    def sync_turn(self, user_content: str, assistant_content: str, session_id: str = "") -> Future | None:
        """Keep a completed turn in the background, if it is the session's n-th."""
        if self.engine is None or not self.engine.config.auto_retain_turns:
            return None
        session, c = session_id.strip() or self.session_id, self.engine.config
        self._turns[session] = self._turns.get(session, 0) + 1
        self._cache = ""
        if self._turns[session] % c.retain_every_n_turns:
            return None
        rows = [(session, 0, "user", user_content), (session, 1, "assistant", assistant_content)]
        return self._later(lambda: self._keep(conversation.retained_turns(self.spark.createDataFrame(rows, MESSAGE), 1, c.retain_max_chars)))

    def on_pre_compress(self, messages: list[dict[str, Any]]) -> Future | None:
        """Keep a summary of the last messages before they leave the context."""
        if self.engine is None or not messages:
            return None
        return self._later(lambda: self._keep(conversation.compression_summaries(self._messages(messages))))

    def on_session_end(self, messages: list[dict[str, Any]]) -> None:
        """Wait for what is under way, then keep a summary of the session, where turns are kept at all."""
        if self.engine is None:
            return
        work = self._later(lambda: None)
        if messages and self.engine.config.auto_retain_turns:
            work = self._later(lambda: self._keep(conversation.session_summaries(self._messages(messages), self.engine.config.retain_max_chars)))
        work.result()

    def on_memory_write(self, action: str, target: str, content: str) -> None:
        """Mirror an addition to another memory."""
        if self.engine is None:
            return
        writes = self.spark.createDataFrame([(action, target, content)], "action string, target string, content string")
        facts = conversation.mirrored_writes(writes)
        self.engine.remember(facts.selectExpr("content AS text", "category"))


def register(context: Any, spark: SparkSession) -> None:
    """Hand a provider to an agent's plugin registry."""
    context.register_memory_provider(Provider(spark))
