"""Schemas of the engine's tools as an agent is given them: names, arguments and what is required."""

from __future__ import annotations

from typing import Any

_TEXT, _NUMBER, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean", "default": False}
_PROJECT = {"project_path": _TEXT, "project_id": _TEXT}

# fixed values: names of the tools and of their arguments; the first of each list are required
_TOOLS: dict[str, tuple[str, dict[str, Any], list[str]]] = {
    "memory_store": (
        "Keep facts, look them up, list them. Source code has its own tools.",
        {"action": {**_TEXT, "enum": ["retain", "recall", "list"]}, "text": _TEXT, "query": _TEXT, "category": _TEXT, "tags": {"type": "array", "items": _TEXT}, "project_path": _TEXT, "limit": _NUMBER},
        ["action"],
    ),
    "index_codebase": ("Index a checkout; only files that changed are read into chunks.", {"path": _TEXT, "force": _FLAG}, ["path"]),
    "code_recall": ("Search code by words and vectors.", {"query": _TEXT, "limit": _NUMBER, **_PROJECT}, ["query"]),
    "code_peek": ("The same search, with paths and symbols only.", {"query": _TEXT, "limit": _NUMBER, **_PROJECT}, ["query"]),
    "code_call_graph": ("Who calls a function, or whom it calls.", {"name": _TEXT, "direction": {**_TEXT, "enum": ["callers", "callees"], "default": "callers"}, "symbol_id": _NUMBER, **_PROJECT}, ["name"]),
    "list_code_projects": ("The catalog of projects.", {}, []),
    "index_status": ("Counts and time of the index, of a project or all.", _PROJECT, []),
    "index_health_check": ("Remove what no longer exists, of a project or all.", _PROJECT, []),
    "index_logs": ("The newest log entries.", {"category": _TEXT, "level": _TEXT, "limit": {**_NUMBER, "default": 50}}, []),
    "index_metrics": ("Rows and version of every table.", {}, []),
    "preload_models": ("Load the embedder ahead of its first use.", {}, []),
}
TOOL_NAMES = frozenset(_TOOLS)


def schemas() -> list[dict[str, Any]]:
    """One schema for each tool."""
    out = []
    for name, (description, arguments, required) in _TOOLS.items():
        parameters: dict[str, Any] = {"type": "object", "properties": dict(arguments)}
        if required:
            parameters["required"] = required
        out.append({"name": name, "description": description, "parameters": parameters})
    return out
