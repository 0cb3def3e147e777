"""Chunks and calls from the syntax tree, for Python, whose parser is at hand; other files go by their lines.

Trees can't be walked by built-in functions, so a file is parsed in an Arrow batch, where it stays in its
row. `parsers` takes more languages: a function from a text to its tree's declarations and calls.

Defined results: a file that has no parser, can't be parsed or declares nothing goes by its lines
(source_code.chunks, source_code.call_edges); a NULL text has no chunk and no edge; a nested declaration is
a chunk too; a call inside the arguments of a call is no edge; calls of a function by itself are kept.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselite.operators import source_code

#: Declarations (name, first line, last line) in order, and calls (caller, callee, caller's first and last line, line).
Tree = tuple[list[tuple[str, int, int]], list[tuple[str, str, int, int, int]]]


def python_tree(text: str) -> Tree | None:
    """The declarations and calls of a Python text; None if it is no Python."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    declared, calls = [], []
    # a stack of nodes still to visit, each with the function around it
    todo: list[tuple[ast.AST, tuple[str, int, int] | None]] = [(module, None)]
    while todo:
        node, around = todo.pop()
        if isinstance(node, ast.Call) and around:
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                calls.append((around[0], name, around[1], around[2], node.lineno))
            continue
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            declared.append((node.name, node.lineno, node.end_lineno))
            if not isinstance(node, ast.ClassDef):
                around = (node.name, node.lineno, node.end_lineno)
        todo += [(child, around) for child in reversed(list(ast.iter_child_nodes(node)))]
    return declared, calls


PARSERS: Mapping[str, Callable[[str], Tree | None]] = {"python": python_tree}
_CHUNK = "chunk_no int, symbol string, start_line int, end_line int, text string, content_hash string"
_EDGE = "caller_symbol string, callee string, caller_start_line int, caller_end_line int, callee_line int"


def _chunks_of(text: str, tree: Tree) -> list[dict]:
    lines, out = text.split("\n"), []
    for n, (name, first, last) in enumerate(tree[0][: source_code.MAX_CHUNKS], 1):
        body = "\n".join(lines[first - 1 : last])
        out.append({"chunk_no": n, "symbol": name, "start_line": first, "end_line": last, "text": body[: source_code.MAX_CHARS], "content_hash": hashlib.sha256(body.encode()).hexdigest()})
    return out


def _edges_of(text: str, tree: Tree) -> list[dict]:
    names = [c.split()[0] for c in _EDGE.split(", ")]
    return [dict(zip(names, call)) for call in tree[1]]


def _found(parsers: Mapping[str, Callable[[str], Tree | None]], make: Callable[[str, Tree], list[dict]], kind: pa.DataType):
    """Each row with what its text's tree gives, NULL where there is no tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, language in zip(batch.column("_text").to_pylist(), batch.column("_language").to_pylist()):
                tree = parsers[language](text) if text is not None and language in parsers else None
                out.append(None if tree is None else make(text, tree))
            yield batch.append_column("_found", pa.array(out, kind))

    return run


def _by_tree(files: DataFrame, keys: tuple[str, ...], text: str, path: str, parsers, make, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows with an array `_found` of structs, and the files that have none."""
    kinds = {"int": pa.int32(), "string": pa.string()}
    kind = pa.list_(pa.struct([(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))]))
    whole = F.regexp_replace(F.col(text), "\r\n?", "\n")
    own = list(dict.fromkeys([*keys, path, text]))
    rows = files.select(*own, whole.alias("_text"), source_code.language(path).alias("_language"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", _found array<struct<{', '.join(c.replace(' ', ': ') for c in schema.split(', '))}>>"
    found = rows.mapInArrow(_found(parsers, make, kind), ddl)
    return found, found.where(F.col("_found").isNull()).select(*own)


def chunks(files: DataFrame, *keys: str, text: str = "text", path: str = "path", parsers=PARSERS) -> DataFrame:
    """The columns of source_code.chunks, of declarations where a file has a tree with some."""
    found, lines = _by_tree(files, keys, text, path, parsers, lambda t, tree: _chunks_of(t, tree) or None, _CHUNK)
    nodes = found.where(F.col("_found").isNotNull()).select(*keys, F.explode("_found").alias("_e")).select(*keys, "_e.*")
    return nodes.unionByName(source_code.chunks(lines, *keys, text=text))


def call_edges(files: DataFrame, *keys: str, text: str = "text", path: str = "path", parsers=PARSERS) -> DataFrame:
    """The columns of source_code.call_edges, of call nodes where a file has a tree."""
    found, lines = _by_tree(files, keys, text, path, parsers, _edges_of, _EDGE)
    nodes = found.where(F.col("_found").isNotNull()).select(*keys, F.explode("_found").alias("_e")).select(*keys, "_e.*")
    return nodes.unionByName(source_code.call_edges(lines, *keys, text=text, path=path))
