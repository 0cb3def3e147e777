"""Source files: which are in scope, their chunks and the calls between their functions.

Everything is an expression over a file's lines, so a file stays in its row and nothing is shuffled.

Defined results: a NULL text has no chunk and no edge; an empty one has one unnamed chunk; line ends of
any kind count as one line feed; files over the size limit are out of scope; paths of unknown
extension have no language.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselite.functions.keys import project_key, project_key_of
from tesselite.functions.text import col

# fixed values: language of a file by its extension
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust",
    ".java": "java", ".rb": "ruby", ".cs": "c_sharp", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
}
# fixed values: languages whose calls are extracted, with the keyword that begins a function
FUNCTION_KEYWORDS = {"python": "def", "javascript": "function", "typescript": "function", "tsx": "function", "go": "func", "rust": "fn"}
# fixed values: words before a bracket that are no calls
NO_CALLS = ("def", "if", "for", "while", "return", "print")
NO_CALLS_ELSEWHERE = (*NO_CALLS, "function", "func", "fn")
# fixed values: directories, files and endings never indexed; in three parts, as names match a whole segment of a path, endings its end and the pattern all of it
DENIED_PARTS = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build",
    "target", "bin", "obj", ".next", ".nuxt", ".env", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "poetry.lock",
)
DENIED_ENDINGS = (".pyc", ".pyo", ".so", ".dll", ".dylib", ".exe", ".bin", ".class", ".o", ".obj", ".min.js", ".min.css", ".map", ".lock")
DENIED_WHOLE = r"^\.env\..*$"
MAX_BYTES = 512_000
MAX_CHUNKS = 200
MAX_CHARS = 12_000

WORD = r"[\p{L}\p{N}_]+"
DECLARATION = rf"^(?:export\s+)?(?:async\s+)?(?:def|class|func|fn|interface|struct|enum|type)\s+({WORD})"
CALL = rf"\b([A-Za-z_][\p{{L}}\p{{N}}_]*)\s*\("


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./\\]+)$", 1))


def language(path: Column | str) -> Column:
    """The language of a path; NULL if unknown."""
    table = F.create_map(*[x for e, n in LANGUAGES.items() for x in (F.lit(e), F.lit(n))])
    return table[extension(path)]


def denied(path: Column | str, own_parts: Sequence[str] = ()) -> Column:
    """Whether a relative path lies in a denied directory, or is a denied file or ending."""
    path = col(path)
    parts = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in (*DENIED_PARTS, *own_parts)]))
    ends = F.lit(False)
    for e in DENIED_ENDINGS:
        ends = ends | path.endswith(e)
    return parts | ends | path.rlike(DENIED_WHOLE)


def ignore_regexes(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """Ignore-file lines as (regex, ignores): later lines win, `!` takes back."""
    out = []
    for line in lines:
        line = line.rstrip("\r\n").rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        body = body[1:] if body.startswith("\\") else body
        only_dir, anchored = body.endswith("/"), "/" in body.rstrip("/")
        body = body.strip("/")
        regex, i = "", 0
        while i < len(body):
            if body.startswith("**/", i):
                regex, i = regex + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                regex, i = regex + ".*", i + 2
            elif body[i] == "*":
                regex, i = regex + "[^/]*", i + 1
            elif body[i] == "?":
                regex, i = regex + "[^/]", i + 1
            elif body[i] == "[" and "]" in body[i + 1 :]:
                end = body.index("]", i + 1)
                regex, i = regex + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                regex, i = regex + ("\\" + body[i] if not body[i].isalnum() and body[i] not in "_/" else body[i]), i + 1
        out.append((("^" if anchored else "(?:^|/)") + regex + ("/.*$" if only_dir else "(?:/.*)?$"), not negated))
    return out


def ignored(path: Column | str, lines: Iterable[str]) -> Column:
    """Whether ignore-file lines leave a path out."""
    path, out = col(path), F.lit(False)
    for regex, ignores in ignore_regexes(lines):
        out = F.when(path.rlike(regex), F.lit(ignores)).otherwise(out)
    return out


def in_scope(files: DataFrame, ignore: Iterable[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files (path, n_bytes) that are indexed: known extension, not denied, not ignored, not too large; with their language."""
    rows = files.withColumn("language", language("path"))
    return rows.where(F.col("language").isNotNull() & (F.col("n_bytes") <= max_bytes) & ~denied("path") & ~ignored("path", ignore))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def chunks(files: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, chunk_no, symbol, start_line, end_line, text, content_hash of each file's chunks.

    A chunk reaches from a declaration at the line's beginning to the next; its end line is the line
    after its last, as it ends with that line's feed. Without a declaration the file is one chunk.
    """
    rows = files.where(F.col(text).isNotNull()).select(*keys, _lines(F.col(text)).alias("_l"))
    rows = rows.withColumn("_n", F.size("_l"))
    at = F.filter(F.sequence(F.lit(1), F.col("_n")), lambda i: F.element_at("_l", i).rlike(DECLARATION))
    rows = rows.withColumn("_at", at)
    starts = F.when(F.size("_at") > 0, F.slice("_at", 1, MAX_CHUNKS)).otherwise(F.array(F.lit(1)))
    each = rows.select(*keys, "_l", "_n", "_at", F.posexplode(starts).alias("_i", "start_line"))
    named = F.size("_at") > 0
    # get() gives NULL behind the end, which is where the last chunk's successor would be
    following = F.when(named, F.get("_at", F.col("_i") + 1))
    last = F.coalesce(following - 1, F.col("_n"))
    body = F.array_join(F.slice("_l", F.col("start_line"), last - F.col("start_line") + 1), "\n")
    body = F.when(following.isNotNull(), F.concat(body, F.lit("\n"))).otherwise(body)
    ends = F.when(~named, F.greatest(F.lit(1), F.when(F.element_at("_l", -1) == "", F.col("_n") - 1).otherwise(F.col("_n")))).otherwise(F.coalesce(following, F.col("_n")))
    symbol = F.when(named, F.regexp_extract(F.element_at("_l", F.col("start_line")), DECLARATION, 1))
    out = each.select(*keys, (F.col("_i") + 1).alias("chunk_no"), symbol.alias("symbol"), "start_line", ends.alias("end_line"), body.alias("_b"))
    return out.select(*keys, "chunk_no", "symbol", "start_line", "end_line", F.substring("_b", 1, MAX_CHARS).alias("text"), F.sha2(F.col("_b").cast("binary"), 256).alias("content_hash"))


def call_edges(files: DataFrame, *keys: str, text: str = "text", path: str = "path") -> DataFrame:
    """keys, caller_symbol, callee, caller_start_line, caller_end_line, callee_line.

    A word before a bracket is called by the last function whose definition stood above; the definition's
    own line is not looked at, nor are keywords and the function itself.
    """
    keyed = files.withColumn("_lang", language(path)).where(F.col("_lang").isin(*FUNCTION_KEYWORDS) & F.col(text).isNotNull())
    rows = keyed.select(*keys, "_lang", _lines(F.col(text)).alias("_l"))

    def defined(line: Column) -> Column:
        """The function that a line defines, by its file's language; Python's definitions begin the line as it is, others the line without its indent."""
        bare = F.trim(F.translate(line, "\t", " "))
        name = F.lit("")
        for lang, word in FUNCTION_KEYWORDS.items():
            name = F.when(F.col("_lang") == lang, F.regexp_extract(line if lang == "python" else bare, rf"^{word}\s+({WORD})\s*\(", 1)).otherwise(name)
        return F.nullif(name, F.lit(""))

    rows = rows.withColumn("_d", F.transform("_l", lambda s: F.when(s.contains("("), defined(s))))
    rows = rows.withColumn("_at", F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: F.element_at("_d", i).isNotNull())).where(F.size("_at") > 0)
    lines = F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: (i > F.element_at("_at", 1)) & F.element_at("_d", i).isNull() & F.element_at("_l", i).contains("("))
    # a line's calls are found inside the row, so the exploded rows don't carry the file with them
    found = F.transform(lines, lambda i: F.struct(i.alias("i"), F.element_at(F.filter("_at", lambda a: a < i), -1).alias("start"), F.regexp_extract_all(F.element_at("_l", i), F.lit(CALL), F.lit(1)).alias("calls")))
    named = F.transform(found, lambda x: F.struct(x["i"].alias("callee_line"), x["start"].alias("caller_start_line"), F.element_at("_d", x["start"]).alias("caller_symbol"), x["calls"].alias("_c")))
    each = rows.select(*keys, "_lang", F.explode(named).alias("_e")).select(*keys, "_lang", "_e.*")
    calls = each.select(*keys, "_lang", "caller_symbol", F.explode("_c").alias("callee"), "caller_start_line", F.col("callee_line").alias("caller_end_line"), "callee_line")
    skipped = F.when(F.col("_lang") == "python", F.col("callee").isin(*NO_CALLS)).otherwise(F.col("callee").isin(*NO_CALLS_ELSEWHERE))
    return calls.where(~skipped & (F.col("callee") != F.col("caller_symbol"))).drop("_lang")


def edges_of(edges: DataFrame, name: str, direction: str = "callers", project_id: str | None = None) -> DataFrame:
    """The edges from a function (`callees`) or to it (`callers`), repeated ones included, in order of the other end."""
    if direction not in ("callers", "callees"):
        raise ValueError(f"direction must be callers or callees, not {direction!r}")
    own, other = ("callee", "caller_symbol") if direction == "callers" else ("caller_symbol", "callee")
    rows = edges.where(F.col(own) == name)
    if project_id is not None:
        rows = rows.where(project_key("project_id") == project_key_of(project_id))
    return rows.orderBy(other, "path", "caller_start_line", "callee_line")


def call_language(entries: DataFrame, name: str, project_id: str | None = None) -> DataFrame:
    """path, language, supported of the first code entry by id whose symbol is the name or whose path contains it."""
    rows = entries.where(F.col("entry_type") == "code")
    if project_id is not None:
        rows = rows.where(project_key("project_id") == project_key_of(project_id))
    rows = rows.where((F.col("symbol") == name) | F.lower("path").like(f"%{name.lower()}%"))
    first = rows.orderBy("id", "path").limit(1)
    known = language("path")
    return first.select("id", "path", F.coalesce(known, F.lit("unknown")).alias("language"), F.coalesce(known.isin(*FUNCTION_KEYWORDS), F.lit(False)).alias("supported"))
