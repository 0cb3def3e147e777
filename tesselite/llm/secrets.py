"""Credentials embedded in source code: a trigram index and regexes verified on candidates only.

The index holds, for every text, a posting for each trigram of the lower-cased text, read in chunks
that overlap by two characters. From the syntax tree of every detection regex a trigram query is derived:
what each match must contain, as alternatives of sets of trigrams. The postings of each alternative
are intersected (a count per text and alternative that reaches the size of the set), and only the
texts that are left are read again and searched whole with those regexes. By default only trigrams that
some regex asks for get a posting; others would never be read.

A match is a credential if its value is: placeholders, lookups without a literal value, digests,
checksums, ids and public keys are none. Redaction replaces the value alone, inside its quotes; of a
private key it replaces the lines or the escaped text between header and footer.

Defined results: NULL and empty texts have no credential; repeated rows count once; lines are split
at the line feed and count from 1; a credential counts at the line where it begins; texts of any
length are searched whole; an empty table gives no rows. Columns beside those named are not read.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

try:
    from re import _constants as C
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as sre

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselite.session import materialize

REDACTED = "[REDACTED]"

# fixed values: formats of issued tokens
TOKEN = r"(?:hrb_pat_[A-Za-z0-9]{16,}|qlm_live_[A-Za-z0-9]{12,}|vtx-[A-Za-z0-9]{16,}|orb1_[A-Za-z0-9]{12,}|zk\.[A-Za-z0-9_-]{20,}|TMK[A-Z0-9]{12,})"
TOKEN_PIECE = r"(?:hrb_pat_[A-Za-z0-9]{6,}|qlm_live_[A-Za-z0-9]{6,}|vtx-[A-Za-z0-9]{8,}|orb1_[A-Za-z0-9]{6,}|zk\.[A-Za-z0-9_-]{10,}|TMK[A-Z0-9]{5,})"
# fixed values: published formats of tokens
PUBLISHED = (
    r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|ghp_[A-Za-z0-9]{30,}|gho_[A-Za-z0-9]{30,}|ghu_[A-Za-z0-9]{30,}|ghs_[A-Za-z0-9]{30,}|ghr_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{20,}"
    r"|sk_live_[A-Za-z0-9]{16,}|rk_live_[A-Za-z0-9]{16,}|xox(?:b|a|p|r|s)-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{32,}|hf_[A-Za-z]{30,})"
)
TOKEN_HEADS = ("hrb_pat_", "qlm_live_", "vtx-", "orb1_", "zk.", "TMK")
# fixed values: words in the names of settings that hold a secret
NAME = r"(?:pass(?:wor[dt]|wd|phrase)?|pwd|_pw|secret|token|api_?key|apikey|signing_?key|storage_?key|access_?key|private_?key|auth|credential|login)"
PLACEHOLDER = re.compile(
    r"(?i)^(?:|x+|\*+|\.+|-+|<.*>|\[.*\]|\{.*\}|\$\{?.*\}?|%\w+%|changeme|change[-_ ]?me|replace[-_ ]?(?:me|this)?.*|your[-_ ].*|example.*|dummy|placeholder|redacted|none|null|nil|true|false|todo|test|secret|password|passwd|token|api[-_]?key|key|user(?:name)?|undefined)$"
)
DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|blake2\w?|crc\d*)[:-]|^data:|^[a-z][\w+.-]*://|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^-----")
HARMLESS_NAME = re.compile(r"(?i)(?:digest|checksum|etag|uuid|commit|revision|integrity|fingerprint|hash|_field|_type|_name|_id|_len|_count|_url|_path|_file|_env|public)$")


def _joined(piece: str) -> str:
    """A literal split into pieces that are joined by + or by standing side by side."""
    return piece + r"(?:[\"']\s*\+?\s*[\"'][^\"'\s]+)*"


def plausible(value: str) -> bool:
    """Whether a literal may be a secret: not a placeholder, no digest, no plain words."""
    bare = re.sub(r"[\"']\s*\+?\s*[\"']", "", value)
    if len(bare) < 6 or re.search(r"\s", bare) or PLACEHOLDER.match(bare) or DIGEST.match(bare):
        return False
    return bool(re.search(r"\d", bare) or re.search(r"[^\w.\-/:]", bare) or (re.search(r"[a-z]", bare) and re.search(r"[A-Z]", bare[1:]) and len(bare) >= 10))


def random_looking(value: str) -> bool:
    """Whether a value without quotes is no word, name or number: letters and digits alternate, or it is long and of many kinds of characters."""
    if not plausible(value) or not re.search(r"[A-Za-z]", value):
        return False
    turns = len(re.findall(r"(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])", value))
    kinds = sum(bool(re.search(k, value)) for k in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9_.:-]"))
    return turns >= 3 or (len(value) >= 20 and kinds >= 3) or (kinds == 4 and len(value) >= 10)


def _bare_setting(m: re.Match) -> bool:
    return random_looking(m["v"]) and not HARMLESS_NAME.search(m["n"])


def _password_word(m: re.Match) -> bool:
    return not PLACEHOLDER.match(m["v"]) and not HARMLESS_NAME.search(m["n"])


def _setting(m: re.Match) -> bool:
    return plausible(m["v"]) and not HARMLESS_NAME.search(m["n"])


def _decodes_to_token(m: re.Match) -> bool:
    try:
        text = base64.b64decode(m["v"] + "=" * (-len(m["v"]) % 4), validate=True).decode("ascii")
    except (ValueError, binascii.Error):
        return False
    return bool(re.fullmatch(TOKEN_PIECE, text))


def _basic(m: re.Match) -> bool:
    try:
        text = base64.b64decode(m["v"] + "=" * (-len(m["v"]) % 4), validate=True).decode("utf-8")
    except (ValueError, binascii.Error):
        return False
    user, colon, password = text.partition(":")
    return bool(colon) and not PLACEHOLDER.match(password)


def _value(m: re.Match) -> bool:
    return plausible(m["v"])


def _in_url(m: re.Match) -> bool:
    return not PLACEHOLDER.match(m["v"])


def _always(m: re.Match) -> bool:
    return True


@dataclass(frozen=True)
class Detector:
    """A regex whose group v is the secret, and what decides whether a match is one."""

    name: str
    regex: str
    accept: Callable[[re.Match], bool] = _always


def _base64_heads() -> str:
    """What base64 texts begin with whose plain text begins with a token's head."""
    heads = []
    for head in TOKEN_HEADS:
        whole = base64.b64encode(head.encode()).decode().rstrip("=")
        heads.append(whole[: len(head) * 8 // 6])
    return "|".join(re.escape(h) for h in heads)


DETECTORS = (
    Detector("token", rf"(?<![A-Za-z0-9_.+/=-])(?P<v>{TOKEN})(?![A-Za-z0-9_-]*[\"']\s*\+)"),
    Detector("split_token", rf"[\"'](?P<v>{TOKEN_PIECE}[\"']\s*\+\s*[\"'][^\"'\s]+)[\"']"),
    Detector("encoded_token", rf"[\"'](?P<v>(?:{_base64_heads()})[A-Za-z0-9+/]+={{0,2}})[\"']", _decodes_to_token),
    Detector("private_key", r"-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----(?P<v>)"),
    Detector("setting", rf"(?i)(?P<n>[A-Za-z0-9_.-]*{NAME}[A-Za-z0-9_]*)[\"']?\]?\s*(?::=|=>|=|:)\s*[\"'](?P<v>{_joined(r'[^\"\'\s]{6,}')})[\"']", _setting),
    Detector("fallback", rf"(?i)(?:env\w*|fetch)[\[(.]\s*[\"']?(?P<n>\w*(?:{NAME}|key)\w*)[\"']?\]?\)?\s*(?:,|\?\?|\|\|)\s*[\"'](?P<v>[^\"'\s]{{6,}})[\"']", _setting),
    Detector("shell_setting", rf"(?i)(?:^|[\s;])(?P<n>[A-Z0-9_]*(?:{NAME}|_key)[A-Z0-9_]*)=(?P<v>[^\s\"'`;,()<>{{}}\[\]]{{8,}})", _setting),
    Detector("published_token", rf"(?<![A-Za-z0-9_.+/=-])(?P<v>{PUBLISHED})"),
    Detector("bare_setting", rf"(?i)^[ \t]*(?:export |set |- )?[ \t]*[\"']?(?P<n>[A-Za-z0-9_.-]*{NAME}[A-Za-z0-9_]*)[\"']?[ \t]*[:=][ \t]*(?P<v>[^\s\"'`,;()<>{{}}\[\]$]{{8,}})[ \t]*(?:#.*)?$", _bare_setting),
    Detector("element", rf"(?i)<(?P<n>[A-Za-z0-9_.:-]*{NAME}[A-Za-z0-9_]*)(?: [^<>]*)?>\s*(?P<v>[^<>\s]{{6,}})\s*</", _setting),
    Detector("password_word", r"(?i)(?P<n>\b[A-Za-z0-9_.]*(?:password|passwd|passphrase))[\"']?\]?\s*(?::=|=>|=|:)\s*[\"'](?P<v>[a-z]{10,})[\"']", _password_word),
    Detector("remark", r"(?i)(?:^|\s)(?:#|//|--|\*|;)[^\n]*?(?P<n>token|login|password|works with|todo remove|secret|credentials?|api key)\s*[:=]\s*(?P<v>[A-Za-z0-9+/_.=-]{16,})", _value),
    Detector("basic_auth", r"(?i)\bBasic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})", _basic),
    Detector("bearer", r"(?i)\bBearer\s+(?P<v>[A-Za-z0-9_.~+/-]{20,}=*)", _value),
    Detector("web_token", r"(?<![A-Za-z0-9_.-])(?P<v>eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"),
    Detector("url_password", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"']+:(?P<v>[^\s@/\"']+)@", _in_url),
    Detector("connect_call", r"(?i)\b(?:connect|login|authenticate)\w*\(\s*[\"'][^\"']*[\"']\s*,\s*[\"'][^\"']*[\"']\s*,\s*[\"'](?P<v>[^\"'\s]{6,})[\"']", _value),
)

# --- trigram queries -------------------------------------------------------------------------------

#: A query: every member must hold, and of each member one alternative, all of whose trigrams occur.
Query = list[list[frozenset[str]]]
_MOST = 64


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _strings(node) -> list[str] | None:
    """All lower-cased strings a part of the tree matches, if they are few; else None."""
    op, arg = node
    if op is C.LITERAL:
        return [chr(arg).lower()]
    if op is C.IN:
        if any(o not in (C.LITERAL,) for o, _ in arg) or len(arg) > 4:
            return None
        return sorted({chr(a).lower() for _, a in arg})
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is C.BRANCH:
        parts = [_sequence_strings(p) for p in arg[1]]
        return None if any(p is None for p in parts) or sum(map(len, parts)) > _MOST else sorted({s for p in parts for s in p})
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        if high > 1:
            return None
        some = _sequence_strings(inner)
        return None if some is None else sorted({*some, *([""] if low == 0 else [])})
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return [""]
    return None


def _sequence_strings(seq) -> list[str] | None:
    out = [""]
    for node in seq:
        some = _strings(node)
        if some is None or len(out) * len(some) > _MOST:
            return None
        out = ["".join(p) for p in product(out, some)]
    return out


def required(regex: str) -> Query:
    """The trigram query of a regex: a necessary condition on the lower-cased text of every match."""

    def walk(seq) -> Query:
        query: Query = []
        run: list[str] = [""]

        def flush() -> None:
            nonlocal run
            if min(map(len, run)) >= 3:
                query.append(sorted({_grams(s) for s in run}, key=sorted))
            run = [""]

        for node in seq:
            op, arg = node
            some = _strings(node)
            if some is not None and len(run) * len(some) <= _MOST:
                run = ["".join(p) for p in product(run, some)]
                continue
            flush()
            if some is not None:
                run = some
            elif op is C.SUBPATTERN:
                query += walk(arg[-1])
            elif op is C.BRANCH:
                parts = [walk(p) for p in arg[1]]
                if all(parts):  # of each branch its most telling member, one of them must hold
                    best = [max(p, key=lambda m: min(map(len, m))) for p in parts]
                    query.append(sorted({a for m in best for a in m}, key=sorted))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                query += walk(arg[2])
        flush()
        return query

    return walk(sre.parse(regex))


# --- chunks, index, search -------------------------------------------------------------------------


def chunks_of(text: str, chunk_chars: int) -> Iterator[tuple[int, str]]:
    """Line number and text of each chunk: whole lines, as many as fit; a longer line is a chunk of its own."""
    if len(text) <= chunk_chars:
        yield 1, text
        return
    start, line, at, here = 0, 1, 0, 1
    for piece in re.findall(r"[^\n]*\n|[^\n]+", text):
        if at > start and at + len(piece) - start > chunk_chars:
            yield line, text[start:at]
            start, line = at, here
        at, here = at + len(piece), here + 1
    yield line, text[start:]


def _postings(wanted: frozenset[str] | None, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, before = set(), ""
                for _, chunk in chunks_of(text, chunk_chars):
                    low = before + chunk.lower()
                    here = {low[k : k + 3] for k in range(len(low) - 2)}
                    found |= here if wanted is None else here & wanted
                    before = low[-2:]
                ids += [i] * len(found)
                grams += found
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(ids, pa.int64())], names=["trigram", "id"])

    return run


def trigram_index(texts: DataFrame, wanted: frozenset[str] | None = None, chunk_chars: int = 65_536) -> DataFrame:
    """trigram, id: the postings, one per trigram and text. texts: id, text. wanted: None indexes every trigram."""
    return texts.mapInArrow(_postings(wanted, chunk_chars), "trigram string, id long")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """id, detectors: the texts whose postings satisfy a query, by intersection; the table of queries is as small as the regexes."""
    spark = index.sparkSession
    rows = [(name, m, a, g, len(grams), len(query)) for name, query in queries.items() for m, member in enumerate(query) for a, grams in enumerate(member) for g in sorted(grams)]
    wanted = spark.createDataFrame(rows, "detector string, member int, alternative int, trigram string, n_grams int, n_members int")
    met = (
        index.join(F.broadcast(wanted), "trigram")
        .groupBy("id", "detector", "member", "alternative")
        .agg(F.count(F.lit(1)).alias("n"), F.first("n_grams").alias("n_grams"), F.first("n_members").alias("n_members"))
        .where(F.col("n") >= F.col("n_grams"))
    )
    whole = met.groupBy("id", "detector").agg(F.countDistinct("member").alias("n"), F.first("n_members").alias("n_members")).where(F.col("n") == F.col("n_members"))
    return whole.groupBy("id").agg(F.collect_set("detector").alias("detectors"))


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    line: int
    detector: str


def search(text: str, detectors: tuple[Detector, ...] = DETECTORS, first_line: int = 1) -> list[Found]:
    """The credentials of a text in order; of overlapping ones the first, and of those that begin together the longest."""
    spans = []
    for d in detectors:
        for m in re.finditer(d.regex, text, re.MULTILINE):
            if d.accept(m):
                begin = m.start() if d.name == "private_key" else m.start("v")
                spans.append((begin, key_end(text, m.end()) if d.name == "private_key" else m.end("v"), d.name))
    out: list[Found] = []
    for begin, end, name in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or begin >= out[-1].end:
            out.append(Found(begin, end, first_line + text.count("\n", 0, begin), name))
    return out


def key_end(text: str, after_header: int) -> int:
    """Where a private key's footer ends, or where its lines do if it has none."""
    foot = re.compile(r"-----END (?:[A-Z0-9]+ )?PRIVATE KEY-----").search(text, after_header)
    head = text.find("-----BEGIN ", after_header)
    if foot and (head < 0 or foot.start() < head):
        return foot.end()
    rest = re.compile(r"(?:(?:\s|\\n|#|//|\*)*[A-Za-z0-9+/=]{16,})*").match(text, after_header)
    return rest.end() if rest else after_header


def _blank_key(key: str) -> str:
    """A private key without what stands between header and footer; line ends and comment signs stay."""
    head = re.match(r"-----BEGIN [A-Z0-9 ]*-----", key)
    foot = re.search(r"-----END [A-Z0-9 ]*-----$", key)
    begin, end = head.end() if head else 0, foot.start() if foot else len(key)
    body = re.sub(r"(\\n|(?<!\S)(?://|#|\*|--)(?!\S))|[A-Za-z0-9+/=]+", lambda m: m[1] or REDACTED, key[begin:end])
    return key[:begin] + body + key[end:]


def redact(text: str, found: list[Found] | None = None) -> str:
    """The text with the value of each credential found (or to be found) replaced; quotes, line ends and comment signs stay."""
    out, at = [], 0
    for f in search(text) if found is None else found:
        out.append(text[at : f.start])
        secret = text[f.start : f.end]
        if f.detector == "private_key":
            secret = _blank_key(secret)
        elif re.search(r"[\"']", secret):  # pieces: each is replaced inside its own quotes
            secret = re.sub(r"[^\"'\s+][^\"'\s]*(?=[\"']|$)", REDACTED, secret)
        else:
            secret = REDACTED
        out.append(secret)
        at = f.end
    return "".join([*out, text[at:]])


def _verify(redacted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines, kinds, texts = [], [], [], []
            for i, text, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = search(text, tuple(d for d in DETECTORS if d.name in names))
                if redacted and found:
                    ids.append(i), texts.append(redact(text, found))
                for f in () if redacted else found:
                    ids.append(i), lines.append(f.line), kinds.append(f.detector)
            if redacted:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "redacted_text"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(kinds, pa.string())], names=["id", "line_no", "detector"])

    return run


def find(texts: DataFrame, *, id_col: str = "id", text_col: str = "text", redacted: bool = False, chunk_chars: int = 65_536) -> DataFrame:
    """id, line_no, detector of every credential; or, with redacted, id and redacted_text of every text that holds one."""
    queries = {d.name: required(d.regex) for d in DETECTORS}
    wanted = frozenset(g for q in queries.values() for m in q for a in m for g in a)
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    index = materialize(trigram_index(rows, wanted, chunk_chars), "trigrams")
    left = candidates(index.distinct(), queries)
    hits = rows.join(left, "id").select("id", "text", "detectors")
    schema = "id long, redacted_text string" if redacted else "id long, line_no long, detector string"
    return hits.mapInArrow(_verify(redacted), schema).distinct()
