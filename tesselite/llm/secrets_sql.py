"""The credential query in SQL: the same formats line by line, in regexes without lookaround and without an index."""

from __future__ import annotations

from tesselite.llm import secrets


def _q(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def _each(regex: str, groups: str, test: str) -> str:
    """Whether a match of the regex, of which the groups are taken, passes the test on struct m."""
    names = ", ".join(f"'{g}'" for g in groups)
    return f"len(list_filter(list_transform(regexp_extract_all(line, {_q(regex)}), lambda x: regexp_extract(x, {_q(regex)}, [{names}])), lambda m: {test})) > 0"


def build() -> str:
    """The whole query: id, line_no."""
    name, token, piece = secrets.NAME, secrets.TOKEN, secrets.TOKEN_PIECE
    bare = r"""regexp_replace(m.v, '["'']\s*\+?\s*["'']', '', 'g')"""
    plausible = (
        f"length({bare}) >= 6 AND NOT regexp_matches({bare}, '\\s') AND NOT regexp_matches({bare}, {_q(secrets.PLACEHOLDER.pattern)}) AND NOT regexp_matches({bare}, {_q(secrets.DIGEST.pattern)}) "
        f"AND (regexp_matches({bare}, '\\d') OR regexp_matches({bare}, '[^\\w.\\-/:]') OR (regexp_matches({bare}, '[a-z]') AND regexp_matches(substr({bare}, 2), '[A-Z]') AND length({bare}) >= 10))"
    )
    setting = f"{plausible} AND NOT regexp_matches(m.n, {_q(secrets.HARMLESS_NAME.pattern)})"
    decoded = "coalesce(TRY(CAST(from_base64(m.v || repeat('=', CAST((4 - length(m.v) % 4) % 4 AS BIGINT))) AS VARCHAR)), '')"
    heads = secrets._base64_heads()
    joined = secrets._joined(r"[^\"'\s]{6,}")
    tests = [
        f"regexp_matches(line, {_q(r'(?:^|[^A-Za-z0-9_.+/=-])' + token)})",
        f"regexp_matches(line, {_q(rf'''[\"']{piece}[\"']\s*\+\s*[\"'][^\"'\s]+[\"']''')})",
        _each(rf"[\"'](?P<v>(?:{heads})[A-Za-z0-9+/]+={{0,2}})[\"']", "v", f"regexp_full_match({decoded}, {_q(piece)})"),
        "regexp_matches(line, '-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----')",
        _each(rf"(?i)(?P<n>[A-Za-z0-9_.-]*{name}[A-Za-z0-9_]*)[\"']?\]?\s*(?::=|=>|=|:)\s*[\"'](?P<v>{joined})[\"']", "nv", setting),
        _each(rf"(?i)(?:env\w*|fetch)[\[(.]\s*[\"']?(?P<n>\w*(?:{name}|key)\w*)[\"']?\]?\)?\s*(?:,|\?\?|\|\|)\s*[\"'](?P<v>[^\"'\s]{{6,}})[\"']", "nv", setting),
        _each(rf"(?i)(?:^|[\s;])(?P<n>[A-Z0-9_]*(?:{name}|_key)[A-Z0-9_]*)=(?P<v>[^\s\"'`;,()<>{{}}\[\]]{{8,}})", "nv", setting),
        _each(r"(?i)(?:^|\s)(?:#|//|--|\*|;)[^\n]*?(?P<n>token|login|password|works with|todo remove|secret|credentials?|api key)\s*[:=]\s*(?P<v>[A-Za-z0-9+/_.=-]{16,})", "nv", plausible),
        _each(r"(?i)\bBasic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})", "v", f"{decoded} LIKE '%:%' AND NOT regexp_matches(regexp_replace({decoded}, '^[^:]*:', ''), {_q(secrets.PLACEHOLDER.pattern)})"),
        _each(r"(?i)\bBearer\s+(?P<v>[A-Za-z0-9_.~+/-]{20,}=*)", "v", plausible),
        r"regexp_matches(line, '(?:^|[^A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}')",
        _each(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"']+:(?P<v>[^\s@/\"']+)@", "v", f"NOT regexp_matches(m.v, {_q(secrets.PLACEHOLDER.pattern)})"),
        _each(r"(?i)\b(?:connect|login|authenticate)\w*\(\s*[\"'][^\"']*[\"']\s*,\s*[\"'][^\"']*[\"']\s*,\s*[\"'](?P<v>[^\"'\s]{6,})[\"']", "v", plausible),
    ]
    return f"""
WITH t AS (SELECT DISTINCT id, text FROM entries WHERE entry_type = 'code' AND id IS NOT NULL AND length(text) > 0),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM t)
SELECT DISTINCT id, line_no FROM l WHERE {chr(10) + " OR ".join(f"({x})" for x in tests)}
"""
