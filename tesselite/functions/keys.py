"""Canonical forms of project ids and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_key(c: Column | str) -> Column:
    """Equal for ids that differ only in letter case, blanks around them or an ending `.git`; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"\.git$", "")


def path_key(c: Column | str) -> Column:
    r"""Equal for paths that differ only in `\` for `/`, doubled slashes or a leading `./`; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.translate(c, "\\", "/"), "/+", "/"), r"^(\./)+", "")


def project_key_of(project_id: str) -> str:
    """project_key of one id on the driver."""
    return re.sub(r"\.git$", "", re.sub(r"^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$", "", project_id).lower())


#: Columns whose values are compared in canonical form.
_CANONICAL = {"project_id": project_key, "path": path_key}


def keyed(df: DataFrame, *names: str) -> DataFrame:
    """With a column `_k_name` beside each of the columns: its canonical form, or its value."""
    return df.withColumns({f"_k_{n}": _CANONICAL[n](n) if n in _CANONICAL else F.col(n) for n in names})


def key_names(*names: str) -> list[str]:
    return [f"_k_{n}" for n in names]


#: The same in DuckDB's SQL, to be filled with a column's name.
PROJECT_KEY_SQL = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '\.git$', '')"
PATH_KEY_SQL = r"regexp_replace(regexp_replace(replace({0}, '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"
