"""Tags: a JSON array of strings in a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselite.functions.text import col, stripped


def decode(tags: Column | str) -> Column:
    """The tags of a JSON array; NULL, bad JSON or anything but an array gives none, blank tags are dropped."""
    parsed = F.from_json(col(tags), "array<string>")
    kept = F.filter(F.coalesce(parsed, F.array().cast("array<string>")), lambda t: F.coalesce(stripped(t), F.lit("")) != "")
    # a lone value would be read as an array of one
    return F.when(F.ltrim(col(tags)).startswith("["), kept).otherwise(F.array().cast("array<string>"))


def encode(tags: Column | str) -> Column:
    """JSON of the trimmed tags, blanks dropped, the first of equal ones kept; NULL if none is left."""
    kept = F.array_distinct(F.filter(F.transform(col(tags), stripped), lambda t: t != ""))
    return F.when(F.size(kept) > 0, F.to_json(kept))


def overlap(tags: Column | str, wanted: Sequence[str] | None) -> Column:
    """Whether a stored tag is wanted; no wanted tag, or only blank ones, lets every row pass."""
    own = [w.strip() for w in wanted or () if w.strip()]
    if not own:
        return F.lit(True)
    return F.arrays_overlap(F.transform(decode(tags), stripped), F.array(*[F.lit(w) for w in own]))
