"""Text columns: tokens, Unicode trimming, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token starts with an ASCII letter or underscore; what follows may be any letter, digit or underscore.
TOKEN = r"[a-zA-Z_][\p{L}\p{N}_]*"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens in order; NULL for NULL."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))


def document_text(symbol: Column | str, text: Column | str, sep: str = " ") -> Column:
    """A symbol, where there is one, before the text; both count for length. Embedded texts have a line feed between them."""
    symbol = col(symbol)
    return F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(symbol, F.lit(sep), F.coalesce(col(text), F.lit("")))).otherwise(col(text))


def stripped(text: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")
