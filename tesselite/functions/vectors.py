"""Vector columns: products, norms, a deterministic text embedder and scalar codes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselite.functions.text import col

HASH_DIM = 16


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision; NULL if a length differs."""
    a, b = col(a), col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, where it would be computed anew at each of its places."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision, in one pass; NULL for a NULL, zero or NaN vector or another length."""
    a, b = col(a), col(b)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    sums = F.aggregate(
        pairs, zero, lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy")),
        lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / F.sqrt(s["xx"] * s["yy"])),
    )
    return F.when(F.size(a) == F.size(b), let(sums, lambda v: F.when(~F.isnan(v), v)))


def hash_embedding(text: Column | str) -> Column:
    """Unit vector of the first bytes of the text's SHA-256; for tests and offline use in place of a model."""
    digest = F.sha2(col(text).cast("binary"), 256)
    pairs = F.slice(F.regexp_extract_all(digest, F.lit("[0-9a-f]{2}"), F.lit(0)), 1, HASH_DIM)
    raw = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("double"))
    sized = let(raw, lambda r: F.struct(r.alias("r"), F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    return let(sized, lambda v: F.transform(v["r"], lambda x: x / v["n"]))


def hash_embed(text: str) -> list[float]:
    """The same for one text on the driver."""
    raw = list(hashlib.sha256(text.encode()).digest()[:HASH_DIM])
    norm = math.sqrt(sum(x * x for x in raw))
    return [x / norm for x in raw]


def codes(vector: Column | str, bits: int = 4) -> Column:
    """Scalar codes of 2**bits steps over [-1, 1] for each coordinate."""
    top = 2**bits - 1
    return F.transform(col(vector), lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1.0) / 2.0 * top + 0.5), F.lit(0)), F.lit(top)).cast("int"))


def decoded(code: Column | str, bits: int = 4) -> Column:
    """The middle values that scalar codes stand for."""
    return F.transform(col(code), lambda c: c.cast("double") / float(2**bits - 1) * 2.0 - 1.0)


def packed(code: Column | str, bits: int = 4) -> Column:
    """Codes as bytes, two to a byte up to four bits, for storage; an odd last one is filled up with a zero."""
    digits = F.array_join(F.transform(col(code), lambda c: F.lpad(F.hex(c.cast("long")), 1 if bits <= 4 else 2, "0")), "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def unpacked(code: Column | str, bits: int = 4) -> Column:
    """The codes of packed bytes."""
    return F.transform(F.regexp_extract_all(F.hex(col(code)), F.lit("." if bits <= 4 else ".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def batch_embedder(encode: Callable[[list[str]], object]) -> Callable[[Column], Column]:
    """A column function of a model that embeds a list of texts at once, in Arrow batches; vectors come out with length one.

    A NULL text has no vector. The model should be loaded inside `encode`, so that each worker has its own.
    """

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        import numpy as np

        vectors: list = [None] * len(texts)
        there = [i for i, t in enumerate(texts) if t is not None]
        if there:
            rows = np.asarray(encode([texts.iloc[i] for i in there]), "f4")
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            for i, row in zip(there, rows):
                vectors[i] = row
        return pd.Series(vectors, index=texts.index, dtype=object)

    return run
