"""Filling fixed-capacity windows with documents: multiway differencing.

Documents are sized in tokens of a public tokenizer, and those larger than a window are split into
full pieces and a rest, which is an item like any other. Items are dealt at random (by a hash of the
document) into groups of about `group_items`, which are packed independently: any two groups differ
only by chance, so at most one poorly filled window per group is lost, a share that does not grow.

In a group the items become partial partitions into k windows, and the two partitions with the largest
difference between their fullest and emptiest window are merged again and again, the fullest windows
of one with the emptiest of the other (Karmarkar-Karp differencing for many ways). k is the least that the
sum allows, so the windows come out near-equal and nearly full. Those that hold at most the capacity, and
lack at most `slack` of it, are done; the items of the others are differenced anew. Where no window is
done and some exceed the capacity, k rises. Every item gets its place by differencing.

Defined results: NULL, blank and token-less texts fill nothing and get no row; rows of one id
are one document, the longest of them; a NULL id gets no row; a capacity that is
NULL or below one is no window; texts of any length are sized whole; empty tables give no rows.
"""

from __future__ import annotations

import base64
import heapq
import math
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselite.session import materialize


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("window", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sized(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path or tokenizer_file())
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document with a text. vocabulary: a rank file; None is the public one."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0))
    return rows.mapInArrow(_sized(vocabulary), "doc_id long, n_tokens long").where(F.col("n_tokens") > 0)


# --- differencing ----------------------------------------------------------------------------------


def _merge(a: list, b: list, k: int) -> list:
    """Two partial partitions, each a sorted list of (sum, number, members) of its windows in use, of k windows in all."""
    if len(a) < len(b):
        a, b = b, a
    clash = len(a) + len(b) - k
    if clash <= 0:
        if len(b) == 1:
            insort(a, b[0])
            return a
        return sorted(a + b)
    # the windows not in use take the fullest of the other side; what is left meets the other way round
    low, a = a[:clash], a[clash:]
    joined = [(x[0] + y[0], x[1], (x[2], y[2])) for x, y in zip(reversed(low), b[:clash])]
    rest = b[clash:]
    if len(joined) + len(rest) <= 4:
        for w in (*joined, *rest):
            insort(a, w)
        return a
    return sorted(a + joined + rest)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The items of each of k windows, by largest-difference merging."""
    heap = []
    for i, s in enumerate(sizes):
        # with one window the difference is the sum itself
        heap.append((-s, i, [(s, i, i)]))
    heapq.heapify(heap)
    n = len(sizes)
    k = max(k, 1)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        m = _merge(a, b, k)
        spread = m[-1][0] - (m[0][0] if len(m) == k else 0)
        heapq.heappush(heap, (-spread, n, m))
        n += 1
    windows = []
    for _, _, members in heap[0][2] if heap else []:
        items, stack = [], [members]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        windows.append(items)
    return windows


def fill(sizes: list[int], capacity: int, slack: float = 0.05) -> list[list[int]]:
    """Windows of at most `capacity`; every item is in one, and none is larger than that. sizes: largest first."""
    out, left, more = [], list(range(len(sizes))), 0
    while left:
        own = [sizes[i] for i in left]
        k = math.ceil(sum(own) / capacity) + more
        windows = [w for w in difference(own, k) if w]
        sums = [sum(own[i] for i in w) for w in windows]
        if max(sums) <= capacity:
            return out + [[left[i] for i in w] for w in windows]
        done = [w for w, s in zip(windows, sums) if (1 - slack) * capacity <= s <= capacity]
        if done:
            placed = {i for w in done for i in w}
            out += [[left[i] for i in w] for w in done]
            left, more = [j for i, j in enumerate(left) if i not in placed], 0
        else:
            more += max(1, k // 200)
    return out


def _pack(group: pa.Table) -> pa.Table:
    group = group.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    window, capacity, part = (group.column(c)[0].as_py() for c in ("window_id", "capacity", "part"))
    sizes = group.column("n_tokens").to_pylist()
    number = [0] * len(sizes)
    for n, items in enumerate(fill(sizes, capacity)):
        for i in items:
            number[i] = n
    filling = [f"{window}-{part}-{n}" for n in number]
    return pa.table({"window_id": group.column("window_id"), "filling": pa.array(filling, pa.string()), "doc_id": group.column("doc_id"), "piece": group.column("piece"), "n_tokens": group.column("n_tokens")})


def fillings(
    documents: DataFrame,
    windows: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    window_id: str = "window_id",
    capacity: str = "capacity_tokens",
    vocabulary: str | None = None,
    group_items: int = 4000,
) -> DataFrame:
    """window_id, filling, doc_id, piece, n_tokens: for each window, which document (or piece of an oversized one) goes into which filling."""
    spark = documents.sparkSession
    counted = token_counts(documents, doc_id=doc_id, text=text, vocabulary=vocabulary)
    sized = materialize(counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "sizes")
    # the windows are a stated list: each row of it packs all documents
    kinds = [(w, c) for w, c in windows.select(F.col(window_id).cast("long"), F.col(capacity).cast("long")).distinct().toLocalIterator() if w is not None and c is not None and c >= 1]
    schema = "window_id long, filling string, doc_id long, piece int, n_tokens long"
    if not kinds:
        return spark.createDataFrame([], schema)
    asked = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("window_id"), F.lit(c).cast("long").alias("capacity")) for w, c in kinds])).alias("w")
    rows = sized.select("doc_id", "n_tokens", asked).select("doc_id", "n_tokens", "w.*")
    last = F.ceil(F.col("n_tokens") / F.col("capacity")) - 1
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    here = F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity"))
    whole = pieces.where(here == F.col("capacity"))
    alone = whole.select("window_id", F.concat_ws("-", "window_id", F.lit("full"), "doc_id", "piece").alias("filling"), "doc_id", F.col("piece").cast("int").alias("piece"), F.col("capacity").alias("n_tokens"))
    rest = pieces.where(here < F.col("capacity")).select("window_id", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), here.alias("n_tokens"))
    parts = max(1, math.ceil(sized.count() / group_items))
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    packed = dealt.groupBy("window_id", "part").applyInArrow(_pack, schema)
    return alone.unionByName(packed)


def usage(filled: DataFrame, windows: DataFrame, *, window_id: str = "window_id", capacity: str = "capacity_tokens") -> DataFrame:
    """window_id, n_fillings, n_tokens, used: fillings, tokens in them, and the share of their room that is used."""
    sums = filled.groupBy("window_id").agg(F.countDistinct("filling").alias("n_fillings"), F.sum("n_tokens").alias("n_tokens"))
    room = windows.select(F.col(window_id).cast("long").alias("window_id"), F.col(capacity).alias("capacity")).distinct()
    return sums.join(room, "window_id").select("window_id", "n_fillings", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_fillings") * F.col("capacity")), 6).alias("used"))
