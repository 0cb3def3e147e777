"""Evaluation texts leaking into training text: spaced-seed hashing.

A seed is a fixed mask over a window of consecutive words: at its ones the words enter the hash, at
its zeros any word may stand. The hashes of all windows of the test items are joined with those of
the corpus; around every hit the overlap of document and item is verified on the words themselves and
extended to both sides. Any run of `span` equal words matches every mask, and a run with some words
replaced still matches a mask whose zeros fall on them, so passages with substitutions are found too.

Both sides are tables and meet in shuffle joins, so neither their number nor their size is bounded by
the driver. What is sent to the executors is a bitmap of fixed size, 2 to the power of BITS bits, of the
items' hash prefixes: it keeps nearly all windows of the corpus from the shuffle while the items are few,
and as they grow it lets more of them pass, which the join then drops. The corpus is read once. Joins on
hashes and items are salted, so a passage that a third of all documents holds is spread over tasks.

Defined results: words are maximal runs of letters and digits without letter case; what stands
between them does not count. NULL, blank and shorter texts match nothing; texts of any length are
read whole; rows that stand twice count once; documents of one id each give their own rows; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselite.operators.references import looked_up
from tesselite.session import materialize

WORD = re.compile(r"[^\W_]+")
#: Masks of 13 words: the first compares nine, the others let single words and a pair differ.
SEEDS = ("1110110101011", "1101011011101", "1011101100111")
#: The bitmap of hash prefixes has 2 ** BITS bits: 2 MB.
BITS = 24
#: Words that are hashed at once.
BLOCK = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_ids(words: list[str], known: dict[str, int]) -> np.ndarray:
    out = np.empty(len(words), "u8")
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each window of len(mask) words."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, "u8")
    h = np.full(n, np.uint64(len(mask)), "u8")
    for i, bit in enumerate(mask):
        if bit == "1":
            h = _mix(h * _ODD + ids[i : i + n])
    return h


def _windows(words: list[np.ndarray], masks: tuple[str, ...], seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and hash of the windows of all masks, in order of text; where `seen` is given, only of those whose prefix is in it."""
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate(words)
    text = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows, places, hashes = [], [], []
    for m, mask in enumerate(masks):
        h = seed_hashes(flat, mask) + np.uint64(m)
        n = len(h)
        keep = at[:n] + len(mask) <= sizes[text[:n]]  # within one text
        if seen is not None:
            keep &= seen[h >> np.uint64(64 - BITS)]
        k = np.flatnonzero(keep)
        rows.append(text[k]), places.append(at[k]), hashes.append(h[k])
    row, place, h = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(row, kind="stable")
    return row[order], place[order], h[order]


def _hashed(masks: tuple[str, ...], bitmap):
    """Of every text its words and windows; where a bitmap is given, only texts with a window in it."""

    def blocks(batch: pa.RecordBatch, known: dict[str, int]) -> Iterator[tuple[list, list, list]]:
        keys, ids, words, n = [], [], [], 0
        for key, i, text in zip(*(c.to_pylist() for c in batch.columns)):
            if len(known) > 500_000:
                known.clear()
            w = word_ids(words_of(text), known)
            keys.append(key), ids.append(i), words.append(w)
            n += len(w)
            if n >= BLOCK:
                yield keys, ids, words
                keys, ids, words, n = [], [], [], 0
        if keys:
            yield keys, ids, words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        seen = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, "u1"), bitorder="little").astype(bool)
        for batch in batches:
            for keys, ids, words in blocks(batch, known):
                row, place, h = _windows(words, masks, seen)
                kept = np.unique(row) if seen is not None else np.arange(len(keys))
                ends = np.searchsorted(row, kept, "right")
                offsets = pa.array(np.r_[0, ends].astype("i4"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in kept], pa.int64()), pa.array([ids[i] for i in kept], pa.int64()), pa.array([words[i].tobytes() for i in kept], pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(h.view("i8"))), pa.ListArray.from_arrays(offsets, pa.array(place.astype("i4")))],
                    names=["key", "id", "words", "hashes", "places"],
                )

    return run


HASHED = "key long, id long, words binary, hashes array<long>, places array<int>"


def _seeds(hashed: DataFrame) -> DataFrame:
    """hash, key, place of every window."""
    return hashed.select("key", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(F.col("s.hashes").alias("hash"), "key", F.col("s.places").alias("place"))


def prefix_bitmap(seeds: DataFrame) -> bytes:
    """2 ** BITS bits, of which those of the seeds' hash prefixes are set; gathered in parts of 32,768 bits."""
    prefix = F.shiftrightunsigned("hash", 64 - BITS)
    parts = seeds.groupBy(F.shiftright(prefix, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(prefix.bitwiseAND(F.lit(32767))).alias("bits"))
    out = bytearray(2 ** (BITS - 3))
    for r in parts.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def longest_run(equal: np.ndarray) -> int:
    """Length of the longest run of True."""
    edges = np.flatnonzero(np.diff(np.r_[False, equal, False].astype("i1")))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def best_stretch(equal: np.ndarray, tolerance: float) -> tuple[int, int]:
    """Length and equal words of the longest stretch around hits in which at most `tolerance` of the words differ.

    Equal words count `tolerance`, others `tolerance - 1`, in thousandths, so that sums are exact; the stretch
    of greatest sum is the one extended as far as it pays, of equal ones the first.
    """
    if not len(equal):
        return 0, 0
    gain = round(1000 * tolerance)
    total = np.r_[0, np.cumsum(np.where(equal, gain, gain - 1000))]
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    begin = int(np.argmin(total[: end + 1]))
    return end - begin, int(equal[begin:end].sum())


def _verified(run_words: int, tolerance: float):
    """The overlap of a document and an item on the diagonals (place in the document less that in the item) that seeds hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, a, b, diagonals in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "words", "item", "diagonals"))):
                w, v = np.frombuffer(a, "u8"), np.frombuffer(b, "u8")
                longest, stretch = 0, (0, 0)
                for d in diagonals:
                    begin, end = max(0, d), min(len(w), len(v) + d)
                    equal = w[begin:end] == v[begin - d : end - d]
                    longest, stretch = max(longest, longest_run(equal)), max(stretch, best_stretch(equal, tolerance))  # each over all diagonals
                if longest >= run_words or stretch[0] >= run_words:
                    out.append((doc, item, len(v), longest, *stretch))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "item_words", "run", "stretch", "stretch_equal"])

    return run


def overlaps(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    run_words: int = 13,
    tolerance: float = 0.2,
    masks: tuple[str, ...] = SEEDS,
    salts: int = 8,
) -> DataFrame:
    """doc_id, item_id, item_words, run, stretch, stretch_equal: pairs with an overlap of at least run_words words.

    run: the longest run of equal words. stretch: the longest stretch in which at most `tolerance` of
    the words were replaced; it may lie on another diagonal than the run. Every pair with a run of len(mask) equal words is found.
    """
    spark = documents.sparkSession

    def hashed(rows: DataFrame, name: str, bitmap=None) -> DataFrame:
        texts = rows.select(F.col(name).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
        out = texts.select(F.xxhash64("id", "text").alias("key"), "id", "text").mapInArrow(_hashed(masks, bitmap), HASHED)
        return materialize(out, name)

    asked = hashed(items, item_id).dropDuplicates(["key"])
    wanted = _seeds(asked)
    found = hashed(documents, doc_id, spark.sparkContext.broadcast(prefix_bitmap(wanted))).dropDuplicates(["key"])
    copies = wanted.select("hash", F.col("key").alias("item_key"), F.col("place").alias("item_place"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    hits = _seeds(found).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts))).join(copies, ["hash", "salt"])
    pairs = hits.groupBy("key", "item_key").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("diagonals"))
    both = looked_up(pairs, asked.select(F.col("key").alias("item_key"), F.col("id").alias("item_id"), F.col("words").alias("item")), "item_key", salts)
    whole = both.join(found.select("key", F.col("id").alias("doc_id"), "words"), "key")
    schema = "doc_id long, item_id long, item_words long, run long, stretch long, stretch_equal long"
    return whole.select("doc_id", "item_id", "words", "item", "diagonals").mapInArrow(_verified(run_words, tolerance), schema).distinct()


def leaked_items(pairs: DataFrame) -> DataFrame:
    """item_id, n_documents, longest_run, share: the items that leaked, in how many documents, and how much of the item at most."""
    return pairs.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_documents"), F.max("run").alias("longest_run"), F.round(F.max(F.col("run") / F.col("item_words")), 6).alias("share")
    )
