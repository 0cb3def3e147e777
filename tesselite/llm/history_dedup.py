"""New batches against all history: shards of navigable small-world graphs.

A batch is a day of entries in order of time, then id; a run takes the batches that came since the last
one. Exact repeats (of one kind, the same words of a fact or the same code but for white space) are one
class, named by a digest; only the first entry of each class is looked at further. Facts become vectors,
sums of a fixed random sign vector for each distinct word, whose cosine approximates the share of common
words.

HistoryIndex keeps the accepted entries in shards: by content (the nearest of a few pivots, fitted on a
bounded sample) and within that by run. Every shard has its own graph, built by inserting batches of
vectors: each is linked to the nearest ones that a beam search from fixed entry points finds. The beam of
a shard is doubled until it finds `target` of what an exhaustive search finds for a sample of the shard.
An entry is searched for in the shards of its nearest pivot and of those that are hardly farther (`margin`);
the beam of a query is doubled as
long as everything in it is near, so no number of near copies is cut off. What the beam brings is
reranked exactly on the words.

A run goes in three steps, and writes nothing but what is new:

* classes that history holds are repeats; the others' first entries are searched for in history's shards,
  all of whose entries are accepted and earlier, so the earliest partner found there decides;
* what is left is searched for in shards of its own. An entry is a repeat if an accepted earlier one is its
  partner, and repeats are not accepted; that is decided for all at once in rounds over pairs: whoever has
  an accepted earlier partner is rejected, and whoever has none but rejected ones is accepted. Of a shard's
  partners an entry gets at most the `listed` earliest, so a family of near copies gives a number of pairs in
  proportion to its size; where these don't decide, it is searched for again, without the rejected ones;
* the accepted entries become a shard for each cell, beside the others. A manifest, written last, names the
  folders that hold; a run that breaks off leaves the manifest before it in force.

compact() merges shards that are not full, and when the index has outgrown its pivots, fits new ones and
builds all shards anew; it is called on a schedule (`every` runs), not by each batch.

Defined results: NULL and blank texts, and facts without a letter or digit, repeat nothing and are
repeated by nothing; a row delivered twice is one entry; NULL times come first within a run; ties go to the
smaller id; an empty table gives no rows. Other columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselite.session import materialize, shared_path

DIM = 128
FIRST = -(2**62)  # the time of entries without one
SPREAD = 4  # nodes that a search expands at once
ENTRIES = 1024  # nodes of a shard that a search begins with, of which the nearest stay in the beam


# --- vectors ---------------------------------------------------------------------------------------


def _signs(h: np.ndarray) -> np.ndarray:
    """A fixed vector of DIM signs for each word hash."""
    h = h.view("u8")
    parts = []
    for k in range(DIM // 64):
        x = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64((0xD1B54A32D192ED03 * (k + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        parts.append(x ^ (x >> np.uint64(31)))
    bits = np.unpackbits(np.stack(parts, 1).view("u1"), axis=1)
    return bits.astype("f4") * 2 - 1


def embed(words: list[np.ndarray]) -> np.ndarray:
    """Unit vectors of sets of word hashes; no set is empty."""
    out = np.empty((len(words), DIM), "f4")
    for s in range(0, len(words), 512):
        part = words[s : s + 512]
        known, at = np.unique(np.concatenate(part), return_inverse=True)
        starts = np.cumsum([0, *map(len, part[:-1])])
        out[s : s + 512] = np.add.reduceat(_signs(known)[at], starts, axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


# --- a shard's graph -------------------------------------------------------------------------------


class Graph:
    """A navigable small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, links: np.ndarray | None = None, beam: int = 32, degree: int = 16):
        self.v, self.beam, self.degree = np.ascontiguousarray(vectors, "f4"), beam, degree
        self.links = np.full((len(vectors), 2 * degree), -1, "i4") if links is None else links
        if links is None:
            self._build()

    def _build(self, batch: int = 256) -> None:
        """Insert in order: each batch is linked to what a search among the earlier ones finds, and among itself.

        The links a node made when it came stay, so what was reachable stays so; of those that others made to
        it the nearest are kept.
        """
        for s in range(0, len(self.v), batch):
            new = np.arange(s, min(s + batch, len(self.v)))
            sims = np.tril(self.v[new] @ self.v[new].T + 4, -1) - 4  # of the batch only those before
            ids = np.tile(new, (len(new), 1))
            if s:
                found, near = self.search(self.v[new], 2 * self.beam, s)
                ids, sims = np.concatenate([found, ids], 1), np.concatenate([near, sims], 1)
            keep = min(self.degree, ids.shape[1])
            best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            ids = np.where(sims > -2, ids, -1)
            self.links[new, :keep] = ids
            a, c = np.nonzero(ids >= 0)
            self._link_back(ids[a, c], new[a], sims[a, c])

    def _link_back(self, to: np.ndarray, node: np.ndarray, sim: np.ndarray) -> None:
        """Links of `to` back to `node`: of old and new ones the nearest stay."""
        if not len(to):
            return
        own = np.unique(to)
        old = self.links[own, self.degree :]
        r, c = np.nonzero(old >= 0)
        before = np.einsum("nd,nd->n", self.v[own[r]], self.v[old[r, c]])
        to, node, sim = np.concatenate([own[r], to]), np.concatenate([old[r, c], node]), np.concatenate([before, sim])
        order = np.lexsort((-sim, to))
        to, node = to[order], node[order]
        place = np.arange(len(to)) - np.searchsorted(to, to, "left")
        kept = place < self.degree
        self.links[own, self.degree :] = -1
        self.links[to[kept], self.degree + place[kept]] = node[kept]

    def search(self, q: np.ndarray, beam: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and cosines of the best nodes found for each query among the first `size`; all queries walk in step."""
        n = len(self.v) if size is None else size
        beam = min(max(beam, SPREAD), max(n, SPREAD))
        entry = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype("i8"))
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, entry], seen[:, n] = True, True
        ids = np.tile(entry, (len(q), 1))
        sim = (q @ self.v[entry].T).astype("f4")
        if ids.shape[1] < beam:
            gap = beam - ids.shape[1]
            ids, sim = np.pad(ids, ((0, 0), (0, gap)), constant_values=-1), np.pad(sim, ((0, 0), (0, gap)), constant_values=-9)
        done = ids < 0
        while True:
            if ids.shape[1] > beam:
                best = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
                ids, sim, done = (np.take_along_axis(a, best, 1) for a in (ids, sim, done))
            open_ = np.where(done, np.float32(-9), sim)
            pick = np.argpartition(-open_, SPREAD - 1, axis=1)[:, :SPREAD]
            live = np.take_along_axis(open_, pick, 1) > -9
            if not live.any():
                return ids, sim
            now = np.where(live, np.take_along_axis(ids, pick, 1), 0)
            np.put_along_axis(done, pick, True, 1)
            near = self.links[now].astype("i8")
            near = np.where(live[:, :, None] & (near >= 0) & (near < n), near, n).reshape(len(q), -1)
            near = np.sort(np.where(seen[rows, near], n, near), 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            seen[rows, near] = True
            width = int((near < n).sum(1).max())
            if not width:
                continue
            near = np.sort(near, 1)[:, :width]
            new = near < n
            value = np.einsum("qd,qmd->qm", q, self.v[np.minimum(near, n - 1)])
            ids = np.concatenate([ids, np.where(new, near, -1)], 1)
            sim = np.concatenate([sim, np.where(new, value, np.float32(-9))], 1)
            done = np.concatenate([done, ~new], 1)

    def tune(self, floor: float, target: float, like: float = 0.9, sample: int = 1024, most: int = 256, seed: int = 7) -> int:
        """The least doubled beam that finds `target` of the nodes with cosine >= floor that an exhaustive search finds for a sample of queries.

        A query is a node moved in a random direction until its cosine with the node is `like`: a shard of
        accepted entries holds no near copies that could serve. A graph that needs a beam of more than `most` is
        searched exhaustively, which is faster then.
        """
        rng = np.random.default_rng(seed)
        at = rng.permutation(len(self.v))[:sample]
        off = rng.standard_normal((len(at), self.v.shape[1])).astype("f4")
        off -= np.einsum("nd,nd->n", off, self.v[at])[:, None] * self.v[at]
        asked = like * self.v[at] + math.sqrt(1 - like**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
        rows, wanted = np.nonzero(asked @ self.v.T >= floor)
        while len(rows):
            crowd = np.bincount(rows, minlength=len(at))[rows]
            found, _ = self.search(asked, self.beam)
            hit = (found[rows] == wanted[:, None]).any(1)
            # of a crowd larger than the beam only as much as the beam holds can be found; near() widens it for such
            if (hit / np.minimum(1.0, self.beam / crowd)).sum() >= target * len(rows):
                break
            self.beam *= 2
            if self.beam > most:
                self.beam = len(self.v)
                break
        return self.beam

    def near(self, q: np.ndarray, floor: float) -> Iterator[tuple[int, np.ndarray]]:
        """For each query its nodes with cosine >= floor; a beam that is full of them is doubled, in the end to the whole shard."""
        for s in range(0, len(q), 128):
            left, beam = np.arange(s, min(s + 128, len(q))), self.beam
            while len(left):
                if beam >= len(self.v) // 2:
                    sims = q[left] @ self.v.T
                    yield from ((int(i), np.flatnonzero(x >= floor)) for i, x in zip(left, sims))
                    break
                ids, sims = self.search(q[left], beam)
                good = (sims >= floor) & (ids >= 0)
                full = good.all(1)
                yield from ((int(i), x[g]) for i, x, g in zip(left[~full], ids[~full], good[~full]))
                left, beam = left[full], 2 * beam


# --- Spark -----------------------------------------------------------------------------------------

NODE = "key string, at long, id long, words binary, v binary"
INDEX = f"shard string, cell int, pos int, {NODE}, links binary, beam int"


def classes(entries: DataFrame, *, id_col: str = "id", text_col: str = "text", kind_col: str = "entry_type", time_col: str = "created_at") -> DataFrame:
    """key, id, at, words: every entry with the digest of its class; words: sorted hashes of a fact's distinct words, NULL for code."""
    text = F.col("text")
    fact = F.col("kind") != "code"
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = entries.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(kind_col), F.lit("")).alias("kind"),
        F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(FIRST)).alias("at"),
    ).where(F.col("id").isNotNull() & text.isNotNull())
    rows = rows.withColumn("words", F.when(fact, F.sort_array(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))))))
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    key = F.when(fact, F.when(F.size("words") > 0, F.concat(F.lit("f"), F.md5(F.array_join(F.transform("words", lambda w: w.cast("string")), ","))))).otherwise(
        F.when(F.length(bare) > 0, F.concat(F.lit("c"), F.md5(bare)))
    )
    return rows.select(key.alias("key"), "id", "at", "words").where(F.col("key").isNotNull())


def _node_batches(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, margin: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("words")
        flat, ends = lists.flatten().to_numpy(), np.cumsum([len(x) for x in lists])
        words = np.split(flat, ends[:-1])
        v = embed(words)
        near = v @ pivots.T
        order = np.argsort(-near, axis=1, kind="stable").astype("i4")
        n = (near >= near.max(1, keepdims=True) - margin).sum(1)
        cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype("i4")), pa.array(np.concatenate([o[:k] for o, k in zip(order, n)])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("at"), batch.column("id"), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary()), cells],
            names=["key", "at", "id", "words", "v", "cells"],
        )


def nodes(firsts: DataFrame, pivots: np.ndarray, margin: float) -> DataFrame:
    """The first entries of the classes of facts with vector and cells: the nearest pivot and those whose cosine is at most `margin` less."""
    return firsts.mapInArrow(lambda batches: _node_batches(batches, pivots, margin), f"{NODE}, cells array<int>")


def fit_pivots(firsts: DataFrame, n: int, shard_rows: int, sample_rows: int = 4096, seed: int = 7) -> np.ndarray:
    """Pivots of about shard_rows nodes each, at most sample_rows / 8, by a few rounds of k-means on a bounded sample."""
    share = sample_rows / max(n, 1)
    sample = firsts if share >= 1 else firsts.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    lists = [np.array(r[0], "i8") for r in sample.select("words").limit(sample_rows).collect()]
    return pivots_of(embed(lists) if lists else np.zeros((0, DIM), "f4"), math.ceil(n / shard_rows), seed)


def pivots_of(v: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """At most k pivots of a sample of vectors, one for eight of them at most."""
    k = max(1, min(k, len(v) // 8))
    if k == 1:
        return np.ones((1, DIM), "f4")
    rng = np.random.default_rng(seed)
    centre = v[rng.permutation(len(v))[:k]]
    for _ in range(8):
        own = (v @ centre.T).argmax(1)
        centre = np.stack([v[own == c].mean(0) if (own == c).any() else centre[c] for c in range(k)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-6)
    return centre.astype("f4")


def _pruned(floor: float, target: float):
    """A shard without its rejected nodes: their links fall away and the beam is tuned anew; where more than a quarter goes, the graph is built anew."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos").combine_chunks()
        kept = ~np.array(group.column("rejected").to_pylist(), bool)
        v, links, n = np.stack(_read(group.column("v"), "f4")), np.stack(_read(group.column("links"), "i4")), int(kept.sum())
        place = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1).astype("i4")
        graph = Graph(v[kept], np.ascontiguousarray(place[links[kept]]), group.column("beam")[0].as_py()) if 4 * n >= 3 * len(kept) else Graph(v[kept])
        if n < len(kept) and n:
            graph.tune(floor, target)
        rows = group.filter(pa.array(kept))
        columns = [rows.column(c) for c in ("shard", "cell")] + [pa.array(range(n), pa.int32())] + [rows.column(c) for c in ("key", "at", "id", "words", "v")]
        columns += [pa.array([x.tobytes() for x in graph.links], pa.binary()), pa.array([graph.beam] * n, pa.int32())]
        return pa.table(columns, names=[c.split()[0] for c in INDEX.split(", ")])

    return run


def _cells(pivots: np.ndarray):
    """The nearest pivot of nodes that have their vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), "f4").reshape(-1, DIM)
            own = (v @ pivots.T).argmax(1).astype("i4")
            columns = [batch.column(c) for c in ("key", "at", "id", "words", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(own[:, None]), pa.list_(pa.int32()))], names=["key", "at", "id", "words", "v", "cells"])

    return run


def _read(column: pa.ChunkedArray, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def _build(floor: float, target: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending"), ("id", "ascending"), ("key", "ascending")]).combine_chunks()
        graph = Graph(np.stack(_read(group.column("v"), "f4")))
        graph.tune(floor, target)
        n = group.num_rows
        columns = [group.column(c) for c in ("shard", "cell")] + [pa.array(range(n), pa.int32())] + [group.column(c) for c in ("key", "at", "id", "words", "v")]
        columns += [pa.array([x.tobytes() for x in graph.links], pa.binary()), pa.array([graph.beam] * n, pa.int32())]
        return pa.table(columns, names=[c.split()[0] for c in INDEX.split(", ")])

    return run


def _common(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of the hashes of each of the others are among mine; all are sorted and distinct."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    starts = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat((mine[at] == flat).astype("i8"), starts)


FOUND = "key string, at long, id long, a_key string, a_at long, a_id long, more boolean"


def _search(floor: float, share: float, listed: int, history: bool):
    """Candidates of the shard's graph, reranked exactly: of each query the `listed` earliest partners that are not rejected, and whether there are more.

    history: everything in the shard comes before every query.
    """

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if shard.num_rows and queries.num_rows:
            shard = shard.sort_by("pos").combine_chunks()
            graph = Graph(np.stack(_read(shard.column("v"), "f4")), np.stack(_read(shard.column("links"), "i4")), shard.column("beam")[0].as_py())
            words, keys, ats, ids = _read(shard.column("words"), "i8"), *(shard.column(c).to_pylist() for c in ("key", "at", "id"))
            q_words, q_keys, q_ats, q_ids = _read(queries.column("words"), "i8"), *(queries.column(c).to_pylist() for c in ("key", "at", "id"))
            sizes, open_ = np.array([len(w) for w in words]), ~np.array(shard.column("rejected").to_pylist(), bool)
            # the shard in order of time, id and key
            place = np.empty(len(keys), "i8")
            place[sorted(range(len(keys)), key=lambda j: (ats[j], ids[j], keys[j]))] = np.arange(len(keys))
            for i, near in graph.near(np.stack(_read(queries.column("v"), "f4")), floor):
                mine, me = q_words[i], (q_ats[i], q_ids[i], q_keys[i])
                near = near[open_[near] & (np.minimum(sizes[near], len(mine)) >= share * np.maximum(sizes[near], len(mine)))]
                if len(near):
                    near = near[_common(mine, [words[j] for j in near]) >= share * np.maximum(sizes[near], len(mine)) - 1e-9]
                    near = near[np.argsort(place[near])]
                before = [j for j in near if history or (ats[j], ids[j], keys[j]) < me]
                out += [(me[2], me[0], me[1], keys[j], ats[j], ids[j], len(before) > listed) for j in before[:listed]]
                if not history:  # the other way round, should the later one's own search miss it
                    after = [j for j in near if (ats[j], ids[j], keys[j]) > me]
                    out += [(keys[j], ats[j], ids[j], me[2], me[0], me[1], False) for j in after[:listed]]
        cols = list(zip(*out)) if out else [[]] * 7
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


DAY = 86_400_000_000


def shard_plan(rows: DataFrame, shard_rows: int) -> DataFrame:
    """cell, day, first shard of each cell's days: days are compacted in order until a shard is full, larger days are split."""
    per_day = rows.groupBy("cell", F.floor(F.col("at") / F.lit(DAY)).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cell").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    plan = per_day.withColumn("segment", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(shard_rows)))
    return plan.withColumn("parts", F.ceil(F.col("n") / F.lit(shard_rows)).cast("int"))


def build_shards(rows: DataFrame, *, shard_rows: int, floor: float, target: float, tag: str = "s") -> DataFrame:
    """The index rows of all shards; rows: nodes with their cells."""
    placed = rows.withColumn("cell", F.col("cells")[0]).withColumn("day", F.floor(F.col("at") / F.lit(DAY)))
    plan = shard_plan(placed, shard_rows).select("cell", "day", "segment", "parts")
    part = F.pmod(F.xxhash64("key"), F.col("parts").cast("long"))
    named = placed.join(plan, ["cell", "day"]).withColumn("shard", F.concat_ws(":", F.lit(tag), "cell", "segment", part))
    return named.select("shard", "cell", "key", "at", "id", "words", "v").groupBy("shard").applyInArrow(_build(floor, target), INDEX)


def partners(index: DataFrame, queries: DataFrame, *, floor: float, share: float, listed: int, history: bool, rejected: DataFrame | None = None, block_rows: int = 8192) -> DataFrame:
    """FOUND rows: every query in the shards of its cells that begin before it, in blocks of queries. Only shards that some query asks are read."""
    shards = index.groupBy("shard", "cell").agg(F.min("at").alias("begin"))
    asked = queries.withColumn("cell", F.explode("cells")).drop("cells")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    plan = materialize(shards.join(blocks, "cell"), "plan")
    routed = asked.join(plan, "cell").where(F.lit(history) | (F.col("at") >= F.col("begin"))).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")))
    if rejected is None:
        marked = index.withColumn("rejected", F.lit(False))
    else:
        marked = index.join(rejected.select("key", F.lit(True).alias("_out")), "key", "left").withColumn("rejected", F.col("_out").isNotNull()).drop("_out")
    copies = marked.join(plan.select("shard", "blocks"), "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    left = copies.select("shard", "block", "pos", "key", "at", "id", "words", "v", "links", "beam", "rejected").groupBy("shard", "block")
    right = routed.select("shard", "block", "key", "at", "id", "words", "v").groupBy("shard", "block")
    return left.cogroup(right).applyInArrow(_search(floor, share, listed, history), FOUND)


def decided(found: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """key of those that are rejected (None: nobody), and of those that remain open: their listed partners are all rejected though there are more, or they wait for such a one.

    Rounds over the pairs: whoever is in no pair as the later one is accepted, and its partners are rejected.
    """
    # an open end stands for the partners that are not listed: it is neither accepted nor rejected
    left = found.select("key", "a_key").unionByName(found.where("more").select("key", F.lit(None).cast("string").alias("a_key"))).distinct()
    out: list[DataFrame] = []
    while True:
        later = left.select(F.col("key").alias("a_key")).distinct()
        now = materialize(left.where(F.col("a_key").isNotNull()).join(later, "a_key", "left_anti").select("key").distinct(), "rejected")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, out) if out else None, left.select("key").distinct()
        out.append(now)
        left = materialize(left.join(now, "key", "left_anti").join(now.withColumnRenamed("key", "a_key"), "a_key", "left_anti"), "undecided")


def _assign(members: DataFrame, firsts: DataFrame, target: Column, salts: int = 8) -> DataFrame:
    """id, repeat_of: every entry of a class but an accepted first one. firsts: key, id, n, and a target where the class repeats another."""
    many = firsts.where((F.col("n") > 1) | target.isNotNull())
    many = many.select("key", F.col("id").alias("first_id"), target.alias("target"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    # the salt spreads a class that holds a large part of all entries
    rows = members.select("key", "id", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).join(many, ["key", "salt"])
    out = rows.select("id", F.coalesce("target", "first_id").alias("repeat_of"))
    return out.where(F.col("id") != F.col("repeat_of")).distinct()


class HistoryIndex:
    """Shards of accepted entries in a folder that all executors share; one more for each run and cell, merged by compact()."""

    def __init__(self, spark: SparkSession, path: str, *, share: float = 0.8, floor: float = 0.67, shard_rows: int = 8192, margin: float = 0.04, target: float = 0.98, listed: int = 16):
        """share: of the distinct words of each that two facts have in common. floor: cosine below which a
        candidate can't reach that; the vectors' cosine is the words' up to a deviation of about 0.03. margin: by
        how much farther pivots may be whose shards are searched too; partners' pivots were within 0.05 in 99.9 %
        of all pairs with 4 pivots, in 99.4 % with 64."""
        self.spark, self.path, self.share, self.floor, self.shard_rows, self.margin, self.target, self.listed = spark, path.rstrip("/"), share, floor, shard_rows, margin, target, listed

    # --- the manifest

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The highest manifest whose success mark is there."""
        fs, at = self._fs(f"{self.path}/manifest")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max([0, *(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/manifest/{n}/_SUCCESS")[1]))])

    def _folders(self) -> dict[str, list[str]]:
        """Folders of the current manifest by kind: index, seen, pivots. One row for each run since the last compaction."""
        v = self.version()
        rows = self.spark.read.schema("kind string, folder string").parquet(f"{self.path}/manifest/v{v}").collect() if v else []
        return {k: sorted(r["folder"] for r in rows if r["kind"] == k) for k in ("index", "seen", "pivots")}

    def _commit(self, folders: dict[str, list[str]]) -> None:
        rows = [(k, f) for k, names in folders.items() for f in names]
        self.spark.createDataFrame(rows, "kind string, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{self.version() + 1}")

    def _read(self, names: list[str], schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else None

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def pivots(self) -> np.ndarray:
        """The pivots of the current manifest; one for everything before the first run."""
        names = self._folders()["pivots"]
        return self._pivots(names) if names else np.ones((1, DIM), "f4")

    def _pivots(self, names: list[str]) -> np.ndarray:
        rows = self._read(names, "cell int, v binary").orderBy("cell").collect()
        return np.stack([np.frombuffer(bytes(r["v"]), "f4") for r in rows])

    def _keep_pivots(self, pivots: np.ndarray) -> str:
        rows = [(i, bytearray(p.tobytes())) for i, p in enumerate(pivots)]
        return self._write(self.spark.createDataFrame(rows, "cell int, v binary").coalesce(1), "pivots")

    def index(self) -> DataFrame | None:
        """The accepted facts with their graphs."""
        return self._read(self._folders()["index"], INDEX)

    # --- runs

    def _graphs(self, rows: DataFrame, tag: str) -> DataFrame:
        return build_shards(rows, shard_rows=self.shard_rows, floor=(self.floor + self.share) / 2, target=self.target, tag=tag)

    def add(self, batch: DataFrame, **columns: str) -> DataFrame:
        """id, repeat_of of the batch's repeats, and the index grows by a shard of its accepted entries for each cell."""
        held, tag = self._folders(), f"b{self.version() + 1}"
        members = materialize(classes(batch, **columns), "batch")
        firsts = members.groupBy("key").agg(F.min(F.struct("at", "id")).alias("f"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words"))
        firsts = firsts.select("key", F.col("f.at").alias("at"), F.col("f.id").alias("id"), "n", "words")
        seen = self._read(held["seen"], "key string, first_id long")
        if seen is not None:
            firsts = firsts.join(seen.withColumnRenamed("first_id", "known"), "key", "left")
        else:
            firsts = firsts.withColumn("known", F.lit(None).cast("long"))
        firsts = materialize(firsts, "firsts")
        new = firsts.where(F.col("known").isNull())
        facts = new.where(F.col("words").isNotNull()).select("key", "at", "id", "words")
        pivots = self._pivots(held["pivots"]) if held["pivots"] else fit_pivots(facts, facts.count(), self.shard_rows)
        rows = materialize(nodes(facts, pivots, self.margin), "nodes")
        search = {"floor": self.floor, "share": self.share}
        targets = []
        if held["index"]:
            met = partners(self._read(held["index"], INDEX), rows, listed=1, history=True, **search)
            targets.append(materialize(met.groupBy("key").agg(F.min(F.struct("a_at", "a_id")).alias("t")).select("key", F.col("t.a_id").alias("target")), "met"))
        own = rows.join(targets[0].select("key"), "key", "left_anti") if targets else rows
        graphs = materialize(self._graphs(own, tag), "graphs")
        asked, rejected, pairs, more = own, None, [], []
        while True:
            found = materialize(partners(graphs, asked, listed=self.listed, history=False, rejected=rejected, **search), "partners")
            pairs.append(found.select("key", "a_key", "a_at", "a_id")), more.append(found.where("more").select("key"))
            out, waiting = decided(found)
            if out is not None:
                rejected = out if rejected is None else rejected.unionByName(out)
            if waiting.isEmpty():
                break
            # those whose listed partners did not decide are searched for again, without the rejected ones
            asked = own.join(waiting, "key", "left_semi")
        if rejected is not None:
            # of all that is known now the earliest accepted partner; whoever has partners that were not listed is asked once more
            unlisted = reduce(DataFrame.unionByName, more).distinct().join(rejected, "key", "left_semi")
            good = reduce(DataFrame.unionByName, pairs).join(unlisted, "key", "left_anti")
            if not unlisted.isEmpty():
                last = partners(graphs, own.join(unlisted, "key", "left_semi"), listed=1, history=False, rejected=rejected, **search)
                good = good.unionByName(last.select("key", "a_key", "a_at", "a_id"))
            good = good.join(rejected, "key", "left_semi").join(rejected.select(F.col("key").alias("a_key")), "a_key", "left_anti")
            targets.append(good.groupBy("key").agg(F.min(F.struct("a_at", "a_id")).alias("t")).select("key", F.col("t.a_id").alias("target")))
        none = self.spark.createDataFrame([], "key string, target long")
        targets = materialize(reduce(DataFrame.unionByName, targets, none), "targets")
        marked = graphs.join(targets.select("key", F.lit(True).alias("_out")), "key", "left").withColumn("rejected", F.col("_out").isNotNull()).drop("_out")
        grown = self._write(marked.groupBy("shard").applyInArrow(_pruned((self.floor + self.share) / 2, self.target), INDEX), "index")
        known = firsts.join(targets, "key", "left").select("key", "id", "n", F.coalesce("known", "target").alias("target"))
        here = self._write(firsts.where(F.col("known").isNull()).select("key", "id").join(targets, "key", "left").select("key", F.coalesce("target", "id").alias("first_id")), "seen")
        repeats = materialize(_assign(members, known, F.col("target")), "repeats")
        self._commit({"index": [*held["index"], grown], "seen": [*held["seen"], here], "pivots": held["pivots"] or [self._keep_pivots(pivots)]})
        return repeats

    def compact(self, sample_rows: int = 4096) -> None:
        """Merge the shards of a cell that are not full, oldest first, and rebuild their graphs; the folders of `seen` become one.

        Once the index has twice the rows that its pivots were made for, new pivots are fitted on a bounded
        sample of it and every shard is built anew; then a batch meets the shards of its nearest pivots only.
        """
        held = self._folders()
        index = self._read(held["index"], INDEX)
        if index is None:
            return
        pivots, n = self._pivots(held["pivots"]), index.count()
        node, names = ["key", "at", "id", "words", "v"], held["pivots"]
        if math.ceil(n / self.shard_rows) >= 2 * len(pivots):
            bucket = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
            rows = index.where(bucket < max(1, int(1_000_000 * sample_rows / n))).select("v").limit(sample_rows).collect()
            if rows:
                pivots = pivots_of(np.stack([np.frombuffer(bytes(r["v"]), "f4") for r in rows]), math.ceil(n / self.shard_rows))
                names = [self._keep_pivots(pivots)]
            small, kept = index.select(*node).mapInArrow(_cells(pivots), f"{NODE}, cells array<int>"), None
        else:
            sized = index.join(index.groupBy("shard").agg(F.count(F.lit(1)).alias("size")), "shard")
            small = sized.where(F.col("size") < self.shard_rows).select(*node, F.array("cell").alias("cells"))
            kept = sized.where(F.col("size") >= self.shard_rows).select(*index.columns)
        merged = self._graphs(small, f"c{self.version() + 1}")
        folders = {"index": [self._write(merged if kept is None else merged.unionByName(kept), "index")], "seen": [self._write(self._read(held["seen"], "key string, first_id long"), "seen")], "pivots": names}
        self._commit(folders)


def repeats(entries: DataFrame, *, days: int = 90, every: int = 2, time_col: str = "created_at", path: str | None = None, **options) -> DataFrame:
    """id, repeat_of: every entry that repeats an accepted earlier one, and the earliest such, found run by run.

    days: batches (days) that a run takes; the first run takes what has no time too. every: runs between two
    compactions. The result is that of single days, as a run keeps their order; only entries' times and ids count.
    """
    spark = entries.sparkSession
    names = {k: options.pop(k) for k in ("id_col", "text_col", "kind_col") if k in options}
    index = HistoryIndex(spark, path or shared_path(spark, "history"), **options)
    number = F.floor(F.datediff(F.col(time_col), F.lit("1970-01-01")) / F.lit(days))
    runs = [r[0] for r in entries.select(number.alias("r")).distinct().orderBy(F.col("r").asc_nulls_first()).collect()]
    kind = entries.schema[time_col].dataType

    def from_to(r: int | None) -> Column:
        if r is None:
            return F.col(time_col).isNull()
        first, end = (F.lit(str(dt.date(1970, 1, 1) + dt.timedelta(days=x * days))).cast(kind) for x in (r, r + 1))
        return (F.col(time_col) >= first) & (F.col(time_col) < end)

    out = []
    for i, r in enumerate(runs, 1):
        out.append(index.add(entries.where(from_to(r)), time_col=time_col, **names))
        if i % every == 0 and i < len(runs):
            index.compact()
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "id long, repeat_of long")
