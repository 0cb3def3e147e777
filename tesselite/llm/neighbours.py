"""The most similar vectors of every vector: a forest of random-projection trees.

Fit: a bounded sample of the vectors (`sample_rows`) goes to the driver, where each tree splits it
again and again at the median of the projection on the difference of two random members. Every
vector is then indexed. Search: all trees of a vector share one priority queue; the entry of a node
is how far the vector would have to move to fall into it, and the first leaves of the queue are
visited. How many is measured on the sample: as many as bring `target` of the k nearest of some of its
vectors, which an exhaustive search within the sample tells. Whoever seeks near copies only (a high
min_cosine) can do with fewer and gives `visits`, and `more` for each level below LEVEL, since every
further split parts some pairs. The queue is run for a whole batch at once: on each level only as many of the best nodes
can lead to these leaves, since a child is never nearer than its parent. In a leaf the cosines are
exact, and so is the ranking of what the leaves gave.

Exact copies are one row from the start: they share a key, hashed from the vector, meet in the leaves
once per batch, and are expanded at the end, each row to at most k partners. So a vector that a third
of all rows share costs a leaf a few rows. Splits at medians keep leaves even; trees have at least
LEAST levels, and a leaf holds about `leaf_rows` vectors at any larger input up to `sample_rows / 8` leaves.

Defined results: NULL, zero, NaN or infinite vectors and those of another length have no neighbours
and are nobody's; rows delivered twice count once; ties go to the smaller id; an empty table gives no
rows. Columns beside id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1024
#: The depth up to which `visits` leaves are enough.
LEVEL = 6
#: Levels of the trees at least, where the sample can be split so often.
LEAST = 3


class Forest:
    """Trees as arrays: planes[level] is (trees, 2**level, dim), offsets[level] (trees, 2**level)."""

    def __init__(self, planes: list[np.ndarray], offsets: list[np.ndarray], trees: int):
        self.planes, self.offsets, self.trees, self.depth = planes, offsets, trees, len(planes)

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        planes = [np.zeros((trees, 2**level, dim), "f4") for level in range(depth)]
        offsets = [np.zeros((trees, 2**level), "f4") for level in range(depth)]
        for t in range(trees):
            members = [np.arange(len(sample))]
            for level in range(depth):
                split = []
                for node, rows in enumerate(members):
                    plane = rng.standard_normal(dim)
                    if len(rows) > 1:
                        a, b = sample[rng.choice(rows, 2, replace=False)]
                        plane = a - b if np.abs(a - b).max() > 1e-6 else plane
                    plane = (plane / np.linalg.norm(plane)).astype("f4")
                    at = sample[rows] @ plane
                    cut = np.float32(np.median(at)) if len(rows) else np.float32(0)
                    planes[level][t, node], offsets[level][t, node] = plane, cut
                    split += [rows[at <= cut], rows[at > cut]]
                members = split
        return cls(planes, offsets, trees)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through all trees."""
        nodes = np.zeros((len(x), self.trees), "i8")
        for level in range(self.depth):
            for t in range(self.trees):
                p, o = self.planes[level][t, nodes[:, t]], self.offsets[level][t, nodes[:, t]]
                nodes[:, t] = 2 * nodes[:, t] + (np.einsum("qd,qd->q", x, p) > o)
        return nodes + np.arange(self.trees) * 2**self.depth

    def visited(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first `visits` leaves of the queue that the trees share, the own leaf of each tree first."""
        n = len(x)
        tree = np.tile(np.arange(self.trees), (n, 1))
        node, near = np.zeros((n, self.trees), "i8"), np.zeros((n, self.trees), "f4")
        for level in range(self.depth):
            p, o = self.planes[level][tree, node], self.offsets[level][tree, node]
            d = np.einsum("qd,qmd->qm", x, p) - o
            right = (d > 0).astype("i8")
            node = np.concatenate([2 * node + right, 2 * node + 1 - right], 1)
            near = np.concatenate([near, np.maximum(near, np.abs(d))], 1)
            tree = np.concatenate([tree, tree], 1)
            if node.shape[1] > visits:
                first = np.argpartition(near, visits - 1, axis=1)[:, :visits]
                node, near, tree = (np.take_along_axis(a, first, 1) for a in (node, near, tree))
        return node + tree * 2**self.depth


def visits_for(forest: Forest, x: np.ndarray, k: int, target: float, queries: int = 512, rows: int = 16_384, seed: int = 7) -> int:
    """The leaves a vector must visit to meet `target` of its k nearest, measured on at most `queries` of at most `rows` vectors of a sample.

    A pair meets if either visits the other's leaf. In a sample neighbours lie farther off than in the whole, so the whole is met at least as well.
    """
    most = forest.trees * 2**forest.depth
    x = x[:rows]
    if len(x) <= k or forest.depth == 0:
        return most
    at = np.random.default_rng(seed).permutation(len(x))[:queries]
    sims = x[at] @ x.T
    sims[np.arange(len(at)), at] = -2
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    own = forest.own(x)
    a, b = np.repeat(at, k), near.ravel()
    visits = min(most, max(4, forest.trees))
    while visits < most:
        ends = [(forest.visited(x[p], visits)[:, :, None] == own[q][:, None, :]).any((1, 2)) for p, q in ((a, b), (b, a))]
        same = (own[a] == own[b]).any(1)
        if (ends[0] | ends[1] | same).mean() >= target:
            return visits
        visits = min(most, visits + max(2, visits // 4))
    return most


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("f4")
    return x / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True).astype("f4")


def _fixed(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _route(forest: Forest, dim: int, visits: int):
    """Per batch one row per leaf: the vectors that live there and those that visit it, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, first = np.unique(batch.column("key").to_numpy(), return_index=True)
            x = _unit(_fixed(batch.column("v"), dim)[first])
            own, seen = forest.own(x), forest.visited(x, max(visits, forest.trees))
            rows = np.concatenate([np.repeat(np.arange(len(x)), own.shape[1]), np.repeat(np.arange(len(x)), seen.shape[1])])
            leaf = np.concatenate([own.ravel(), seen.ravel()])
            lives = np.arange(len(leaf)) < own.size
            # a vector that lives in a leaf also asks there, so its visit to that leaf is dropped
            code = rows * (forest.trees * 2**forest.depth) + leaf
            keep = lives | ~np.isin(code, code[: own.size])
            rows, leaf, lives = rows[keep], leaf[keep], lives[keep]
            order = np.lexsort((~lives, leaf))
            rows, leaf, lives = rows[order], leaf[order], lives[order]
            cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            out = []
            for a, b in zip(cuts, np.r_[cuts[1:], len(leaf)]):
                out.append((int(leaf[a]), int(lives[a:b].sum()), keys[rows[a:b]].tobytes(), x[rows[a:b]].tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                names=["leaf", "n_own", "keys", "x"],
            )

    return run


def _leaf(dim: int, k: int, floor: float):
    """All exact cosines of a leaf's residents with residents and visitors; of each asking vector the k best."""

    def run(group: pa.Table) -> pa.Table:
        own_k, own_x, ask_k, ask_x = [], [], [], []
        for n, keys, x in zip(group.column("n_own").to_pylist(), group.column("keys"), group.column("x")):
            keys, x = np.frombuffer(keys.as_py(), "i8"), np.frombuffer(x.as_py(), "f4").reshape(-1, dim)
            own_k.append(keys[:n]), own_x.append(x[:n]), ask_k.append(keys[n:]), ask_x.append(x[n:])
        rk, first = np.unique(np.concatenate(own_k), return_index=True)
        rx = np.concatenate(own_x)[first]
        vk, first = np.unique(np.concatenate(ask_k), return_index=True)
        vx = np.concatenate(ask_x)[first]
        qk, qx = np.concatenate([rk, vk]), np.concatenate([rx, vx])
        a, b, c = [], [], []
        columns = np.ascontiguousarray(rx.T)
        for s in range(0, len(qk) if len(rk) else 0, BLOCK):
            sims = qx[s : s + BLOCK] @ columns
            here = np.arange(s, min(s + BLOCK, len(rk)))
            sims[here - s, here] = -2  # itself
            if floor > -1:
                i, j = np.nonzero(sims >= floor - 1e-4)
                crowded = np.flatnonzero(np.bincount(i, minlength=len(sims)) > k)
            else:
                i = j = np.zeros(0, "i8")
                crowded = np.arange(len(sims))
            if len(crowded):
                keep = min(k, sims.shape[1])
                best = np.argpartition(-sims[crowded], keep - 1, axis=1)[:, :keep]
                # everything as good as the k-th stays, so a tie at the edge is settled later by id
                edge = np.take_along_axis(sims[crowded], best, 1).min(1, keepdims=True)
                ci, cj = np.nonzero(sims[crowded] >= edge - 1e-6)
                i2, j2 = crowded[ci], cj
                other = ~np.isin(i, crowded)
                i, j = np.concatenate([i[other], i2]), np.concatenate([j[other], j2])
            a.append(qk[s + i]), b.append(rk[j])
            c.append(np.einsum("pd,pd->p", qx[s + i].astype("f8"), rx[j].astype("f8")))
        a, b, c = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((a, "i8"), (b, "i8"), (c, "f8")))
        keep = (a != b) & (c >= floor)
        a, b, c = a[keep], b[keep], c[keep]
        # similarity holds in both directions, so each end learns of the other
        ends = [np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([c, c])]
        return pa.table([pa.array(v) for v in ends], names=["ka", "kb", "cosine"])

    return run


def _valid(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    v = F.col(vector_col).cast("array<float>")
    squares = F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    bad = F.col("norm2").isNull() | F.isnan("norm2") | (F.col("norm2") <= 0) | (F.col("norm2") == F.lit(float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("v") == dim)).withColumn("norm2", squares).where(~bad).select("id", "v", F.xxhash64("v").alias("key"))


def nearest(
    vectors: DataFrame,
    *,
    id_col: str = "id",
    vector_col: str = "embedding",
    dim: int = 64,
    k: int = 10,
    min_cosine: float = -1.0,
    trees: int = 2,
    visits: int | None = None,
    more: int = 2,
    target: float = 0.97,
    leaf_rows: int = 3000,
    sample_rows: int = 131_072,
    seed: int = 7,
) -> DataFrame:
    """id, neighbour, cosine, rank: of every id its k most similar other ids with cosine >= min_cosine.

    visits, more: leaves that a vector visits over all trees, and how many more for each level of the
    trees below LEVEL; more give better recall and move more vectors. None: as many as `target` needs.
    """
    rows = _valid(vectors, id_col, vector_col, dim)
    n = vectors.count()  # from the files' footers
    picked, need = rows, min(sample_rows, max(2048, 64 * math.ceil(n / leaf_rows)))  # 64 rows a leaf are enough to find medians
    if n > need:
        picked = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < max(1, int(1_000_000 * need / n)))
    sample = picked.select("v").toArrow()
    depth = max(LEAST, math.ceil(math.log2(max(n, 1) / leaf_rows)))
    depth = min(depth, max(0, int(math.log2(max(sample.num_rows, 1) / 8)))) if sample.num_rows else 0
    x = _unit(_fixed(sample.column("v"), dim)) if sample.num_rows else np.zeros((0, dim), "f4")
    forest = Forest.fit(x, trees if depth else 1, depth, seed)

    visited = visits_for(forest, x, k, target, seed=seed) if visits is None else visits + more * max(0, depth - LEVEL)
    routed = rows.select("key", "v").mapInArrow(_route(forest, dim, visited), "leaf long, n_own long, keys binary, x binary")
    found = routed.groupBy("leaf").applyInArrow(_leaf(dim, k, min_cosine), "ka long, kb long, cosine double")
    pairs = found.groupBy("ka", "kb").agg(F.max("cosine").alias("cosine"))

    members = rows.select("key", "id").distinct()
    # of a class of copies at most the k + 1 smallest ids can be among anybody's k nearest
    firsts = _firsts(members, k)
    classes = pairs.withColumn("_c", F.rank().over(Window.partitionBy("ka").orderBy(F.desc("cosine")))).where(F.col("_c") <= k).drop("_c")
    others = classes.join(firsts.select(F.col("key").alias("kb"), "ids"), "kb").select("ka", F.explode("ids").alias("neighbour"), "cosine")
    copies = firsts.where(F.size("ids") > 1).select(F.col("key").alias("ka"), F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine"))
    ranked = others.unionByName(copies).withColumn("_r", F.row_number().over(Window.partitionBy("ka").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("_r") <= k + 1).drop("_r")
    listed = ranked.groupBy("ka").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col("neighbour").alias("n")))).alias("list"))
    # a row's own id leaves its list, of which k stay; the list has at most k + 1 entries
    own = members.join(listed, members["key"] == listed["ka"]).select("id", F.slice(F.filter("list", lambda e: e["n"] != F.col("id")), 1, k).alias("list"))
    out = own.select("id", F.posexplode("list").alias("pos", "e")).select("id", F.col("e.n").alias("neighbour"), (-F.col("e.d")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
    return out.where(F.col("cosine") >= min_cosine)


def _firsts(members: DataFrame, k: int) -> DataFrame:
    """key, ids: the k + 1 smallest ids of each class; taken in two steps, so a class of any size is cut before it is gathered."""
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    small = members.withColumn("_part", part)
    first = small.withColumn("_n", F.row_number().over(Window.partitionBy("key", "_part").orderBy("id"))).where(F.col("_n") <= k + 1)
    return first.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
