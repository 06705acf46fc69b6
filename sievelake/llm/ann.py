"""Approximate nearest neighbours (operator 12): stable projections of few dimensions, indexed by kd-trees, with a chi-square stopping test.

Vectors of length one are projected by a normal random matrix. The squared distance of two projections, over that of the vectors, is then chi-square
distributed with as many degrees of freedom as there are dimensions. A query takes its neighbours by rising distance of the projections and verifies them by
their true distance; once the projections are so far away that a vector as near as the k-th best so far would have come before with the wanted
probability, it stops. So each true neighbour is found with at least that probability, whatever the data.

A kd-tree fitted on a sample deals rows into cells, and rows are sorted by cell; tasks read them in tiles, each of which is a kd-tree of its own. Queries
first search the tile in which they lie, which bounds their k-th best distance, and then pass by all tiles in broadcast waves; a tile whose box is beyond the
stopping distance costs a query one comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.llm.common import discard, parallelism, reachable, table, written

#: Dimensions of the projections, the probability with which the test stops, and rows that the tree of cells is fitted on.
DIMENSIONS, PROBABILITY, SAMPLE = 16, 0.97, 16_384
#: Rows of a cell of the sample, of a tile and of its leaves; numbers in the queries of a wave; queries that meet a tile together; lists that a node merges.
CELL, TILE, LEAF, WAVE_NUMBERS, STRIP, FAN_IN = 16, 4096, 64, 1 << 21, 512, 8
#: What rounding may add to a squared distance.
_SLACK = 1e-9


def chi_square_quantile(p: float, m: int) -> float:
    """The value below which a sum of m squared normal numbers lies with probability p; m is even."""

    def above(x: float) -> float:
        term = total = 1.0
        for j in range(1, m // 2):
            term *= x / 2 / j
            total += term
        return math.exp(-x / 2) * total

    lo, hi = 0.0, 1.0
    while above(hi) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(mid) > 1 - p else (lo, mid)
    return hi


def projection(n: int, m: int) -> np.ndarray:
    """The random matrix for vectors of length n, the same in every process."""
    return np.random.default_rng([12, n]).normal(size=(n, m))


def directions(vecs: np.ndarray) -> np.ndarray:
    """Rows of length one. They are scaled by their largest number first, so that no square leaves the range of doubles."""
    vecs = vecs / np.abs(vecs).max(axis=1, keepdims=True)
    return vecs / np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows. Equal pairs give equal numbers, wherever they stand."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (np.ascontiguousarray(a), np.ascontiguousarray(b)))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def split(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """A kd-tree's leaves, as places: halves at the median of the widest dimension, down to that many rows."""
    out, waiting = [], [np.arange(len(points))]
    while waiting:
        at = waiting.pop()
        own = points[at]
        width = own.max(axis=0) - own.min(axis=0) if len(at) else np.zeros(1)
        if len(at) <= leaf or not width.max() > 0:
            out += [at[i : i + leaf] for i in range(0, len(at), leaf)]
            continue
        order = at[np.argsort(own[:, int(width.argmax())], kind="stable")]
        waiting += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


def fit_cells(points: np.ndarray, leaf: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree as nodes (dimension, cut, below, above), the root first; children under zero are cells -1, -2, ..."""
    nodes: list[list] = []
    cells = 0

    def grow(at: np.ndarray) -> int:
        nonlocal cells
        own = points[at]
        width = own.max(axis=0) - own.min(axis=0)
        k = int(width.argmax())
        cut = float(np.median(own[:, k])) if len(at) > leaf else math.inf
        low = own[:, k] <= cut
        if len(at) <= leaf or low.all():
            cells += 1
            return -cells
        here = len(nodes)
        nodes.append([k, cut, 0, 0])
        nodes[here][2:] = grow(at[low]), grow(at[~low])
        return here

    if len(points):
        grow(np.arange(len(points)))
    return [tuple(n) for n in nodes]


def cell_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The cell of each point."""
    if not nodes:
        return np.zeros(len(points), np.int64)
    dim, cut, low, high = (np.array(x) for x in zip(*nodes, strict=True))
    at, rows = np.zeros(len(points), np.int64), np.arange(len(points))
    while len(rows):
        n = at[rows]
        at[rows] = np.where(points[rows, dim[n]] <= cut[n], low[n], high[n])
        rows = rows[at[rows] >= 0]
    return -at


class Tile:
    """Rows of one length with a kd-tree over their projections, and the search in it."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vecs = ids[order], vecs[order]
        self.dirs = directions(self.vecs)
        self.points = self.dirs @ projection(vecs.shape[1], DIMENSIONS)
        self.leaves = split(self.points, leaf)
        self.low = np.stack([self.points[x].min(axis=0) for x in self.leaves])
        self.high = np.stack([self.points[x].max(axis=0) for x in self.leaves])

    def search(self, asking: np.ndarray, vecs: np.ndarray, points: np.ndarray, bound: np.ndarray, k: int, stop: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query with results here: its place, ids and cosines, k at most. bound: squared distances of the k-th best so far, which fall meanwhile.

        Queries visit leaves by rising distance of the box, all of those at one leaf together; of its points those that pass the test are verified.
        """
        gap = np.maximum(np.maximum(self.low.min(axis=0) - points, points - self.high.max(axis=0)), 0)
        near = np.flatnonzero((gap * gap).sum(axis=1) <= stop * bound + _SLACK)
        for lo in range(0, len(near), STRIP):
            rows = near[lo : lo + STRIP]
            q, dirs = points[rows], directions(vecs[rows])
            box = np.zeros((len(rows), len(self.leaves)))
            for d in range(q.shape[1]):
                gap = np.maximum(np.maximum(self.low[None, :, d] - q[:, d, None], q[:, d, None] - self.high[None, :, d]), 0)
                box += gap * gap
            order = np.argsort(box, axis=1, kind="stable")
            best = np.full((len(rows), k), np.inf)  # squared distances of the k nearest here, or the bound
            hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            active = np.arange(len(rows))
            for step in range(len(self.leaves)):
                leaf = order[active, step]
                active = active[box[active, leaf] <= stop * bound[rows[active]] + _SLACK]
                if not len(active):
                    break
                leaf = order[active, step]
                turn = np.argsort(leaf, kind="stable")
                edges = np.flatnonzero(np.diff(leaf[turn], prepend=-1, append=len(self.leaves)))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    own, at = active[turn[a:b]], self.leaves[leaf[turn[a]]]
                    p = self.points[at]
                    far = np.maximum((q[own] ** 2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * q[own] @ p.T, 0)
                    test = (far <= stop * bound[rows[own]][:, None] + _SLACK) & (self.ids[at] != asking[rows[own]][:, None])
                    dist = np.maximum(2 - 2 * dirs[own] @ self.dirs[at].T, 0)
                    test &= dist <= bound[rows[own]][:, None] + _SLACK  # verified, and not beyond what is known
                    i, j = np.nonzero(test)
                    if not len(i):
                        continue
                    hits.append((own[i], at[j], dist[i, j]))
                    met = np.where(test, dist, np.inf)
                    met = np.partition(met, k - 1, axis=1)[:, :k] if met.shape[1] > k else met
                    best[own] = np.partition(np.concatenate((best[own], met), axis=1), k - 1, axis=1)[:, :k]
                    bound[rows[own]] = np.minimum(bound[rows[own]], best[own].max(axis=1))
            if hits:
                who, at, dist = (np.concatenate(x) for x in zip(*hits, strict=True))
                keep = dist <= bound[rows[who]] + _SLACK
                who, at = who[keep], at[keep]
                score = np.concatenate([cosines(vecs[rows[who[s : s + TILE]]], self.vecs[at[s : s + TILE]]) for s in range(0, len(who), TILE)])
                order = np.lexsort((self.ids[at], -score, who))
                who, at, score = who[order], at[order], score[order]
                edges = np.flatnonzero(np.diff(who, prepend=-1, append=len(rows)))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    yield int(rows[who[a]]), self.ids[at[a : min(b, a + k)]], score[a : min(b, a + k)]


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length of vectors: the places, and the vectors as rows of a matrix."""
    numbers, ends = vectors.flatten().to_numpy(), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    sizes = np.diff(ends)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), at, numbers[ends[at][:, None] + np.arange(n)]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, ids, vectors and whether it asks, of up to TILE rows at a time, as they come."""
    waiting: dict[int, list] = {}
    for batch in batches:
        for n, at, vecs in _by_length(batch.column(0), batch.column(1)) if batch.num_rows else ():
            ids, asks = batch.column(0).to_numpy()[at], batch.column(2).to_numpy(zero_copy_only=False)[at]
            for lo in range(0, len(at), TILE):
                waiting.setdefault(n, []).append((ids[lo : lo + TILE], vecs[lo : lo + TILE], asks[lo : lo + TILE]))
                if sum(len(x) for x, _, _ in waiting[n]) >= TILE:
                    yield n, *(np.concatenate(x) for x in zip(*waiting.pop(n), strict=True))
    for n, parts in waiting.items():
        yield n, *(np.concatenate(x) for x in zip(*parts, strict=True))


def _bounds(k: int, stop: float):
    """The queries of a task's rows, with the squared distance of the k-th best row of their tile; 4, the largest there is, where there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, ids, vecs, asks in _tiles(batches):
            at = np.flatnonzero(asks)
            if not len(at):
                continue
            tile, bound = Tile(ids, vecs), np.full(len(at), 4.0)
            points = directions(vecs[at]) @ projection(n, DIMENSIONS)
            for _ in tile.search(ids[at], vecs[at], points, bound, k, stop):
                pass
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * n + 1, n), pa.int32()), pa.array(vecs[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), rows, pa.array(bound)], names=["id", "vec", "bound"])

    return run


def _search(held, k: int, stop: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = {n: bound.copy() for n, (_, _, _, bound) in held.value.items()}
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for n, ids, vecs, _ in _tiles(batches):
            if n not in held.value:
                continue
            asking, rows, points, _ = held.value[n]
            for i, found, score in Tile(ids, vecs).search(asking, rows, points, bounds[n], k, stop):
                if (n, i) in best:
                    found, score = np.concatenate((best[n, i][0], found)), np.concatenate((best[n, i][1], score))
                    keep = np.lexsort((found, -score))[:k]
                    found, score = found[keep], score[keep]
                best[n, i] = found, score
                if len(score) == k:
                    bounds[n][i] = min(bounds[n][i], max(0.0, 2 - 2 * score[-1]))
        part = TaskContext.get().partitionId()
        for lo in range(0, len(best), 4096):
            some = list(best.items())[lo : lo + 4096]
            query = np.concatenate([np.full(len(f), held.value[n][0][i]) for (n, i), (f, _) in some])
            cols = [pa.array(query), pa.array(np.concatenate([f for _, (f, _) in some])), pa.array(np.concatenate([s for _, (_, s) in some])), pa.array(np.full(len(query), part, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score", "part"])

    return run


def usable(vec: Column) -> Column:
    """Not null, every component present and finite, and one of them not zero."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)


def _matrices(df: DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Table]]:
    own = df.toArrow().combine_chunks()
    if own.num_rows:
        ids, vecs = own.column("id").combine_chunks(), own.column("vec").combine_chunks()
        for n, at, rows in _by_length(ids, vecs):
            yield n, ids.to_numpy()[at], rows, own.take(pa.array(at))


def indexed(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """rows (id, vec, ...) sorted by cell and dealt into even ranges. The tree of cells is fitted on a sample of that many rows; all rows are dealt.

    A cell of many rows is dealt on by a hash of the id, so that one frequent vector is spread over tasks.
    """
    spark, trees = rows.sparkSession, {}
    for n, _, vecs, _ in _matrices(rows.orderBy(F.xxhash64("id", F.lit(12)), "id").limit(sample).select("id", "vec")):
        trees[n] = fit_cells(directions(vecs) @ projection(n, DIMENSIONS), CELL)
    held = spark.sparkContext.broadcast(trees)  # no more nodes than the sample has rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for n, at, vecs in _by_length(batch.column(0), batch.column(1)) if batch.num_rows else ():
                cell[at] = cell_of(directions(vecs) @ projection(n, DIMENSIONS), held.value.get(n, []))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    dealt = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell long")
    order = [F.size("vec"), F.col("cell"), F.xxhash64("id")]
    return dealt.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)


def nearest(df: DataFrame, query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", probability: float = PROBABILITY, sample: int = SAMPLE) -> DataFrame:
    """For each row for which `query` holds, its k nearest rows by cosine: query_id, rank from 1, vec_id, score (the cosine of the given vectors).

    Each of the k true neighbours is found with at least that probability; what is found has its exact score. Probability 1 searches exactly. Vectors that
    are null, all zero or hold a null, NaN or infinite component, and rows with a null id, take no part; vectors meet only vectors of their own length; a row
    is never its own result (rows that share an id are not each other's either); repeated rows ask once and are found each, and rows that share an id but
    not the vector ask together; ties go to the smaller id; a query has fewer than k rows if there are fewer candidates; an empty table gives no rows; other
    columns are ignored. Work is queries times the tiles they can't leave out.
    """
    vec, spark = F.col(vec_col).cast("array<double>"), df.sparkSession
    rows = reachable(df).where(F.col(id_col).isNotNull() & usable(vec)).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = written(indexed(rows, sample), "indexed-vectors")
    stop = chi_square_quantile(probability, DIMENSIONS) if probability < 1 else 1e12
    asking = written(rows.mapInArrow(_bounds(k, stop), "id long, vec array<double>, bound double").dropDuplicates(["id", "vec"]), "queries")
    numbers, parts = asking.agg(F.coalesce(F.sum(F.size("vec") + DIMENSIONS + 2), F.lit(0))).first()[0], []
    waves = max(1, math.ceil(numbers / WAVE_NUMBERS))
    for w in range(waves):
        own = asking.where(F.pmod(F.xxhash64("id", "vec", F.lit(9)), F.lit(waves)) == w)
        wave = {n: (ids, vecs, directions(vecs) @ projection(n, DIMENSIONS), t.column("bound").to_numpy()) for n, ids, vecs, t in _matrices(own)}
        held = spark.sparkContext.broadcast(wave)
        parts.append(written(rows.mapInArrow(_search(held, k, stop), "query_id long, vec_id long, score double, part int"), "nearest-lists"))
        held.destroy()
    discard(rows)
    discard(asking)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    lists = parallelism(spark)
    while lists > FAN_IN:
        lists = math.ceil(lists / FAN_IN)
        level = W.partitionBy("query_id", F.col("part") % lists).orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(level)).where(F.col("rank") <= k).drop("rank")
    last = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
