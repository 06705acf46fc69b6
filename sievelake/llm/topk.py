"""Exact top-k inner-product search (operator 9): tiled matrix products, partial selection per tile, tree merging.

Every candidate stays in its task. Queries pass by in waves of bounded size: a wave is broadcast, each task multiplies it with its candidates tile by tile
and keeps k per query, and the tasks' lists are merged in a tree.
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

#: Numbers in the queries of a wave, about; candidates and queries of a tile; lists that a node of the tree merges.
WAVE_NUMBERS, TILE, STRIP, FAN_IN = 1 << 21, 4096, 512, 8
LONG = (-(2**63), 2**63 - 1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: float arithmetic where no sum can leave the integers that the type holds, else Python integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(q).dot(exact(c).T), *LONG).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by falling score, ties to the smaller id. ids: ascending, for all rows."""
    n = scores.shape[1]
    if n > k and np.abs(scores).max(initial=0) < (1 << 62) // n:
        key = scores * n - np.arange(n)  # no two are equal, so that a partition keeps the right ties
        at = np.argpartition(-key, k - 1, axis=1)[:, :k]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, 1), axis=1), 1)
    else:
        at = np.argsort(-scores.astype(object) if n and scores.min() == LONG[0] else -scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, at, 1), ids[at]


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length of vectors: the ids and the vectors as rows of a matrix."""
    if not len(ids):
        return
    ids, numbers, ends = ids.to_numpy(), vectors.flatten().to_numpy(), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    sizes = np.diff(ends)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), ids[at], numbers[ends[at][:, None] + np.arange(n)]


def _search(held, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list] = {}
        waiting: dict[int, list] = {}

        def tile(n: int) -> None:
            ids, mat = (np.concatenate(x) for x in zip(*waiting.pop(n), strict=True))
            order = np.argsort(ids, kind="stable")
            ids, mat = ids[order], np.floor(scale * mat[order])
            asking, rows = held.value[n]
            for at in range(0, len(asking), STRIP):
                own = asking[at : at + STRIP]
                scores, who = _best(_products(rows[at : at + STRIP], mat), ids, k + 1)  # one more, for the query itself
                for r, q in enumerate(own):
                    other = who[r] != q
                    s, w = scores[r][other][:k], who[r][other][:k]
                    if (n, at + r) in best:
                        s, w = np.concatenate((best[n, at + r][0], s)), np.concatenate((best[n, at + r][1], w))
                        keep = np.lexsort((w, -s))[:k]
                        s, w = s[keep], w[keep]
                    best[n, at + r] = [s, w]

        for batch in batches:
            for n, ids, mat in _by_length(batch.column(0), batch.column(1)):
                if n in held.value:
                    for at in range(0, len(ids), TILE):
                        waiting.setdefault(n, []).append((ids[at : at + TILE], mat[at : at + TILE]))
                        if sum(len(x) for x, _ in waiting[n]) >= TILE:
                            tile(n)
        for n in list(waiting):
            tile(n)
        part = TaskContext.get().partitionId()
        for lo in range(0, len(best), 4096):
            some = list(best.items())[lo : lo + 4096]
            query = np.concatenate([np.full(len(s), held.value[n][0][i]) for (n, i), (s, _) in some])
            cols = [pa.array(query), pa.array(np.concatenate([w for _, (_, w) in some])), pa.array(np.concatenate([s for _, (s, _) in some])), pa.array(np.full(len(query), part, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score", "part"])

    return run


def usable(vec: Column) -> Column:
    """Not null, and every component present and finite."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def exact_top_k(df: DataFrame, query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """For each row for which `query` holds, its k best rows by the integer inner product of floor(scale * x).

    Candidates are dealt out once and written. Queries come in waves of about WAVE_NUMBERS numbers: one wave is collected and broadcast, meets all candidates
    in tiles, each task keeps k per query, and the lists are written before the next wave; then they are merged in a tree. Vectors that are null or hold a
    null, NaN or infinite component, and rows with a null id, take no part; vectors meet only vectors of their own length; a row is never its own result
    (rows that share an id are not each other's either); ties go to the smaller id; a query has fewer than k rows if there are fewer candidates; products
    beyond 64 bits saturate; an empty table gives no rows. Returns query_id, rank from 1, vec_id, score.
    """
    vec, spark = F.col(vec_col).cast("array<double>"), df.sparkSession
    rows = reachable(df).where(F.col(id_col).isNotNull() & usable(vec)).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), query.alias("asks"))
    rows = written(rows.repartition(parallelism(spark)), "vectors")
    numbers, parts = rows.where("asks").agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0], []
    waves = max(1, math.ceil(numbers / WAVE_NUMBERS))
    for w in range(waves):
        own = rows.where("asks").where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(waves)) == w).select("id", "vec").toArrow().combine_chunks()
        wave = {n: (ids, np.floor(scale * mat)) for n, ids, mat in _by_length(*(c.combine_chunks() for c in own.columns))} if own.num_rows else {}
        held = spark.sparkContext.broadcast(wave)
        parts.append(written(rows.select("id", "vec").mapInArrow(_search(held, k, scale), "query_id long, vec_id long, score long, part int"), "top-lists"))
        held.destroy()
    discard(rows)
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


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
