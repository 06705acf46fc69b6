"""Importance resampling towards a target (operator 11): documents are drawn by how much more their word runs are at home in a target than in the corpus.

A text is lower-cased and its separators collapse to single spaces; one regular expression with overlapping matches and a boundary behind it then gives, from
every word on, the spans of its runs of one, two and three words, whose CRC-32 is counted into buckets. A document's weight is the sum of its buckets' gains
and the draw is a top list under Gumbel noise that depends on the document's id alone, so that it is one without replacement and can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.llm.common import discard, parallelism, reachable, table, written

BUCKETS, RUN, LEAST_WORDS, SHARE, SEED = 10_000, 3, 20, (5, 100), 42
#: Matches of a text that are held at a time.
HELD = 1 << 16
#: Bytes to bytes: A-Z lower-cased, what no word holds to a space. Bytes over 0x7F belong to characters that words hold.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def collapsed(raw: bytes) -> bytes:
    """The words of a UTF-8 text, joined by single spaces."""
    return b" ".join(raw.translate(_BYTES).split())


@cache
def run_pattern(n: int) -> regex.Pattern:
    """From a boundary, the longest run of up to n words. Words are taken whole, so that the run ends at a boundary too."""
    return regex.compile(rb"(?<![^ ])[^ ]++" + rb"(?: [^ ]++" * (n - 1) + rb")?" * (n - 1))


def spans(text: bytes, n: int = RUN, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of a collapsed text, chunk by chunk: starts and ends of all runs of 1 to n words, and the number of words of the chunk.

    A match from each word on is its longest run; the shorter ones end before the blanks in it, which are where the next words' matches begin.
    """
    found = (m.span() for m in run_pattern(n).finditer(text, overlapped=True))
    waiting: list[tuple[int, int]] = []
    while True:
        new = list(islice(found, held))
        waiting += new
        over = len(new) < held
        own = len(waiting) if over else len(waiting) - (n - 1)  # a run may end in words of the next chunk
        if own > 0:
            at = np.array(waiting, np.int64)
            ends = np.append(at[1:, 0] - 1, at[-1, 1] if over else 0)  # of single words
            starts, stops = [], []
            for k in range(n):
                m = min(own, len(at) - k)
                starts.append(at[:m, 0])
                stops.append(ends[k : k + m] if k < n - 1 else at[:m, 1])
            yield np.concatenate(starts), np.concatenate(stops), own
            waiting = waiting[own:]
        if over:
            return


def buckets_of(raw: bytes, n: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The buckets of all features of a UTF-8 text, and its number of words."""
    text, out, words = collapsed(raw), [np.zeros(0, np.int64)], 0
    for starts, ends, own in spans(text, n):
        out.append(np.fromiter((crc32(text[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts)) % buckets)
        words += own
    return np.concatenate(out), words


def featured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """Per row: id, n_words, n_features and features, the bucket of each feature as little-endian numbers of two or four bytes. Null texts have none."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [buckets_of(raw.as_py() or b"", n, buckets) for raw in part.column(1).cast(pa.binary())]
                cols = [pa.array([w for _, w in found], pa.int64()), pa.array([len(x) for x, _ in found], pa.int64()), pa.array([x.astype(kind).tobytes() for x, _ in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["id", "n_words", "n_features", "features"])

    form = f"id {df.schema[id_col].dataType.simpleString()}, n_words long, n_features long, features binary"
    return reachable(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, form)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket. Tasks count their own; what comes to the driver is one number for each bucket."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for x in rows.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[x["bucket"]] = x["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket a thousand times the logarithm of its share in the target over that in the source, each with one feature more, rounded down."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise of an id, in thousandths, rounded down."""
    h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """featured() rows with weight and score instead of their features. A null id is taken as the word null."""
    kind, held = "<u2" if len(gains) <= 1 << 16 else "<u4", rows.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = np.array([held.value[np.frombuffer(raw.as_py(), kind)].sum() for raw in batch.column(3)], np.int64)
            scores = weights + np.array([noise("null" if i is None else i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights), pa.array(scores)], names=["id", "n_words", "n_features", "weight", "score"])

    form = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long"
    return rows.select("id", "n_words", "n_features", "features").mapInArrow(run, form)


def drawn(rows: DataFrame, eligible: Column, share: tuple[int, int] = SHARE) -> DataFrame:
    """rows with rank: 1, 2, 3... by falling score, then rising id, for that share of the eligible rows, rounded down; null for the others.

    Rows are sorted by range and numbered within their range; the ranges' sizes give what to add. Rows that are equal in both are dealt by a number of their
    own, so that they don't meet in one range.
    """
    spark = rows.sparkSession
    rows = written(rows.withColumn("own", F.monotonically_increasing_id()), "scored-rows")
    n = rows.where(eligible).count() * share[0] // share[1]
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("own")]
    dealt = written(rows.where(eligible).select("score", "id", "own").repartitionByRange(parallelism(spark), *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    ranges = written(sizes.select("range", before.alias("before")).where(F.col("before") < n), "range-sizes")
    own = dealt.join(F.broadcast(ranges), "range")  # as many rows as there are partitions
    rank = F.row_number().over(W.partitionBy("range").orderBy(*order)) + F.col("before")
    ranked = own.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).select("own", "rank")
    return rows.join(ranked, "own", "left").drop("own")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE, seed: int = SEED) -> DataFrame:
    """Per row of docs: id, n_words, n_features, weight, score, and rank among the drawn, null for the others.

    Words are runs of ASCII letters, lower-cased, digits and non-ASCII characters; features all runs of 1 to n of them, repeats counted. Every text is scanned
    once; its buckets are written and read again for its weight. The share drawn is of the rows with least_words or more. Null and empty texts have no
    features and weight 0, and are not drawn; long texts are taken whole; ties of score go to the smaller id, a null id first; repeated rows are drawn each;
    an empty target gives every bucket its share of the corpus turned over; an empty table gives no rows; other columns are ignored.
    """
    rows = written(featured(docs, id_col, text_col, n, buckets), "features")
    gains = bucket_gains(bucket_counts(rows, buckets), bucket_counts(featured(target.withColumn("_", F.lit(0)), "_", target_text, n, buckets), buckets))
    out = drawn(scored(rows, gains, seed), F.col("n_words") >= least_words, share)
    discard(rows)
    return out.withColumnRenamed("id", id_col)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
