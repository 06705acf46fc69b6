"""Benchmark decontamination (operator 4): a broadcast hash set of test n-grams, scanned with training token windows, hits verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import discard, keyed, reachable, row_key, table, written

#: Windows with the items that hold them (pairs) that one broadcast set may hold; a larger benchmark is scanned in so many sets as it takes.
MAX_WINDOWS = 200_000
WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes to bytes: A-Z lower-cased, what no word holds to a space. Bytes over 0x7F belong to characters that words hold.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(raw: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return raw.translate(_BYTES).split()


class WindowSet:
    """Distinct windows (words joined by blanks) of some items: per window length a sorted array of hashes, the word numbers, and the items that hold the window."""

    def __init__(self, items: list[tuple[str, str]]):
        self.vocab: dict[bytes, int] = {}
        by: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, window in items:
            numbers = tuple(self.vocab.setdefault(w.encode(), len(self.vocab) + 1) for w in window.split(" "))
            by.setdefault(len(numbers), {}).setdefault(numbers, set()).add(item)
        self.sets = []
        for n, held in sorted(by.items()):
            grams = np.array(list(held), dtype=np.int64).reshape(-1, n)
            hashes = self.hashes(grams.T)
            order = np.argsort(hashes, kind="stable")
            owners = list(held.values())
            self.sets.append((n, hashes[order], grams[order], [sorted(owners[i]) for i in order]))

    @staticmethod
    def hashes(columns: np.ndarray) -> np.ndarray:
        """A hash of each window; row k of columns holds the k-th word of all windows."""
        h = np.zeros(columns.shape[1], np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * _ODD
            h ^= h >> np.uint64(29)
        return h

    def scan(self, text_words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items with occurring windows."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in text_words), np.int64, len(text_words))
        hit, found = np.zeros(len(ids) + 1, np.int32), set()
        known = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, hashes, grams, owners in self.sets:
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] == known[:-n])  # windows of known words only
            if not len(at):
                continue
            rows = ids[at[:, None] + np.arange(n)] if len(at) < 4096 else np.lib.stride_tricks.sliding_window_view(ids, n)[at]
            h = self.hashes(rows.T)
            lo = np.searchsorted(hashes, h)
            for k in np.flatnonzero((lo < len(hashes)) & (hashes[np.minimum(lo, len(hashes) - 1)] == h)):
                j = lo[k]
                while j < len(hashes) and hashes[j] == h[k]:
                    if np.array_equal(grams[j], rows[k]):  # the hit is verified word by word
                        hit[at[k]] += 1
                        hit[at[k] + n] -= 1
                        found.update(owners[j])
                    j += 1
        return np.cumsum(hit[:-1]) > 0, found


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(item, window) of all items: runs of n words, or all words of an item of fewer, joined by blanks, which no word holds."""
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    each = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    return each.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("window")).distinct()


def _scanner(sets):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, spans, items = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()):
                w = words(raw.as_py() or b"")
                hit, found = sets.value.scan(w)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                n_words.append(len(w))
                n_hit.append(int(hit.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string())), batch.column(2)],
                names=["id", "n_words", "n_hit", "spans", "items", "row_key"],
            )

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per row: id, n_words, n_hit, spans (word positions, end exclusive), items (ids as strings, sorted) and row_key (a hash of id and text).

    Words are runs of ASCII letters, lower-cased, digits and non-ASCII characters. A window is n consecutive words of an item, or all words of an item of
    fewer. The (item, window) pairs of the benchmark are counted first. Up to max_windows of them are broadcast at once; beyond that they are dealt, by a
    hash of the pair, into sets of about that size, so that a window of very many items is spread too. One set after the other is collected, scanned for,
    its hits written, and let go, so that memory does not grow with the benchmark; then the hits of all sets are merged by a key of id and text. Every row
    of docs gives one row, and the same one in one pass or many.
    Null and empty texts have no words and no hits; long texts are scanned whole; items without words or with a null id have no windows; items may share
    texts or ids; an empty benchmark leaves all documents clean; ids may be null or shared, and equal rows are answered each; other columns are ignored.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item_col, item_text, n)
    passes = max(1, -(-windows.count() // max_windows))
    rows = reachable(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row_key"))
    kind = docs.schema[id_col].dataType.simpleString()
    form = f"id {kind}, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>, row_key long"

    def scanned(own: DataFrame) -> tuple[DataFrame, Broadcast]:
        held = spark.sparkContext.broadcast(WindowSet([(r["item"], r["window"]) for r in own.collect()]))
        return rows.mapInArrow(_scanner(held), form), held

    if passes == 1:
        return scanned(windows)[0].withColumnRenamed("id", id_col)
    windows = written(windows.withColumn("pass", F.pmod(F.xxhash64("item", "window"), F.lit(passes)).cast("int")), "benchmark-windows")
    parts, every = [], None
    for i in range(passes):
        found, held = scanned(windows.where(F.col("pass") == i))
        if not i:
            every = found = written(found, "contamination")
        found = found.where(F.col("n_hit") > 0).select("row_key", "spans", "items")
        parts.append(found if not i else written(found, "contamination"))
        held.destroy()
    discard(windows)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    # sets, not lists: equal rows find the same in each pass
    hits = hits.groupBy("row_key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select("row_key", merge_spans("spans").alias("spans"), "items")
    both = every.select("id", "n_words", "row_key").join(hits, "row_key", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return both.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "row_key")


def merge_spans(col: str):
    """Overlapping and adjacent spans of an array, joined, in order."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def put(acc, s):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["end"], F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.array_append(acc, s))

    return F.aggregate(F.array_sort(col), none, put)


def without_hits(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id", max_share: float = 0.0, text_col: str = "text") -> DataFrame:
    """The documents of which at most that share of the words lies in hits (0: none), with all their columns. Ids may be null or shared."""
    bad = hits.where(F.col("n_hit") > F.col("n_words") * F.lit(max_share)).select(F.col("row_key").alias("key")).distinct()
    return keyed(docs, row_key(id_col, text_col)).join(bad, "key", "left_anti").select("row.*")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM h), unnest(range(0, n)) AS u(k) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
