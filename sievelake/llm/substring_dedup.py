"""Substring dedup (operator 2): sliding sentence spans.

At every sentence the shortest runs of consecutive sentences that are long enough (MIN_SENTENCES and MIN_WORDS) are hashed, the one that starts there and
the one that ends there. Hashes are joined globally, and the sentences that a non-first repeated span covers are removed. Within any repeated passage that
is long enough, each sentence lies in a span of these two kinds that does not leave the passage, so that the whole of it is removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import discard, reachable, table, text_or_empty, written

#: A span has at least so many sentences and words. Of sentences of more than LONG characters each clause counts as one, and of such clauses each run of
#: CLAUSE words.
MIN_SENTENCES, MIN_WORDS, LONG, CLAUSE = 2, 20, 150, 12
_BASE = 0x9E3779B97F4A7C15 | 1
ENDS = re.compile(r"[.!?\u2026]\s|[\n\u3002\uFF01\uFF1F\uFF61\u0964\u0965\u061F\u06D4]")
CLAUSE_ENDS = re.compile(r"[,;:]\s|[\u3001\uFF0C\uFF1B\uFF1A\u060C\u061B]")
RUNS = re.compile(rf"\s*(?:\S{{1,{LONG}}}\s*){{1,{CLAUSE}}}|\s+")
WORD = re.compile(r"[^\W_]+")
#: Characters of scripts written without blanks between words (Thai, Japanese, Chinese): each counts as a word.
UNSPACED = re.compile("[\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")


def _cut(text: str, ends: re.Pattern) -> list[str]:
    """A text in parts, each up to the next end; joined they are the text."""
    at = [0, *(m.end() for m in ends.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]


def sentences(text: str) -> list[str]:
    """The sentences of a text, each with the white space after it; joined they are the text."""
    out = []
    for s in _cut(text, ENDS):
        for c in (s,) if len(s) <= LONG else _cut(s, CLAUSE_ENDS):
            out += (c,) if len(c) <= LONG else RUNS.findall(c)
    return out


def sentence_keys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and numbers of words of the sentences, without case and punctuation."""
    from xxhash import xxh64_intdigest

    words = [WORD.findall(s.lower()) for s in sentences(text)]
    keys = [" ".join(w) for w in words]
    n = np.fromiter(map(len, words), np.int64, len(words))
    if not text.isascii() and UNSPACED.search(text):
        n += np.fromiter((len(UNSPACED.findall(k)) for k in keys), np.int64, len(keys))
    return np.fromiter((xxh64_intdigest(k.encode()) for k in keys), np.uint64, len(keys)), n


def span_hashes(hashes: np.ndarray, words: np.ndarray, least: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the shortest spans of enough sentences and words, one that starts and one that ends at each sentence, sorted.

    Sentences without words count for neither.
    """
    at = np.flatnonzero(words > 0)
    h, w = hashes[at], np.concatenate(([0], np.cumsum(words[at])))
    n = len(at)
    i = np.arange(n)
    to = np.maximum(i + least, np.searchsorted(w, w[:-1] + least_words, side="left"))
    since = np.minimum(i + 1 - least, np.searchsorted(w, w[1:] - least_words, side="right") - 1)
    both = np.unique(np.concatenate((i[to <= n] * (n + 1) + to[to <= n], since[since >= 0] * (n + 1) + i[since >= 0] + 1)))
    i, end = both // (n + 1), both % (n + 1)
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, f, np.uint64))), dtype=np.uint64) for f in (_BASE, inverse))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)))
    key = (sums[end] - sums[i]) * down[i] ^ (end - i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    return at[i], at[end - 1] + 1, key.view(np.int64)


def _spans(least: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, key, again = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                s, e, k = span_hashes(*sentence_keys(text.as_py()), least, least_words)
                first = np.zeros(len(k), bool)
                first[np.unique(k, return_index=True)[1]] = True
                row.append(np.full(len(k), i))
                start.append(s)
                end.append(e)
                key.append(k)
                again.append(~first)
            if row and sum(map(len, row)):
                at = pa.array(np.concatenate(row))
                cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(start), pa.int32()), pa.array(np.concatenate(end), pa.int32()), pa.array(np.concatenate(key), pa.int64()), pa.array(np.concatenate(again))]
                yield pa.RecordBatch.from_arrays(cols, names=["uid", "id", "start", "end", "key", "again"])

    return run


def repeated_spans(docs: DataFrame, least: int, least_words: int) -> DataFrame:
    """docs: uid, id, text. Returns uid and the places of sentences to remove."""
    kind = docs.schema["id"].dataType.simpleString()
    spans = reachable(docs).select("uid", "id", "text").mapInArrow(_spans(least, least_words), f"uid long, id {kind}, start int, end int, key long, again boolean")
    spans = written(spans, "sentence-spans")
    heads = spans.where(~F.col("again")).select("key", "id", "uid", "start", "end")
    # sums by key, made before the shuffle, are written, so that both sides of the join are plain shuffles: AQE splits the left rows of a frequent key
    firsts = heads.groupBy("key").agg(F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key", F.col("first.uid").alias("first"))
    firsts = written(firsts, "first-spans")
    later = heads.join(firsts.hint("merge"), "key").where(F.col("uid") != F.col("first")).select("uid", "start", "end")
    gone = later.union(spans.where("again").select("uid", "start", "end"))
    places = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "end")), lambda s: F.sequence(s["start"], s["end"] - 1))))
    out = written(gone.groupBy("uid").agg(places.alias("gone")), "repeated-spans")
    discard(spans)
    discard(firsts)
    return out


def _without(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """Texts without the sentences at the places that are gone."""

    def one(text: str | None, places) -> tuple[str | None, int, int]:
        parts = sentences(text or "")
        if places is None:
            return text, len(parts), 0
        out = set(places)
        return "".join(p for i, p in enumerate(parts) if i not in out), len(parts), len(out)

    return pd.DataFrame([one(t, g) for t, g in zip(texts, gone, strict=True)], columns=["text", "n_sentences", "removed_sentences"])


def drop_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_SENTENCES, least_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of df, with the sentences that non-first repeated spans cover removed, and columns n_sentences and removed_sentences.

    First is the occurrence in the document of the least id (a null id last; ties: the least hash), and there the first place. Sentences end after a full
    stop, question or exclamation mark and white space, after such marks of scripts that write no blank, or at a line break; long ones are taken by clause,
    and long clauses by runs of words. They are compared without case and punctuation. Rows that share id and text are one document. A null text stays null
    and an empty one empty; texts without a span of enough sentences and words stay as they are; an empty table gives no rows; columns of df with the names
    of the new ones are replaced.
    """
    uid = F.xxhash64(F.col(id_col), F.col(text_col))
    gone = repeated_spans(df.select(uid.alias("uid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).where(F.col("text") != ""), least, least_words)
    keep = [c for c in df.columns if c not in ("n_sentences", "removed_sentences")]
    joined = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), uid.alias("uid")).join(gone, "uid", "left")
    joined = reachable(joined).withColumn("cut", F.pandas_udf(_without, "text string, n_sentences int, removed_sentences int")(F.col(f"row.`{text_col}`").cast("string"), F.col("gone")))
    cols = [F.col("cut.text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in keep]
    return joined.select(*cols, "cut.n_sentences", "cut.removed_sentences")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
