"""Best-fit packing (operator 3): bulk-synchronous best fit over range-sorted documents and gaps.

Documents become token sequences and pieces; whole pieces are sequences of their own. The others, and the gaps of open sequences, are kept as runs: so many
documents of a length, so many sequences with a gap. A superstep takes all runs at once. It sorts them by range of size, lets every document find its
successor (the least gap that fits and that no longer document takes) by a sweep of prefix sums, resolves conflicts by rank, since the k-th document of a
run takes the k-th place, and updates the gaps. Supersteps follow until no document is left. Every row then finds its place by its length and rank.

A superstep adds at most two runs for each length, so the run tables are bounded by the sequence size and the number of supersteps, whatever the input.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.llm.common import discard, parallelism, reachable, table, written

SIZE, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k"
#: Ranges of sizes that a sweep is split into.
RANGES = 16


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own.

    Texts are encoded from the same vocabulary in its form as ranks, which takes a fifth of the time; texts that hold a special token go to the tokenizer.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ranked = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranked(text), np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each worker process."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: whole ones of that size, the first perhaps shorter."""
    first = n % size or size
    return [(0, min(n, first))] + [(s, size) for s in range(first, n, size)]


def token_pieces(df: DataFrame, id_col: str, text_col: str, size: int, vocabulary: str, end_id: int) -> DataFrame:
    """Pieces of at most `size` tokens of every whole text followed by end_id: id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(enc.encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(piece_bounds(len(ids), size)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = reachable(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _before(runs: DataFrame, weight: str, size: str, order: list[Column], top: int) -> DataFrame:
    """runs, sorted by falling size and by order, with the sum of the weights before each: within ranges of sizes, and over the ranges before."""
    cut = runs.withColumn("_range", F.floor(F.col(size) * RANGES / F.lit(top + 1)).cast("int"))
    sums = cut.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    own = F.coalesce(F.sum(weight).over(W.partitionBy("_range").orderBy(F.desc(size), *order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_own", own).join(F.broadcast(sums), "_range").withColumn("before", F.col("_above") + F.col("_own")).drop("_range", "_own", "_above")


#: Rows of a superstep's table. doc: `count` documents of `length` from `rank` on are left. gap: `count` sequences from `first` on have `length` left.
#: place: documents of `length` from `rank` on go to the sequences from `first` on, `each` to one, from `offset` on. step: the number of the superstep.
_STEP = ("step", "kind", "length", "rank", "first", "count", "each", "offset")
_DOC, _GAP, _PLACE = 0, 1, 2


def _step(step: int, kind: int, **cols: Column) -> list[Column]:
    cols |= {"step": F.lit(step), "kind": F.lit(kind)}
    return [cols.get(c, F.lit(None)).cast("int" if c in ("step", "kind") else "long").alias(c) for c in _STEP]


def opening(counts: DataFrame, size: int, step: int = 0) -> DataFrame:
    """The first superstep: documents over half a sequence can't share one, so each opens its own."""
    docs = counts.select("length", F.col("count").alias("n")).withColumn("large", 2 * F.col("length") > size)
    large = _before(docs.where("large"), "n", "length", [], size)
    places = large.select(*_step(step, _PLACE, length=F.col("length"), rank=F.lit(0), first=F.col("before"), count=F.col("n"), each=F.lit(1), offset=F.lit(0)))
    gaps = large.where(F.col("length") < size).select(*_step(step, _GAP, length=size - F.col("length"), first=F.col("before"), count=F.col("n")))
    left = docs.where(~F.col("large")).select(*_step(step, _DOC, length=F.col("length"), rank=F.lit(0), count=F.col("n")))
    return places.union(gaps).union(left)


def superstep(state: DataFrame, most: int, size: int, step: int) -> DataFrame:
    """All documents of a state (doc and gap rows of one step) against all gaps at once; most: the length of the longest document; step: the next number.

    A gap that would take several of the longest documents offers so many slots. By falling size, gaps before documents, slots raise a level and documents
    lower it, so that a document's successor is the last slot before it at its own level. Levels are cut where any run begins or ends, and within a cut each
    document run looks back by one.
    """
    slots = F.when(F.col("kind") == _GAP, F.greatest(F.lit(1), F.floor(F.col("length") / F.lit(most)))).otherwise(F.lit(1))
    runs = state.withColumn("slots", slots).withColumn("slot", F.floor(F.col("length") / F.col("slots"))).withColumn("start", F.coalesce("first", "rank"))
    runs = runs.withColumn("weight", F.when(F.col("kind") == _GAP, F.col("count") * F.col("slots")).otherwise(-F.col("count")))
    runs = _before(runs, "weight", "slot", [F.desc("kind"), F.col("start")], size)
    runs = runs.withColumn("low", F.least("before", F.col("before") + F.col("weight"))).withColumn("high", F.greatest("before", F.col("before") + F.col("weight")))
    cuts = runs.select("step", F.explode(F.array("low", "high")).alias("c")).groupBy("step").agg(F.array_sort(F.collect_set("c")).alias("cuts"))
    parts = runs.join(F.broadcast(cuts), "step").withColumn("at", F.explode(F.expr("slice(cuts, array_position(cuts, low), array_position(cuts, high) - array_position(cuts, low))")))
    parts = parts.withColumn("to", F.expr("element_at(cuts, cast(array_position(cuts, at) + 1 as int))")).drop("cuts")
    by = W.partitionBy("at").orderBy(F.desc("slot"), F.desc("kind"), "start")
    is_doc = F.col("kind") == _DOC
    parts = parts.withColumn("taker", F.lead(F.when(is_doc, F.struct("length", (F.col("rank") + F.col("high") - F.col("to")).alias("rank")))).over(by)).withColumn("found", F.coalesce(F.lag(~is_doc).over(by), F.lit(False)))
    left = parts.where(is_doc & ~F.col("found")).groupBy("length", "rank", "count").agg(F.sum(F.col("to") - F.col("at")).alias("n"))
    left = left.select(*_step(step, _DOC, length=F.col("length"), rank=F.col("rank") + F.col("count") - F.col("n"), count=F.col("n")))
    # what a document run takes of a gap run lies together, and so does what is left of it
    taken = parts.where(~is_doc).groupBy("first", "length", "slots", F.coalesce(F.col("taker.length"), F.lit(0)).alias("doc")).agg(
        F.min(F.col("at") - F.col("low")).alias("a"), F.max(F.col("to") - F.col("low")).alias("b"), F.min("taker.rank").alias("rank")
    )
    # in terms of sequences: part of one, some that are taken alike, part of one
    own = taken.withColumn("inner", F.expr("ceil(a / slots)")).withColumn("last", F.expr("b div slots"))
    one = lambda first, count, each, rank: F.struct(first.cast("long").alias("first"), count.cast("long").alias("count"), each.cast("long").alias("each"), rank.cast("long").alias("rank"))
    a, b, k, inner, last, rank = (F.col(c) for c in ("a", "b", "slots", "inner", "last", "rank"))
    within = F.array(one(F.expr("a div slots"), F.lit(1), b - a, rank))
    across = F.array(one(inner - 1, F.lit(1), inner * k - a, rank), one(inner, last - inner, k, rank + inner * k - a), one(last, F.lit(1), b - last * k, rank + last * k - a))
    split = F.when(inner > last, within).otherwise(F.filter(across, lambda x: (x["count"] > 0) & (x["each"] > 0)))
    each = own.select(F.col("first").alias("run"), F.col("length").alias("gap"), "doc", "a", F.explode(split).alias("p"))
    each = each.select("gap", "doc", "a", (F.col("run") + F.col("p.first")).alias("first"), F.col("p.count").alias("count"), F.col("p.each").alias("each"), F.col("p.rank").alias("rank"))
    used = F.coalesce(F.sum(F.col("doc") * F.col("each")).over(W.partitionBy("first").orderBy("a").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("offset", size - F.col("gap") + used)
    places = each.where(F.col("doc") > 0).select(*_step(step, _PLACE, length=F.col("doc"), **{c: F.col(c) for c in ("rank", "first", "count", "each", "offset")}))
    gaps = each.groupBy("first").agg((F.max("gap") - F.sum(F.col("doc") * F.col("each"))).alias("gap"), F.max("count").alias("count")).where(F.col("gap") > 0)
    return places.union(gaps.select(*_step(step, _GAP, length=F.col("gap"), first=F.col("first"), count=F.col("count")))).union(left)


def best_fit_plan(counts: DataFrame, size: int) -> DataFrame:
    """Places for runs of documents, from their counts (length, count): length, rank, first, each, offset. Ranks rise within a length.

    Documents that fit no gap would open sequences: as many as hold all their tokens, which no packing can do without. Each superstep is a written table.
    """
    steps = [written(opening(counts, size).coalesce(1), "packing-step")]
    while True:
        sizes = steps[-1].agg(F.max(F.when(F.col("kind") == _DOC, F.col("length"))).alias("most"), F.coalesce(F.max(F.when(F.col("kind") == _GAP, F.col("length"))), F.lit(0)).alias("gap")).first()
        if sizes["most"] is None:
            break
        stuck = steps[-1].where((F.col("kind") == _DOC) & (F.col("length") > sizes["gap"])).agg(F.coalesce(F.sum(F.col("length") * F.col("count")), F.lit(0)).alias("n")).first()["n"]
        state = steps[-1].where(F.col("kind") != _PLACE)
        if stuck:
            used = max(s.where(F.col("kind") == _PLACE).agg(F.coalesce(F.max(F.col("first") + F.col("count")), F.lit(0))).first()[0] for s in steps)
            opened = counts.sparkSession.range(1).select(*_step(len(steps) - 1, _GAP, length=F.lit(size), first=F.lit(used), count=F.lit(-(-stuck // size))))
            state = state.union(opened)
        steps.append(written(superstep(state, sizes["most"], size, len(steps)).coalesce(1), "packing-step"))
    plan = steps[0]
    for s in steps[1:]:
        plan = plan.union(s)
    plan = written(plan.where(F.col("kind") == _PLACE).select("length", "rank", "first", "each", "offset").coalesce(1), "packing-plan")
    for s in steps:
        discard(s)
    return plan


def with_rank(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The place of every row among those of its key, from 0, whatever share of the rows one key has.

    A key's rows are dealt into slices by a hash; slices are counted, the counts are summed up before each slice, and rows are numbered within their slice.
    """
    slices = max(64, parallelism(df.sparkSession))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = cut.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy(key, "_slice").orderBy(*order)) - 1
    return cut.withColumn("_own", own).join(sizes.withColumn("_before", before).drop("_n"), [key, "_slice"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_slice", "_own", "_before")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pack every document into sequences of at most `size` tokens: id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than `size` tokens are cut. Null and empty texts are the end token alone; very long texts give many whole pieces, each a sequence
    of its own, with a negative number; repeated rows are packed each; ties of length go by a hash; an empty table gives no rows; other columns are ignored.
    """
    pieces = token_pieces(df, id_col, text_col, size, vocabulary, end_id).withColumn("row", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces")
    plan = best_fit_plan(pieces.where(F.col("length") < size).groupBy("length").count(), size)
    plan = np.array([tuple(r) for r in plan.collect()], np.int64).reshape(-1, 5)  # bounded by the sequence size, see above
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan[:, 0] * (1 << 50) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = plan[np.searchsorted(key, length * (1 << 50) + rank, side="right") - 1]
            i = rank - run[:, 1]
            sequence, offset = run[:, 2] + i // run[:, 3], run[:, 4] + i % run[:, 3] * length
            cols = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    ranked = with_rank(pieces.where(F.col("length") < size), "length", ["id", "piece", "ids_crc32", "row"])
    placed = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    whole = pieces.where(F.col("length") == size).select("id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(whole).withColumnRenamed("id", id_col)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
