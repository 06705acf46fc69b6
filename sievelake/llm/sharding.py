"""Sharding by fixed virtual slots (operator 8, DataFrame functions only).

Records are hashed into thousands of fixed slots. Bytes are summed per slot, and a versioned slot-to-shard map says which shard holds a slot. Records never
change their slot; rebalancing edits the map. Law of the query: ``bytes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.llm.common import table, text_or_empty, written

#: Slots in the map: it bounds the map, and with it every broadcast and every single-task step below.
N_SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def slot_of(id_col: str, n_slots: int = N_SLOTS) -> Column:
    """The fixed slot of a record: a hash of its id alone, so that it never moves."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_slots)).cast("int")


def size_of(text_col: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.octet_length(text_or_empty(text_col)) + 1).cast("long")


def slot_stats(df: DataFrame, id_col: str, text_col: str, n_slots: int = N_SLOTS) -> DataFrame:
    """Bytes and rows per slot; sums are made before the shuffle, so at most n_slots rows leave a task."""
    return df.groupBy(slot_of(id_col, n_slots).alias("slot")).agg(F.sum(size_of(text_col)).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _dealt(loads: Column, slots: Column) -> Column:
    """Deal slots (structs of bytes and slot, in order) one by one to the least loaded shard; the array of shards, in the same order."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def put(acc: Column, x: Column) -> Column:
        least = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == least, v + x["bytes"]).otherwise(v)).alias("loads"),
            F.array_append(acc["to"], least).alias("to"),
        )

    return F.aggregate(slots, start, put, lambda acc: acc["to"])


def first_map(stats: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the slot-to-shard map: slots by falling bytes, each to the least loaded shard so far, ties to the smaller slot and shard.

    The one row that is folded holds at most one entry per slot, whatever the input.
    """
    slots = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", (-F.col("slot")).alias("order"), "slot", "rows"))))
    one = stats.agg(slots.alias("slots")).select("slots", _dealt(F.array_repeat(F.lit(0).cast("long"), n_shards), F.col("slots")).alias("to"))
    each = one.select(F.posexplode("slots").alias("i", "s"), "to")
    return each.select(F.lit(1).alias("version"), F.col("s.slot").alias("slot"), F.get("to", F.col("i")).alias("shard"), F.col("s.bytes").alias("bytes"), F.col("s.rows").alias("rows"))


def grown_map(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map, for one more shard (number n_shards): an edit in which slots move only into the new shard.

    From each old shard slots go, largest first, while the part that went stays within the share that the new shard takes of it.
    """
    total = F.sum("bytes").over(W.partitionBy("shard"))
    gone = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(W.unboundedPreceding, 0))
    moves = gone <= total / F.lit(n_shards + 1)
    return slot_map.select((F.col("version") + 1).alias("version"), "slot", F.when(moves, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "rows")


def shard(df: DataFrame, slot_map: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Put every record into the shard of its slot, with a place there.

    slot_map: one version of the map; it has at most n_slots rows and is broadcast. Returns id, size, text_crc32, shard, virtual_slot and place: the places
    of a shard run gapless from 0, by slot, then id. Null texts count as empty; equal texts may lie in different shards; repeated ids share a slot and get
    places of their own; a null id has a slot like any other; an empty table gives no rows; other columns are ignored.
    """
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    places = slot_map.select("slot", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    rows = df.select(
        F.col(id_col).alias(id_col), size_of(text_col).alias("size"), F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"), slot_of(id_col, n_slots).alias("slot")
    ).join(F.broadcast(places), "slot")
    own = F.row_number().over(W.partitionBy("slot").orderBy(id_col, "text_crc32", "size"))
    return rows.select(id_col, "size", "text_crc32", "shard", F.col("slot").alias("virtual_slot"), (F.col("before") + own - 1).alias("place"))


def op8_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = written(first_map(slot_stats(docs, "doc_id", "text"), 8), "slot-map")
    return shard(docs, stored).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
