"""Structured Streaming forms: status logs, windows, scoring and dedup of arriving documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievelake.streaming.ledger import LedgerSink, run_into

# Event types and the statuses they stand for.
STATUSES = (("view", "queued"), ("click", "analyzing"), ("error", "error"), ("signup", "retrying"), ("purchase", "done"))


def status_events(events: DataFrame) -> DataFrame:
    """(event_id, ts, doc_id, status) from the events table, batch or stream."""
    names = F.create_map(*(F.lit(x) for p in STATUSES for x in p))
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("doc_id"), F.element_at(names, F.col("event_type")).alias("status"))


def latest_status(log: DataFrame) -> DataFrame:
    """(doc_id, status, updates, attempts, first_done): the status of each submission's last event, and what led to it.

    For batches, and for a stream in update mode without a bound on its state; status.latest_status_stream() forgets what is over.
    """
    last = F.max(F.struct("ts", "event_id", "status"))
    return log.groupBy("doc_id").agg(last.alias("last"), F.count(F.lit(1)).alias("updates"), F.count_if(F.col("status") == "analyzing").alias("attempts"), F.min(F.when(F.col("status") == "done", F.col("ts"))).alias("first_done")).select(
        "doc_id", F.col("last.status").alias("status"), "updates", "attempts", "first_done"
    )


def status_windows(log: DataFrame, width: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, status, n): counts in tumbling or sliding windows; late: the watermark of a stream."""
    rows = log.withWatermark("ts", late) if late else log
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(doc_id, start, end, n): runs of events of a submission with no gap longer than that."""
    rows = log.withWatermark("ts", late) if late else log
    return rows.groupBy("doc_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedup_stream(arrivals: DataFrame, key: str = "file_key", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first arrival of each key within the watermark."""
    return arrivals.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, into Parquet, and stop. The checkpoint lets a run go on where the last one ended."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def score_stream(arrivals: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink: LedgerSink, checkpoint: str) -> None:
    """Score documents as they arrive and put each batch's reports into a sink, in which every document is once, whatever failed in between."""
    run_into(arrivals, sink, checkpoint, transform=scorer)


def late_rows(query: StreamingQuery) -> int:
    """How many rows a query's stateful operators have dropped for being later than the watermark, by its recent progress."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
