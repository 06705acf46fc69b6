"""The status of each submission as a state that a stream keeps."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that stateful operators of this kind need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestStatus(StatefulProcessor):
    """Folds events into (status, updates, attempts, first_done), whatever order they come in: the last event is the one of the greatest time and id.

    A submission that has had no event for `keep` is forgotten once the watermark has passed: a timer at its last event's time plus that. What it was is told
    once more, as closed.
    """

    def __init__(self, keep: timedelta):
        self.keep = keep // timedelta(milliseconds=1)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("submission", "us long, event_id long, status string, updates long, attempts long, first_done long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        us, event, status, updates, attempts, first, timer = self.state.get() if self.state.exists() else (None, None, None, 0, 0, None, None)
        for r in rows:
            updates += 1
            attempts += r["status"] == "analyzing"
            if us is None or (r["us"], r["event_id"]) > (us, event):
                us, event, status = r["us"], r["event_id"], r["status"]
            if r["status"] == "done" and (first is None or r["us"] < first):
                first = r["us"]
        due = us // 1000 + self.keep
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.state.update((us, event, status, updates, attempts, first, due))
        yield Row(doc_id=key[0], status=status, updates=updates, attempts=attempts, first_done=first, closed=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            _, _, status, updates, attempts, first, _ = self.state.get()
            self.state.clear()
            yield Row(doc_id=key[0], status=status, updates=updates, attempts=attempts, first_done=first, closed=True)

    def close(self) -> None:
        pass


def latest_status_stream(log: DataFrame, late: str = "1 day", keep: timedelta = timedelta(days=30)) -> DataFrame:
    """(doc_id, status, updates, attempts, first_done, closed) as a stream in update mode: what latest_status() gives for all events so far, of those that had any.

    log: a stream of event_id, ts, doc_id, status. Events that are later than the watermark are dropped by Spark and counted in the query's progress; state
    lives for `keep` after a submission's last event, and an event that comes after that begins anew. Rows without a time or status change nothing.
    """
    rows = log.where(F.col("ts").isNotNull() & F.col("status").isNotNull()).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    form = "doc_id long, status string, updates long, attempts long, first_done long, closed boolean"
    return rows.groupBy("doc_id").transformWithState(LatestStatus(keep), form, "Update", "EventTime").withColumn("first_done", F.timestamp_micros("first_done"))
