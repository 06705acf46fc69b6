import datetime

import pytest
from pyspark.sql import functions as F

from sievelake.sources import commits
from sievelake.streaming import ledger, status, streams

START = datetime.datetime(2024, 3, 1)
FORM = "event_id long, ts timestamp, doc_id long, status string"


def event(i, minutes, doc, said):
    return (i, START + datetime.timedelta(minutes=minutes), doc, said)


def files(spark, path, batches):
    """One file for each batch, to be read in this order."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, FORM).coalesce(1).write.parquet(f"{path}/{k}")
        local = f"{path}/{k}".removeprefix("file://")
        for name in os.listdir(local):
            os.utime(os.path.join(local, name), (time.time() - 1000 + 10 * k,) * 2)


def source(spark, path):
    return spark.readStream.schema(FORM).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", status.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


SAID = ("queued", "analyzing", "retrying", "error", "done")


def test_status_of_events_in_any_order(rocks):
    rows = [event(i, (i * 37) % 600, i % 7, SAID[(i * 3) % 5]) for i in range(140)]
    rows += [event(900, 50, 1, "done"), event(901, 50, 1, "queued"), (902, None, 1, "done")]
    path = commits.scratch(rocks, "in")
    files(rocks, path, [rows[k::4] for k in range(4)])
    sink = ledger.LedgerSink(commits.scratch(rocks, "out"))
    ledger.run_into(status.latest_status_stream(source(rocks, path)), sink, f"{path}-log", mode="update")
    got = sink.latest(rocks, "doc_id")
    assert not got.where("closed").count()
    want = streams.latest_status(rocks.createDataFrame(rows, FORM).where("ts IS NOT NULL"))
    assert sorted(map(tuple, got.drop("closed").collect())) == sorted(map(tuple, want.collect()))


def test_state_ends_and_late_events_are_counted(rocks):
    day = 24 * 60
    path = commits.scratch(rocks, "in")
    files(rocks, path, [[event(1, 0, 1, "queued"), event(2, 5, 2, "queued")], [event(3, 10 * day, 3, "queued")], [event(4, 10 * day + 1, 3, "done")], [event(5, 1, 1, "done"), event(6, 11 * day, 3, "done")]])
    sink = ledger.LedgerSink(commits.scratch(rocks, "out"))
    query = ledger.run_into(status.latest_status_stream(source(rocks, path), "1 hour", datetime.timedelta(days=2)), sink, f"{path}-log", mode="update")
    got = {r["doc_id"]: r for r in sink.latest(rocks, "doc_id").collect()}
    assert got[1]["closed"] and got[1]["status"] == "queued" and got[2]["closed"] and not got[3]["closed"] and got[3]["updates"] == 3
    assert streams.late_rows(query) == 1


@pytest.mark.parametrize("when", ["write", "commit"])
def test_restart_after_a_failure_scores_each_document_once(spark, when):
    path = commits.scratch(spark, "in")
    files(spark, path, [[event(i, i, i, "queued") for i in range(k * 10, k * 10 + 10)] for k in range(3)])
    sink, scored = ledger.LedgerSink(commits.scratch(spark, "out")), []

    def scorer(batch):
        scored.append(1)
        return batch.select("doc_id", (F.col("doc_id") * 2).alias("score"))

    def fail(batch_id):
        if batch_id == 1:
            raise RuntimeError("lost")

    if when == "commit":  # the batch is written and not committed
        sink.before_commit = fail
    else:  # the batch is committed, and the stream does not learn of it
        put = sink.put
        sink.put = lambda b, i: (put(b, i), fail(i))
    with pytest.raises(Exception, match="lost"):
        streams.score_stream(source(spark, path), scorer, sink, f"{path}-log")
    assert sink.read(spark).count() == (10 if when == "commit" else 20)
    again = ledger.LedgerSink(sink.path)
    streams.score_stream(source(spark, path), scorer, again, f"{path}-log")
    rows = again.read(spark).collect()
    assert sorted((r["doc_id"], r["score"], r["batch_id"]) for r in rows) == [(i, 2 * i, i // 10) for i in range(30)]
    assert again.sweep(spark) == (1 if when == "commit" else 0) and again.read(spark).count() == 30


def test_windows_and_sessions_of_a_stream(spark):
    rows = [event(i, i * 7, i % 3, SAID[i % 5]) for i in range(120)]
    end = [event(900, 3000, 9, "queued")]  # moves the watermark beyond all others
    late = [event(901, 1, 0, "queued"), event(902, 2, 0, "queued")]
    path = commits.scratch(spark, "in")
    files(spark, path, [rows[:60], rows[60:], end, late])
    on_time = spark.createDataFrame(rows, FORM)
    for name, make in (("sliding", lambda log, **k: streams.status_windows(log, "1 hour", "20 minutes", **k)), ("sessions", lambda log, **k: streams.sessions(log, "15 minutes", **k))):
        sink = ledger.LedgerSink(commits.scratch(spark, name))
        query = ledger.run_into(make(source(spark, path), late="10 minutes"), sink, f"{sink.path}-log")
        got, want = sink.read(spark).drop("batch_id"), make(on_time)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 10
        assert streams.late_rows(query) >= 2
