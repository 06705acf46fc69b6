import datetime

import pytest

from sievelake.sources import commits, store

NOW = datetime.datetime(2030, 1, 1)
SCHEMA = "id string, file_name string, overall_score int, created_at timestamp, updated_at timestamp, is_deleted boolean"


def row(i, score, name=None):
    t = datetime.datetime(2024, 1, 1)
    return (str(i), name or f"cv_{i}.pdf", score, t, t, False)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def made(spark):
    s = store.ResultStore(spark, commits.scratch(spark, "store"), buckets=8)
    s.create(frame(spark, [row(i, i) for i in range(40)]))
    return s


def scores(df):
    return {r["id"]: r["overall_score"] for r in df.collect()}


def buckets(s, version):
    return commits.content(s.spark, s._manifest(version))["buckets"]


def test_merge_rewrites_touched_buckets_only(spark, made):
    batch = frame(spark, [row("x", 77, "CV_3.pdf "), row(100, 5)])
    assert made.merge(batch, NOW) == 1
    want = {str(i): i for i in range(40)} | {"3": 77, "100": 5}
    assert scores(made.read()) == want and scores(made.read(0)) == {str(i): i for i in range(40)}
    old, new = buckets(made, 0), buckets(made, 1)
    touched = {str(r[0]) for r in batch.select(store.bucket_of(store.file_key(), 8)).collect()}
    assert {b for b in new if new[b] != old.get(b)} == touched and len(touched) <= 2
    assert scores(store.merge_results(made.read(0), batch, NOW)) == want


def test_a_row_is_found_by_its_id_in_another_bucket(spark, made):
    made.merge(frame(spark, [row(7, 99, "renamed.pdf")]), NOW)
    got = {r["id"]: r["file_name"] for r in made.read().collect()}
    assert got["7"] == "renamed.pdf" and len(got) == 40


def test_two_writers_on_the_same_bucket(spark, made):
    other = store.ResultStore(spark, made.path, buckets=8)
    calls = []

    def meanwhile(version):
        calls.append(version)
        if len(calls) == 1:
            other.merge(frame(spark, [row(3, 50), row(200, 1, "cv_200.pdf")]), NOW)

    made.before_commit = meanwhile
    assert made.merge(frame(spark, [row(3, 60), row(4, 61)]), NOW) == 2 and calls == [1, 2]
    got = scores(made.read())
    assert got["3"] == 60 and got["4"] == 61 and got["200"] == 1 and len(got) == 41
    assert scores(made.read(1))["3"] == 50 and scores(made.read(1))["4"] == 4


def test_two_writers_on_other_buckets_keep_their_work(spark, made):
    names = {}
    for r in made.read().select("id", store.bucket_of(store.file_key(), 8).alias("b")).collect():
        names.setdefault(r["b"], r["id"])
    a, b = list(names.values())[:2]
    other, merged = store.ResultStore(spark, made.path, buckets=8), []
    made.before_commit = lambda v: other.delete(spark.createDataFrame([(b,)], "id string")) if v == 1 else None
    made.change(spark.createDataFrame([(a,)], "id string"), lambda rows, new: merged.append(1) or store.set_deleted(rows, new, True))
    assert len(merged) == 1 and {r["id"] for r in made.read().where("is_deleted").collect()} == {a, b}


def test_a_writer_gives_up_in_the_end(spark, made):
    other = store.ResultStore(spark, made.path, buckets=8)
    one = spark.createDataFrame([("1",)], "id string")
    made.tries, made.before_commit = 2, lambda v: other.delete(one, v % 2 == 1)
    with pytest.raises(commits.AlreadyCommitted):
        made.drop(one)
    assert len(scores(made.read())) == 40


def test_drop_restore_and_sweep(spark, made):
    some = spark.createDataFrame([("1",), ("2",)], "id string")
    made.delete(some)
    made.delete(some, False)
    made.drop(some)
    assert made.versions() == [0, 1, 2, 3] and len(scores(made.read())) == 38
    assert made.change(spark.createDataFrame([("nobody",)], "id string"), store.set_deleted) == 3
    made.sweep()
    assert made.versions() == [3] and len(scores(made.read())) == 38
    used = {p.split("/")[1] for p in buckets(made, 3).values()}
    assert set(commits.folders(spark, f"{made.path}/data")) == used
    assert not made.read().where("is_deleted").count()
