import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import decontam, sharding, topk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("max_windows", [1_000_000, 7])
def test_contamination_equals_brute_force(spark, max_windows):
    r = random.Random(1)
    pool = ["the", "of", "Été", "x1", "AND", "zu", "b"]
    items = [(i, " ".join(r.choices(pool, k=r.choice([2, 5, 9, 10, 11, 25])))) for i in range(12)] + [(50, ""), (51, None), (None, "the of"), (52, "the, of-x1"), (53, "THE of x1")]
    docs = [(i, " ".join(r.choices(pool, k=r.randint(0, 40)))) for i in range(60)]
    docs += [(100 + i, f"start! {items[i][1].upper()}. end") for i in range(12)] + [(200, None), (201, ""), (202, "?!"), (203, " ".join(r.choices(pool, k=30_000)))]
    found = decontam.find_contamination(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items int"), spark.createDataFrame(items, "item_id long, text string"), max_windows=max_windows)
    got = {x["doc_id"]: x for x in found.collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        w = words(text)
        hit, hits = set(), set()
        for item, t in items:
            own = words(t)
            if item is None or not own:
                continue
            n = min(10, len(own))
            grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    hits.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(hits))
        assert {p for s in got[i]["spans"] for p in range(s["start"], s["end"])} == hit


def test_contamination_of_no_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [x["n_hit"] for x in decontam.find_contamination(docs, none).collect()] == [0]
    assert decontam.find_contamination(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("waved", [(40, 7, 50, 2), (4096, 512, 1 << 21, 8)])
def test_top_k_equals_brute_force(spark, waved):
    r = np.random.default_rng(2)
    vecs = [(i, [float(x) for x in r.normal(size=6)]) for i in range(400)]
    vecs += [(1000 + i, vecs[20][1]) for i in range(60)] + [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (2080, [1.0, 2.0]), (None, vecs[0][1]), (2100, [1e7, -1e7, 1e8, 3.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*v, 1) for v in vecs], "vec_id long, embedding array<double>, rank int")
    old = topk.TILE, topk.STRIP, topk.WAVE_NUMBERS, topk.FAN_IN
    topk.TILE, topk.STRIP, topk.WAVE_NUMBERS, topk.FAN_IN = waved
    try:
        got = {}
        for x in topk.exact_top_k(df, F.col("vec_id") % 20 == 0, 20).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    finally:
        topk.TILE, topk.STRIP, topk.WAVE_NUMBERS, topk.FAN_IN = old
    use = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, a in use:
        if q % 20 == 0:
            all_ = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in use if i != q and len(a) == len(b))[:20]
            if all_:
                want[q] = [(k, i, -s) for k, (s, i) in enumerate(all_, 1)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_sharding(spark):
    r = random.Random(3)
    docs = [(i, "x" * r.randint(0, 400)) for i in range(3000)] + [(5000, None), (5001, ""), (5002, "é" * 900), (None, "no id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, shard int")
    stats = sharding.slot_stats(df, "doc_id", "text", 512)
    first = sharding.first_map(stats, 8)
    rows = sharding.shard(df, first, n_slots=512).collect()
    assert len(rows) == len(docs)
    size = {}
    places = {}
    for x in rows:
        size[x["shard"]] = size.get(x["shard"], 0) + x["size"]
        places.setdefault(x["shard"], []).append(x["place"])
    assert sorted(size) == list(range(8)) and max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    by = {x["doc_id"]: x for x in rows}
    assert by[5000]["size"] == 1 and by[5000]["text_crc32"] == 0 and by[5002]["size"] == 1801 and by[5002]["text_crc32"] == zlib.crc32(("é" * 900).encode())
    # the greedy deal, by brute force
    loads, want = [0] * 8, {}
    for s in sorted(stats.collect(), key=lambda s: (-s["bytes"], s["slot"])):
        k = loads.index(min(loads))
        loads[k] += s["bytes"]
        want[s["slot"]] = k
    one = {x["slot"]: x["shard"] for x in first.collect()}
    assert one == want
    grown = sharding.grown_map(first, 8).collect()
    assert {x["version"] for x in grown} == {2}
    moved = {x["slot"] for x in grown if x["shard"] != one[x["slot"]]}
    assert moved and all(x["shard"] == 8 for x in grown if x["slot"] in moved)
    new = sum(x["bytes"] for x in grown if x["shard"] == 8)
    assert 0.85 * sum(loads) / 9 <= new <= sum(loads) / 9
    empty = df.limit(0)
    assert sharding.shard(empty, sharding.first_map(sharding.slot_stats(empty, "doc_id", "text"), 8)).count() == 0
