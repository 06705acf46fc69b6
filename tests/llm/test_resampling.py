import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from sievelake.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def counts(texts, buckets=10_000):
    out = [0] * buckets
    for t in texts:
        for f in features(t)[1]:
            out[zlib.crc32(f.encode()) % buckets] += 1
    return out


def expected(docs, target):
    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        n, f = features(text)
        h = int(sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x.encode()) % 10_000] for x in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0] is not None, r[0] or 0, k) for k, r in enumerate(rows) if r[1] >= 20)
    rank = {k: n for n, (*_, k) in enumerate(able[: 5 * len(able) // 100], 1)}
    return rows, rank


def test_resampling_equals_brute_force(spark):
    r = random.Random(11)
    pool = ["The", "of", "ÉTÉ", "x1", "and", "zu", "日本", "Straße", "b", "Z9"]
    docs = [(i, "".join(r.choice(pool) + r.choice([" ", ", ", "\n", "--", " _ "]) for _ in range(r.randint(0, 60)))) for i in range(900)]
    docs += [(2000, None), (2001, ""), (2002, " ,;\x00 "), (2003, "word " * 140_000), (None, "x1 of " * 15), (7, docs[8][1]), (7, docs[8][1]), (2004, "q" * 70_000)]
    target = ["the of x1 and b b b", None, "", "ÉTÉ zu 日本 zu"]
    df = spark.createDataFrame([(*d, 5, "z") for d in docs], "doc_id long, text string, rank int, features string").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    rows, rank = expected(docs, target)
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((x["doc_id"], x["n_words"], x["n_features"], x["weight"], x["score"]) for x in got), key=key) == sorted(rows, key=key)
    # rows that are equal in score and id are told apart by nothing: compare what they hold
    want = sorted((n, rows[k][0], rows[k][4]) for k, n in rank.items())
    assert sorted((x["rank"], x["doc_id"], x["score"]) for x in got if x["rank"] is not None) == want and len(want) > 20


def test_ties_of_score(spark):
    rows = spark.createDataFrame([(k % 40, 30, 0, 0, 5) for k in range(400)] + [(None, 30, 0, 0, 5)] * 3 + [(1, 3, 0, 0, 99)], "id long, n_words long, n_features long, weight long, score long")
    got = resampling.drawn(rows, resampling.F.col("n_words") >= 20, (1, 4)).collect()
    assert len(got) == 404 and sorted(x["rank"] for x in got if x["rank"]) == list(range(1, 101))
    by = sorted((x["rank"], -1 if x["id"] is None else x["id"]) for x in got if x["rank"])
    assert [i for _, i in by] == sorted([-1] * 3 + [k % 40 for k in range(400)])[:100]


@pytest.mark.parametrize("held", [3, 4, 7, 1000])
def test_spans_in_chunks(held):
    text = b"a bb ccc dddd e ff ggg h iiii jj"
    found, words = set(), 0
    for s, e, own in resampling.spans(text, 3, held):
        new = set(zip(s.tolist(), e.tolist(), strict=True))
        assert not new & found
        found |= new
        words += own
    w = [m.span() for m in re.finditer(rb"[^ ]+", text)]
    assert words == len(w) and found == {(w[i][0], w[i + k][1]) for k in range(3) for i in range(len(w) - k)}
    assert not list(resampling.spans(b"", 3, held))


def test_no_rows_and_no_target(spark):
    df, none = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resampling.resample(df.limit(0), df).count() == 0
    assert [x["n_features"] for x in resampling.resample(df, none).collect()] == [40 + 39 + 38]
    assert np.array_equal(resampling.bucket_gains(np.zeros(4), np.zeros(4)), np.zeros(4))
