import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievelake.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n  x\t y ", "don't we'll I'M", "x<|endoftext|> y  <|endoftext|>", "été  où là", "１２ 3.14  --", "\x1c \x1c a", "emoji 😀 😀x", "a\r\n  b   c", "　全角 文字"]


def test_encoder_equals_the_tokenizer(tokenizer):
    r = random.Random(1)
    texts = ODD + ["".join(r.choices(["a", "é", " ", "  ", "\n", "\t", "1", "'s", ".", "word", " ", "😀", "\x1d"], k=40)) for _ in range(300)]
    encoder = packing.Encoder("byte_bpe_50k")
    for t in texts:
        assert encoder.encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def best_fit(counts, size):
    """The number of sequences of best fit by falling length, one document at a time."""
    gaps, n = [], 0
    for length in sorted(Counter(counts).elements(), reverse=True):
        i = bisect_left(gaps, length)
        if i == len(gaps):
            n += 1
            left = size - length
        else:
            left = gaps.pop(i) - length
        if left:
            insort(gaps, left)
    return n


@pytest.mark.parametrize("case", ["mixed", "small", "one", "large", "thirds", "none"])
def test_plan_places_everything_once_and_fills_as_best_fit_does(spark, case):
    r = random.Random(2)
    size = {"mixed": 64, "small": 100, "one": 50, "large": 1024, "thirds": 1024, "none": 8}[case]
    counts = {
        "mixed": Counter(r.choices(range(1, 64), k=3000)), "small": {3: 4000, 2: 100, 70: 3}, "one": {50 // 2: 1}, "large": Counter(r.choices(range(1, 1024), k=2000)), "thirds": {340: 100, 300: 70, 500: 31, 1: 20000}, "none": {},
    }[case]
    rows = spark.createDataFrame(list(counts.items()), "length long, count long")
    room, placed, by = {}, Counter(), {}
    for length, rank, first, each, offset in packing.best_fit_plan(rows, size).collect():
        by.setdefault(length, []).append((rank, first, each, offset))
    for length, runs in by.items():
        runs.sort()
        assert runs[0][0] == 0
        ends = [x[0] for x in runs[1:]] + [counts[length]]
        for (rank, first, each, offset), end in zip(runs, ends, strict=True):
            for k in range(end - rank):
                room.setdefault(first + k // each, []).append((offset + k % each * length, length))
                placed[length] += 1
    assert placed == Counter(counts)
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    assert len(room) <= 1.02 * best_fit(counts, size) + 1


def test_pieces():
    assert packing.piece_bounds(1, 4) == [(0, 1)]
    assert packing.piece_bounds(4, 4) == [(0, 4)]
    assert packing.piece_bounds(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_pack_whole_table(spark, tokenizer):
    r = random.Random(3)
    docs = [(i, " ".join(r.choices(["some", "words", "été", "x"], k=r.randint(0, 60)))) for i in range(200)]
    docs += [(1000, None), (1001, ""), (1002, "long " * 3000), (1003, "same"), (1003, "same"), (None, "no id")]
    rows = packing.pack(spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, length int"), size=128).collect()
    ids = {}
    for i, t in docs:
        ids.setdefault(i, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    seen, room = Counter(), {}
    for x in rows:
        own = ids[x["doc_id"]][0]
        assert x["ids_crc32"] == zlib.crc32(own[x["start"] : x["start"] + x["length"]].tobytes())
        assert (x["length"] == len(own)) if len(own) <= 128 else (x["length"] == 128 or x["piece"] == 0)
        seen[x["doc_id"]] += x["length"]
        room.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert seen == Counter({i: sum(map(len, v)) for i, v in ids.items()})
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    assert len(room) <= 1.03 * sum(seen.values()) / 128 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
