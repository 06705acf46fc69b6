import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sievelake.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE = alignment.byte_characters()


def pieces(text):
    """(A tokens, B tokens) as (id, start, end) of a whole text, from decoded bytes alone; None without tokens."""
    if not text:
        return None
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    out = []
    for tokens in (a, b):
        if b"".join(x for _, x in tokens) != (" " + text).encode():
            return None
        at, own = 0, []
        for i, x in tokens:
            own.append((i, at, at + len(x)))
            at += len(x)
        out.append(own)
    return out


def expected(texts):
    links, rows, groups = [], [], []
    for text in texts:
        found = pieces(text)
        if not found:
            links.append([])
            rows.append((0, 0, 0, 0, ""))
            groups.append([])
            continue
        a, b = found
        links.append([(x, y) for x, s, e in a for y, t, f in b if s < f and t < e])
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        own = [([x for x, s, e in a if lo <= s and e <= hi], [y for y, s, e in b if lo <= s and e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        text_of = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
        rows.append((len(a), len(b), len(cuts), len(links[-1]), sha256(text_of.encode()).hexdigest()))
        groups.append([(lo, hi, *ids) for lo, hi, ids in zip([0, *cuts], cuts, own, strict=False)])
    counts = Counter(p for x in links for p in x)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(*r, sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x)) for r, x in zip(rows, links, strict=True)], groups


def odd_texts():
    r = random.Random(13)
    parts = ["the", "Été", "naïve", "日本語", "😀", "👩‍👩‍👧", "x1y2", "don't", "<s>", "<0x41>", "<|endoftext|>", "ﬁ", "é", ".", ",", "...", "!?", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\u0000", "\x1c", "_", "1234567", "ваш", "ꙮ", "​"]
    return ["".join(r.choice(parts) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randint(1, 40))) for _ in range(400)]


TEXTS = [None, "", " ", "  ", "\n", "a", " a", "a ", "a\n", "▁", "a ▁ b", "the cat sat. The cat sat on the mat.", "the cat sat. The cat sat on the mat.", "é" * 50, "word " * 3000, "x" * 5000, *odd_texts()]


@pytest.mark.parametrize("limits", [(1 << 20, alignment.TOGETHER, alignment.HELD, alignment.KEPT), (50, 40, 64, 20)])
def test_alignment_equals_brute_force(spark, limits, monkeypatch):
    df = spark.createDataFrame([(None if k == 11 else 7 if k in (12, 13) else k, t, k, -1) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, pairs int").repartition(3)
    want, groups = expected(TEXTS)
    got = sorted((x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups_sha256"], x["n_best"], x["count_sum"]) for x in alignment.align_tokenizers(df, max_pairs=limits[0]).collect())
    assert got == sorted(want)
    # the same in this process, with small limits for what is held
    monkeypatch.setattr(alignment, "TOGETHER", limits[1])
    monkeypatch.setattr(alignment, "HELD", limits[2])
    monkeypatch.setattr(alignment, "KEPT", limits[3])
    own = alignment.Aligner(alignment.BYTE_LEVEL, alignment.PIECES, True)
    assert own.cuts
    for lo in range(0, len(TEXTS), 5):
        for found, g in zip(own.align([t or "" for t in TEXTS[lo : lo + 5]]), groups[lo : lo + 5], strict=True):
            assert [(x["start"], x["end"], x["a"], x["b"]) for x in alignment._spans(found)] == g


def test_groups_as_spans_and_empty_table(spark):
    df = spark.createDataFrame([(1, "naïve 😀 cat"), (2, None)], "doc_id long, text string")
    rows = {x["id"]: x for x in alignment.aligned(df, groups=True).collect()}
    raw = " naïve 😀 cat".encode()
    assert [x["start"] for x in rows[1]["groups"]] == [0, *(x["end"] for x in rows[1]["groups"][:-1])] and rows[1]["groups"][-1]["end"] == len(raw)
    assert rows[1]["n_groups"] == len(rows[1]["groups"]) and rows[2]["groups"] == []
    assert alignment.align_tokenizers(df.limit(0)).count() == 0


def test_coarse_spans_are_refined():
    own = alignment.Aligner(alignment.BYTE_LEVEL, alignment.PIECES, False)
    for text in (" ꙮ ꙮ", " 👩‍👩‍👧x", " é"):
        a, a_end, b, b_end = own.tokens(text)
        assert a_end.tolist() == [sum(own.a_sizes[a[: k + 1]]) for k in range(len(a))] and b_end.tolist() == [sum(own.b_sizes[b[: k + 1]]) for k in range(len(b))]


def test_packing_of_pairs():
    import numpy as np

    codes = np.array([1, 5, (50_000 << 32) | 31_999, (1 << 60)], np.int64)
    got = alignment.unpacked(alignment.packed(codes, np.array([1, 2, 3, 1 << 40])), 4)
    assert got[0].tolist() == codes.tolist() and got[1].tolist() == [1, 2, 3, 1 << 40]
