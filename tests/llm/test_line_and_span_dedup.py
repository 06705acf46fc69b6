import random

import pytest

from sievelake.llm import line_dedup, substring_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def make_docs(seed):
    r = random.Random(seed)
    lines = [" ".join(r.choices(WORDS, k=6)) for _ in range(30)]
    out = []
    for i in range(25):
        text = [r.choice(lines) if r.random() < 0.3 else " ".join(r.choices(WORDS, k=6)) for _ in range(r.randint(0, 12))]
        if i > 3 and r.random() < 0.7:
            src = r.choice(out)[1].split("\n")
            at = r.randint(0, len(src))
            text[r.randint(0, len(text)) :] = src[at : at + r.randint(2, 6)]
        out.append((i, "\n".join(text)))
    return out


def line_units(line, unit):
    line, n = line.strip(" "), len(line.strip(" ")) // unit
    return [line] if n < 2 else [line[k * unit : None if k == n - 1 else (k + 1) * unit] for k in range(n)]


def brute_force_lines(docs, least, unit):
    """Texts without the lines all of whose units lie in a run of `least` units that occurred before."""
    seen, out = set(), {}
    for i, text in docs:
        lines = text.split("\n")
        us = [(n, u) for n, line in enumerate(lines) if line.strip(" ") for u in line_units(line, unit)]
        gone = set()
        for a in range(len(us) - least + 1):
            run = tuple(u for _, u in us[a : a + least])
            if run in seen:
                gone |= set(range(a, a + least))
            seen.add(run)
        stay = {n for k, (n, _) in enumerate(us) if k not in gone}
        out[i] = "\n".join(line for n, line in enumerate(lines) if not line.strip(" ") or n in stay)
    return out


@pytest.mark.parametrize(("seed", "gram", "window"), [(1, 1, 2), (2, 2, 2), (3, 1, 3), (4, 2, 3)])
def test_lines_equal_a_brute_force_version(spark, seed, gram, window):
    docs = make_docs(seed)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), gram=gram, window=window, unit=20).collect()}
    assert got == brute_force_lines(docs, gram + window - 1, 20)
    assert any(got[i] != t for i, t in docs)


def test_runs_that_only_later_documents_share_go_too(spark):
    a, b, c = "first line", "second line", "third line"
    docs = [(1, "\n".join([a, b])), (2, "\n".join([a, b, c])), (3, "\n".join(["x", a, b, c]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: c, 3: "x"}


def test_one_long_line_is_a_run(spark):
    passage = " ".join(WORDS * 3)
    docs = [(1, f"here\n{passage}\nthere"), (2, f"{passage}\nelsewhere"), (3, "中" * 130), (4, "中" * 130 + "\n文")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "elsewhere", 3: docs[2][1], 4: "文"}


def test_line_dedup_deletes_later_copies_and_keeps_the_first(spark):
    a, b, c, d = "one line here", "another line", "third line", "fourth line"
    docs = [(1, "\n".join([a, b, c, d])), (2, "\n".join(["new", a, b, c, d, "end"])), (3, a), (4, None), (5, ""), (6, "\n".join([d, "x"] * 4)), (7, "\n".join([a, b, c, d])), (7, "\n".join([a, b, c, d]))]
    rows = line_dedup.drop_repeated_lines(spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, removed_lines int")).collect()
    got = {(r["doc_id"]): r["text"] for r in rows}
    assert len(rows) == 8
    assert got[1] == docs[0][1] and got[2] == "new\nend" and got[3] == a and got[4] is None and got[5] == "" and got[7] == ""
    assert got[6] == f"{d}\nx"


def test_line_dedup_of_no_rows(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_equal_a_brute_force_version(spark):
    r = random.Random(3)
    base = [" ".join(r.choices(WORDS, k=r.randint(1, 14))).capitalize() + r.choice(".!?") for _ in range(60)]
    docs = []
    for i in range(30):
        at = r.randint(0, 50)
        docs.append((i, " ".join(base[at : at + r.randint(0, 8)] + [" ".join(r.choices(WORDS, k=9)) + "."])))
    got = {x["doc_id"]: x for x in substring_dedup.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    import re

    owner, parts, spans = {}, {}, {}
    for i, text in docs:
        parts[i] = [p for p in re.split(r"(?<=[.!?]\s)", text) if p]
        assert all(len(p) <= substring_dedup.LONG for p in parts[i])
        keys = [re.findall(r"\w+", p.lower()) for p in parts[i]]
        spans[i] = [
            (s, e, str(keys[s:e])) for s in range(len(keys)) for e in range(s + substring_dedup.MIN_SENTENCES, len(keys) + 1) if sum(map(len, keys[s:e])) >= substring_dedup.MIN_WORDS
        ]
        for s, e, k in spans[i]:
            owner.setdefault(k, (i, s))
    for i, _ in docs:
        # every run that is long enough, whatever its length
        gone = {p for s, e, k in spans[i] if owner[k] != (i, s) for p in range(s, e)}
        assert got[i]["text"] == "".join(p for n, p in enumerate(parts[i]) if n not in gone)
        assert got[i]["removed_sentences"] == len(gone)


def test_spans_end_with_the_passage(spark):
    ten, five = "One two three four five six seven eight nine ten. ", "And five words more now. "
    docs = [(1, ten + ten.replace("One", "Two") + five + "Something else here."), (2, "Other start. " + ten + ten.replace("One", "Two") + five + "Another end."), (2, "Same id. " + ten + ten.replace("One", "Two") + five)]
    got = sorted(r["text"] for r in substring_dedup.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted([docs[0][1], "Other start. Another end.", "Same id. "])


def test_texts_without_blanks_and_marks(spark):
    chinese, bare = "这是一个在许多文件中重复出现的很长的句子。它还有第二句话在这里。", " ".join(f"word{i}" for i in range(60))
    docs = [(1, "开始。" + chinese), (2, "别的开始。" + chinese + "结束。"), (3, bare + " end"), (4, bare + " other")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2] == "别的开始。结束。" and got[1] == docs[0][1] and got[3] == docs[2][1] and "word30" not in got[4] and got[4].endswith("other")


def test_spans_edge_cases(spark):
    long = "This passage has well over twenty words in it. It is said again in another document, word by word. And it ends here, with a third sentence."
    docs = [(1, f"Start. {long}"), (2, f"Other start. {long} Another end."), (3, None), (4, ""), (5, "Short."), (5, "Short.")]
    rows = substring_dedup.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == 6 and got[1] == docs[0][1] and got[2] == "Other start. Another end." and got[3] is None and got[4] == "" and got[5] == "Short."
    assert substring_dedup.drop_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sentences_join_to_the_text():
    texts = ["One. Two!  Three?\nFour… five; six.\n\n", "", " ", "no end", "。中文。a.b. c", "x" * 400 + ". " + "a, b " * 60, " " * 500, "\u0001. \u0002\x0b.\x1c", ("w " * 90 + ", ") * 3]
    for t in texts:
        parts = substring_dedup.sentences(t)
        assert "".join(parts) == t and all(parts) and len(substring_dedup.sentence_keys(t)[0]) == len(parts)
    assert substring_dedup.sentences("One. Two!  Three?\nA.b") == ["One. ", "Two! ", " Three?\n", "A.b"]
