from pyspark.sql import functions as F

from sievelake.operators import board, issues, scoring, segment, term_index
from sievelake.sources import applicants

ODD = [(1, "site: \nfoo.bar x@y.de"), (2, "www.1 and\nGitHub:\r\n\r\nhandle, end.\nnext.dev/a"), (3, "plain words.\n\nmore"), (4, ""), (5, "a: b\n  c.com/d e")]


def test_texts_are_dealt_over_many_partitions(spark):
    """Keys and sizes are small, the texts made of them are not."""
    rows = applicants.applicants(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_few_terms_are_met_without_a_shuffle_of_texts(spark):
    docs = spark.createDataFrame([(1, "Fine-Tuning of LLMs"), (2, "自动化测试 b.c"), (3, None), (4, "")], "doc_id long, raw_text string")
    terms = ("tun", "fine-tun", "llm", "l", "自动化测试", "b.c", "b.", "zz")
    table = term_index.term_table(spark, terms, anywhere=True)
    found = term_index.with_terms(docs, table)
    assert "hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: sorted(r["met"]) for r in found.collect()}
    assert got == {i: [k for k, t in enumerate(terms) if t in (text or "").lower()] for i, text in [(1, "Fine-Tuning of LLMs"), (2, "自动化测试 b.c"), (3, None), (4, "")]}


def test_parts_are_masked_like_whole_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, t string")
    whole = F.regexp_replace("t", issues.IGNORED, "\u0001")
    made = docs.select("t", issues.masked(F.col("t")).alias("m"), whole.alias("w")).collect()
    for r in made:
        assert len(r["m"]) == len(r["t"])
        import re

        if re.search(r"[@:/]|\.[A-Za-z]", r["t"]):
            assert re.sub("\u0000+", "\u0001", r["m"]) == re.sub("\u0001+", "\u0001", r["w"])


def test_reports_are_made_in_place(spark):
    """No shuffle by document, and what is counted in place is what the tables of lines and issues have."""
    texts = [(1, "Ann Bo\n\nProjects\nLedger\n- Built  a ledger \nSkills\n- recieved and recieved a dep1oyed\n"), (2, None), (3, ""), (4, "- Projects\n-\n\tExperience\n"), (5, "no header")]
    docs = spark.createDataFrame(texts, "doc_id long, raw_text string")
    plan = scoring.score_corpus(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan
    made = segment.with_line_features(docs.select("doc_id", F.coalesce("raw_text", F.lit("")).alias("text"))).drop("text")
    lines = segment.line_features(segment.assign_sections(segment.to_lines(docs)))
    got = {r["doc_id"]: r.asDict() for r in made.collect()}
    assert all(got[r["doc_id"]] == r.asDict() for r in lines.collect())
    assert {r["doc_id"]: r["typos"] for r in issues.typo_counts(docs).collect()} == {1: issues.spelling_issues(docs).count() + issues.ocr_words(docs).count()}


def test_few_terms_are_met_by_one_pattern(spark):
    """The work on a text does not grow with each term; terms at the same place, within others and with marks of patterns are all met."""
    terms = ("a", "ab", "abc", "bc", "c++", "++", "\\q", "[x", "x]", "é", "自动", "动化", "b", "zz", "^", "a-b")
    texts = ["abc", "c++ [x] \\q", "é自动化", "a-b^", "", "xyz", "ABC\nzZz"]
    found = term_index.with_terms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string"), term_index.term_table(spark, terms, anywhere=True))
    assert "_pattern" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: sorted(r["met"]) for r in found.collect()} == {i: [k for k, t in enumerate(terms) if t in s.lower()] for i, s in enumerate(texts)}


def test_rules_are_tried_only_where_one_of_them_matches(spark):
    docs = spark.createDataFrame([(1, "recieved, Recieved and dep1oyed"), (2, "recievedwww.a.io"), (3, "a.iorecieved \u0001x@y.de acheived"), (4, "all is well"), (5, None)], "doc_id long, raw_text string")
    made = issues.with_typos(docs)
    assert "_tried" in made._jdf.queryExecution().optimizedPlan().toString()
    want = {r["doc_id"]: r["n"] for r in issues.spelling_issues(docs).select("doc_id").union(issues.ocr_words(docs).select("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["doc_id"]: r["typos"] for r in made.collect()} == {i: want.get(i, 0) for i in range(1, 6)}


def test_scores_make_no_order_of_terms(spark):
    """Scores need how many terms there are; a vocabulary is gone through for a text only where somebody reads its terms."""
    texts = [(1, "Skills\nPython, python3 and C++; c and .NET\n- Built c++ and react.js for ieee"), (2, None), (3, "- go, Go\n- java spring boot\nProjects\n- Docker c++11")]
    made = scoring.score_corpus(spark.createDataFrame(texts, "doc_id long, raw_text string"))
    assert "array_intersect" not in made.select("doc_id", "score", "jd_score")._jdf.queryExecution().optimizedPlan().toString()
    rows = made.collect()
    assert all(r[f"n_{c}"] == len(r[c]) == len(set(r[c])) for r in rows for c in ("skills", "proven", "high_bar")) and any(r["n_skills"] for r in rows)


def test_empty_texts_are_not_joined_with_the_terms(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "zz")], "doc_id long, raw_text string")
    found = term_index.with_terms(docs, term_index.term_table(spark, ("a", "bc"), anywhere=True))
    assert "Join LeftOuter" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: sorted(r["met"]) for r in found.collect()} == {1: [0, 1], 2: [], 3: [], 4: []}


def test_bullets_are_opened_and_counted_without_splits(spark):
    """The same openings and numbers of words as with the words split, for odd bullets too."""
    verbs = ("built", "led", "fine-tuned")
    texts = ["Built a b", "a built  c", "a b built", "-built\tx", "led", "Fine-tuned it", "buil t", "a", "", "leds led", "1. LED x", "x\ty  z"]
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", segment._opens(F.lower(c), verbs).alias("o"), segment.opens_with(c, verbs).alias("p"), segment.n_words(c).alias("n"), F.size(F.split(c, r"\s+")).alias("m")).collect()
    assert all(r["o"] == r["p"] and r["n"] == r["m"] for r in rows) and [r["o"] for r in rows][:3] == [True, True, False]


def test_the_key_of_a_range_is_made_once(spark):
    """Not once for each bound; ranges are as they were, and a null key is in the first one."""
    rows = spark.createDataFrame([(str(i),) for i in range(1000)] + [(None,)], "id string")
    made = rows.select("id", board.range_slice(rows, F.conv("id", 10, 10).cast("long"), 8).alias("s"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "<= lambda" in plan and plan.count("<= cast(conv(") == 0
    got = {r["id"]: r["s"] for r in made.collect()}
    assert got[None] == 0 and [got[str(i)] for i in range(1000)] == sorted(got[str(i)] for i in range(1000)) and len(set(got.values())) == 8
