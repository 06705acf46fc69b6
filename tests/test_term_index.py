import random
import re

from pyspark.sql import functions as F

from sievelake.functions import lexicons
from sievelake.operators import term_index, terms

DOCS = [
    (1, "React Native and reactive c++; c# (node.js)"), (2, "spring  boot spring boot"), (3, None), (4, ""), (5, "日本 ai, A.I. go-lang golang"), (6, "ml" * 30 + " r"), (7, "ci/cd x ci/cdx"), (8, "the the the"), (9, "c++c"),
]
TERMS = ["react", "react native", "c++", "c", "c#", "node.js", "spring boot", "日本", "ai", "go", "ml", "r", "ci/cd", "the", "a.i.", "reactive c++; c#", "(", "x ci"]


def held(text, term, anywhere):
    low = (text or "").lower()
    return term in low if anywhere else re.search(r"(?:^|[^a-z0-9+#.])" + re.escape(term) + r"(?:[^a-z0-9+#.]|$)", low) is not None


def test_hits_equal_search(spark):
    r = random.Random(2)
    docs = DOCS + [(100 + i, "".join(r.choice([*TERMS, "x", "q"]) + r.choice([" ", "", "/", ", "]) for _ in range(r.randint(1, 12)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, raw_text string")
    for anywhere in (False, True):
        table = term_index.term_table(spark, TERMS, anywhere)
        want = {(i, k) for i, t in docs for k, w in enumerate(TERMS) if held(t, w, anywhere)}
        for frequencies in (None, term_index.token_frequencies(df)):
            got = [(x["doc_id"], x["term_id"]) for x in term_index.term_hits(df, table, frequencies=frequencies).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    both = term_index.term_table(spark, TERMS, True).unionByName(term_index.term_table(spark, TERMS).withColumn("term_id", F.col("term_id") + 100))
    assert term_index.term_hits(df, both).count() == sum(held(t, w, a) for _, t in docs for w in TERMS for a in (False, True))


def test_rarest_run_leads(spark):
    table, n = term_index.term_table(spark, ["spring boot", "power bi"]), spark.createDataFrame([("spring", 5), ("boot", 90), ("power", 80)], "token string, n long")
    assert {x["term"]: x["lead"] for x in term_index.index_terms(table, n).collect()} == {"spring boot": "spring", "power bi": "bi"}
    assert {x["term"]: x["lead"] for x in term_index.index_terms(table).collect()} == {"spring boot": "spring", "power bi": "power"}


def test_plans_do_not_grow_with_the_table(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, raw_text string")
    many = spark.range(20_000).select(F.col("id").alias("term_id"), F.concat(F.lit("term"), "id").alias("term"), F.lit(False).alias("anywhere"))
    found = term_index.found_terms(df, many)
    assert len(found._jdf.queryExecution().toString()) < 60_000 and found.count() == len(DOCS)


def test_roles_and_tools(spark):
    df = spark.createDataFrame([(1, "TensorFlow and machine learning with PyTorch"), (2, None), (3, "nothing here")], "doc_id long, raw_text string")
    got = {x["doc_id"]: x for x in terms.role_arcs(df).collect()}
    best = max(((sum(s in "tensorflow and machine learning with pytorch" for s in signals), -i, name) for i, (name, signals) in enumerate(lexicons.ROLE_ARCS)))
    assert got[1]["arc"] == best[2] and got[1]["arc_score"] == best[0] == len(got[1]["arc_signals"])
    assert got[2]["arc"] == got[3]["arc"] == lexicons.DEFAULT_ARC and got[3]["arc_signals"] == []
    own = spark.createDataFrame([(0, "baker", 0, "bread"), (0, "baker", 1, "oven"), (1, "cook", 0, "oven")], "arc_no int, arc string, signal_no int, signal string")
    assert [x["arc"] for x in terms.role_arcs(spark.createDataFrame([(1, "an OVEN")], "doc_id long, raw_text string"), own).collect()] == ["baker"]
    tools = terms.ai_tools(spark.createDataFrame([(1, "qwen and milvus"), (2, "x")], "doc_id long, raw_text string")).collect()
    assert [(x["doc_id"], [t["name"] for t in x["tools"]]) for x in tools] == [(1, [n for n, _, _ in lexicons.AI_TOOLS if n in ("qwen", "milvus")])]
