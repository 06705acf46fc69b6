"""Operators on small inline inputs."""

import datetime
import random
import re

from pyspark.sql import functions as F

from sievelake.operators import board, clean, issues, scoring, segment, terms
from sievelake.sources import files, store
from sievelake.streaming import ledger, streams


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_repairs(spark):
    cases = {
        "eﬃcient “quoted” – it’s…": 'efficient "quoted" - it\'s...',
        "engi-\nneering": "engineering",
        "o Built things": "* Built things",
        "Pyth0n T0ols": "Python Tools",
        "Deve1oper": "Developer",
        "5QL and 0ptimized 1eadership 5ystem": "SQL and Optimized leadership System",
        "2O24 and 1O0%": "2024 and 100%",
        "Python , Java": "Python, Java",
        "* Built a thing\nthat works": "* Built a thing that works",
        "40% in 2024, 5 years, 0.5": "40% in 2024, 5 years, 0.5",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, raw_text string")
    got = {r["doc_id"]: r["c"] for r in rows.select("doc_id", clean.clean(F.col("raw_text")).alias("c")).collect()}
    tally = {r["doc_id"]: r["clean"] for r in clean.fix_tally(rows).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i] == want and tally[i] == want


def test_unicode_and_tally(spark):
    rows = clean.normalize_unicode(spark.createDataFrame([(1, "ﬁne\r\nＡ"), (2, None), (3, "plain")], "doc_id long, raw_text string"))
    assert [r["raw_text"] for r in rows.orderBy("doc_id").collect()] == ["fine\nA", None, "plain"]
    fixes = clean.fix_tally(spark.createDataFrame([(1, "“a” “b”\n\n\n\no Built")], "doc_id long, raw_text string")).first()["fixes"]
    assert {f["kind"]: f["count"] for f in fixes} == {"smart double quote": 4, "broken bullet marker": 2}  # the canonical marker counts again in the second pass


def test_cap(spark):
    out = one(spark, "x" * 30000, lambda c: clean.cap_text(c, 9000))
    assert len(out) <= 9100 and "trimmed for length" in out
    assert one(spark, "short", clean.cap_text) == "short"


def test_names(spark):
    cases = [("Resume\nASHA RAO\nx@y.com", None, "Asha Rao"), ("Full Name: jo-ann smith", None, "JO Ann Smith"), ("Dr. Ravi K | Full Stack Developer", None, "Ravi K"), ("7237 - Lena Okoro", None, "Lena Okoro"), ("723723243097 - Lena Okoro", None, "Candidate"), ("ABC College\nSkills\nMeera", None, "Meera"), ("1", "2024_03_12_JohnDoe_resume_v2 (1).pdf", "John Doe"), ("123\n456 jo.doe99@mail.com", None, "JO Doe"), ("1234", "mira_sen_resume.pdf", "Mira Sen"), ("1", None, "Candidate")]
    for text, name, want in cases:
        df = spark.createDataFrame([(text, name)], "t string, f string")
        assert df.select(clean.extract_name(F.col("t"), F.col("f")).alias("n")).first()["n"] == want


def test_sections_and_entries(spark):
    text = "Jo\nExperience\nSkills\npython\nProjects\nLedger\n- Built it in python and docker\nRoute Finder\n* used redis\nSummary"
    lines = segment.assign_sections(segment.to_lines(spark.createDataFrame([(1, text)], "doc_id long, raw_text string")))
    got = [(r["section_no"], r["type"], r["lines"]) for r in segment.to_sections(lines).orderBy("section_no").collect()]
    assert got == [(0, "contact", ["Jo"]), (1, "experience", []), (2, "skills", ["python"]), (3, "projects", ["Ledger", "- Built it in python and docker", "Route Finder", "* used redis"])]
    entries = segment.to_projects(segment.to_sections(lines)).orderBy("entry_no").collect()
    assert [(e["name"], e["bullets"], e["tools"]) for e in entries] == [("Ledger", ["Built it in python and docker"], ["python", "docker"]), ("Route Finder", ["used redis"], ["redis"])]


def test_terms_need_boundaries(spark):
    from sievelake.functions.text import match_terms

    find = lambda t: one(spark, t, lambda c: match_terms(c, ("go", "c++", "c", "node.js", "spring boot", "ci/cd", "react")))
    assert find("Go, C++ and node.js; Spring Boot. CI/CD") == ["go", "c++", "node.js", "ci/cd"]  # a full stop is part of a term
    assert find("Django reaction c spring boot") == ["c", "spring boot"]
    assert find("") == []


def test_empty_document_scores_fifteen(spark):
    rows = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, raw_text string")
    got = {r["doc_id"]: (r["score"], r["jd_score"], r["tier"]) for r in scoring.score_corpus(rows).collect()}
    assert got == {1: (15, 30.0, "Tier 3: Overhaul Required"), 2: (15, 30.0, "Tier 3: Overhaul Required")}


def test_keywords_of_presets(spark):
    got = {r["jd_id"]: r["keywords"] for r in terms.jd_keywords(terms.job_descriptions(spark)).collect()}
    assert got[1] == ["python", "sql", "node.js", "redis", "docker"] and got[5] == ["python", "sql", "data analysis", "pandas", "numpy", "power bi"] and len(got) == 6
    few = spark.createDataFrame([(9, "Gardeners wanted, gardeners who prune roses and roses and mow")], "jd_id long, description string")
    assert terms.jd_keywords(few).first()["keywords"] == ["gardeners", "roses", "wanted", "prune", "mow"]


def test_issues(spark):
    text = "Responsable for managment and managment of the the app. I has a plan , ok. See github.com/managment now. Was dep1oyed."
    rows = issues.text_issues(spark.createDataFrame([(1, text)], "doc_id long, raw_text string")).orderBy("seq").collect()
    got = [(r["type"], r["error"], r["fix"]) for r in rows]
    assert ("spelling", "Responsable", "responsible") in got and got.count(("spelling", "managment", "management")) == 1
    assert ("repetition", "the the", "the") in got and ("grammar", "I has", "I have") in got and ("ocr", "dep1oyed", "deployed") in got
    assert [r["seq"] for r in rows] == list(range(1, len(rows) + 1))
    assert issues.issue_penalty(issues.text_issues(spark.createDataFrame([(1, text)], "doc_id long, raw_text string"))).first()["penalty"] <= 20


def test_layout_in_two_columns(spark):
    tokens = [(1, 1, 600.0, i, f"L{i}", 20.0, 700.0 - 20 * i, 30.0, 10.0) for i in range(12)] + [(1, 1, 600.0, 50 + i, f"R{i}", 350.0, 700.0 - 20 * i, 30.0, 10.0) for i in range(12)]
    tokens += [(2, 1, 600.0, 1, "one", 10.0, 500.0, 20.0, 10.0), (2, 1, 600.0, 2, "line", 40.0, 498.0, 20.0, 10.0), (2, 1, 600.0, 3, "next", 10.0, 480.0, 20.0, 10.0)]
    df = spark.createDataFrame(tokens, "doc_id long, page int, page_width double, seq int, str string, x double, y double, w double, h double")
    got = {r["doc_id"]: r["text"] for r in files.reconstruct_layout(df).collect()}
    assert got[1] == "\n".join(f"L{i}" for i in range(12)) + "\n\n" + "\n".join(f"R{i}" for i in range(12))
    assert got[2] == "one line\nnext"


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b" caf\xc3\xa9 \xff ", "b.pdf": b"x", "c.exe": b"x", ".hidden.txt": b"x", "empty.txt": b""}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["file_name"]: r for r in files.decode_text(files.read_files(spark, str(tmp_path))).collect()}
    assert sorted(rows) == ["a.txt", "b.pdf"] and rows["a.txt"]["text"] == "café �" and rows["b.pdf"]["text"] is None


def test_store_life_cycle(spark):
    t = datetime.datetime(2024, 1, 1)
    schema = "id string, file_name string, overall_score int, created_at timestamp, updated_at timestamp, is_deleted boolean"
    old = spark.createDataFrame([("1", "A.pdf", 50, t, t, True), ("2", "b.pdf", 60, t, t, False), ("3", "c.pdf", 70, t, t, False)], schema)
    new = spark.createDataFrame([("9", "a.PDF", 55, None, None, None), ("2", "renamed.pdf", 65, None, None, None), ("8", "new.pdf", 80, None, None, None)], schema)
    later = datetime.datetime(2025, 1, 1)
    got = {r["id"]: r for r in store.merge_results(old, new, later).collect()}
    assert sorted(got) == ["1", "2", "3", "8"]
    assert got["1"]["overall_score"] == 55 and got["1"]["created_at"] == t and not got["1"]["is_deleted"] and got["2"]["file_name"] == "renamed.pdf" and got["8"]["created_at"] == later
    ids = spark.createDataFrame([("2",)], "id string")
    assert store.purge(store.soft_delete(old, ids)).count() == 1 and store.restore(old).where("is_deleted").count() == 0 and store.delete_permanently(old, ids).count() == 2


def test_survivors(spark):
    rows = spark.createDataFrame([("a.pdf", 50.0, 1), ("A.PDF ", 50.0, 2), ("b.pdf", 10.0, 1), (None, 99.0, 1), ("", 99.0, 1)], "file_name string, effective_score double, seq int")
    assert sorted((r["file_name"], r["seq"]) for r in board.dedup_best(rows).collect()) == [("A.PDF ", 2), ("b.pdf", 1)]


def test_scores_from_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Jo\njo{i}@x.com\nSkills\npython, sql\nExperience\n- Built things in python {i} 2020 - 2022") for i in range(6)], "doc_id long, raw_text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pick = lambda df: scoring.score_corpus(df).select("doc_id", "score", "tier")
    sink = ledger.LedgerSink(f"file://{tmp_path}/out")
    streams.score_stream(source, pick, sink, str(tmp_path / "log"))
    got = sink.read(spark).select("doc_id", "score", "tier")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pick(rows).collect()))


def test_tally_equals_one_step_after_the_other(spark):
    r = random.Random(3)
    pieces = ["ﬁ", "ﬂ", "“", "”", "’", "–", "…", "\u00a0", "\u200b", "•", "·", "dep1oyed", "w0rd", "5QL", "0pen", "1ine", "5ome", "1O0", "re-\nuse", "\no Built", "\n| Made", "\nl Led", " ,", "  ", "\n\n\n", " \n", "word", "Word ", "\n", "- ", ")"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 25))) for _ in range(300)]
    got = {x["doc_id"]: x for x in clean.fix_tally(spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")).collect()}

    def sub(p, w, t):
        return re.subn(p.replace("(?md)", "(?m)"), w.replace("$", "\\"), t, flags=re.ASCII)

    for i, text in enumerate(texts):
        t, fixes = text, {}
        for kind, p, w in clean.STEPS:
            t, n = sub(p, w, t)
            if n:
                fixes[kind] = fixes.get(kind, 0) + n
        c = re.sub(r"\n{3,}", "\n\n", re.sub(" +\n", "\n", re.sub(r"[ \t]{2,}", " ", t))).strip()
        if len(t) > len(c):
            fixes["collapsed whitespace"] = len(t) - len(c)
        c, n = sub(clean.PUNCTUATION[0][1], clean.PUNCTUATION[0][2], c)
        if n:
            fixes[clean.PUNCTUATION[0][0]] = n
        assert [(f["kind"], f["count"]) for f in got[i]["fixes"]] == list(fixes.items())
        assert got[i]["clean"] == re.sub(r"\n([a-z,;)])", r" \1", c)
