import json

from sievelake.operators import normalize

SHAPES = [
    '{"overall_score":72}', '```json\n{"overall_score":72}\n```', '<think>let me see {</think>\n{"overall_score":72}', 'Here it is:\n{"overall_score":72}', '{"overall_score":72}\nHope that helps! }',
    '{"overall_score":72,}', '{"overall_score":72,"note":"use {curly} \\" braces","o":{"a":1}}', '{"overall_score":72,"strengths":["a","b"],"hr_verdict":"cut of', 'the overall_score: 72 I think',
]


def test_recovery(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*SHAPES, "no json at all here", "", None])], "doc_id long, response string")
    rows = normalize.normalize_results(normalize.recover_json(df)).orderBy("doc_id").collect()
    assert [r["overall_score"] for r in rows[: len(SHAPES)]] == [72] * len(SHAPES) and all(r["reject"] is None for r in rows[: len(SHAPES)])
    assert all(r["reject"] for r in rows[len(SHAPES) :]) and rows[7]["strengths"] == ["a", "b"]


def test_aliases_and_coercion(spark):
    said = {
        "candidate_name": "Priya Sharma", "role": "Backend Engineer", "overall_score": "68", "score_breakdown": [{"category": "A", "score": 28, "max": 25}, {"name": "B", "value": -3, "outOf": 25}],
        "strengths": ["Strong Java", {"text": "Real internship"}, ""], "critical_issues": [{"severity": "CRITICAL", "problem": "No results"}, "Formatting is uneven", "formatting is uneven"],
        "skill_matrix": {"matched_skills": ["Java", "Spring Boot"], "missing_skills": ["Docker"]}, "jd_match": {"score": 61},
    }
    df = spark.createDataFrame([(1, json.dumps(said)), (2, "{}"), (3, '{"score": 250, "candidateName": "Unnamed candidate"}'), (4, '{"overallScore": -5}'), (5, '{"scoreBreakdown": [{"score": 20}, {"score": 20}, {"score": 21.4}]}')], "doc_id long, response string")
    got = {r["doc_id"]: r for r in normalize.derive_issues(normalize.normalize_results(normalize.recover_json(df))).collect()}
    a = got[1]
    assert (a["candidate_name"], a["role"], a["overall_score"], a["jd_score"], a["readiness_tier"]) == ("Priya Sharma", "Backend Engineer", 68, 61.0, "Tier 2: Needs Minor Polish")
    assert [(b["category"], b["score"]) for b in a["breakdown"]] == [("A", 25.0), ("B", 0.0)]
    assert a["strengths"] == ["Strong Java", "Real internship"] and a["matched"] == ["Java", "Spring Boot"] and a["missing"] == ["Docker"]
    assert [(i["severity"], i["problem"]) for i in a["issues"]] == [("critical", "No results"), ("major", "Formatting is uneven")]
    assert [got[i]["overall_score"] for i in (2, 3, 4, 5)] == [0, 100, 0, 61] and got[3]["candidate_name"] == "Candidate" and got[4]["jd_score"] == 0.0
    assert got[5]["issues"] == [] and got[1]["issues"] == a["issues"]


def test_derived_issues(spark):
    form = "doc_id long, issues array<struct<severity:string,area:string,problem:string,evidence:string,fix:string>>, overall_score int, missing array<string>, blockers array<string>, sections array<string>, bullets int, quantified int"
    told = [("major", "a", "b", "c", "d")]
    rows = [(1, [], 50, ["go", "rust", "sql", "c"], ["no email", "No Email "], ["skills"], 3, 0), (2, [], 90, ["go"], [], ["skills"], 0, 0), (3, told, 10, [], ["x"], [], 0, 0), (4, [], 95, [], ["x"], ["contact", "skills", "projects"], 9, 2)]
    got = {r["doc_id"]: [(i["severity"], i["area"], i["problem"]) for i in r["issues"]] for r in normalize.derive_issues(spark.createDataFrame(rows, form)).collect()}
    assert got[2] == [] and got[3] == [("major", "a", "b")] and got[4] == [("critical", "Blocker", "x")]
    assert [x[:2] for x in got[1]][0] == ("critical", "Blocker") and sum(x[1] == "Blocker" for x in got[1]) == 1
    assert ("major", "Quantified Impact", "No measurable outcomes in bullets") in got[1] and ("major", "Technical Gaps", "Missing skills: go, rust, sql") in got[1]
    assert {x[2] for x in got[1] if x[1] == "Missing Section"} >= {"Missing section: Projects"} and all(x[0] == "critical" for x in got[1] if "Projects" in x[2])


def test_section_audits(spark):
    said = [
        {"section_audits": {"summary": {"score": 99, "audit": "fine"}, "skills_audit": {"score": "21", "matched": ["go", {"skill": "sql"}, ""], "missing": "x"}, "projects": {"liveProof": True, "complexity": "high"}, "experience": {"relevance": 140}, "certifications": {"count": "3", "score": -2}}},
        {"sectionAudits": {"professional_summary": {"critique": "short", "tip": "more"}}, "score_breakdown": [{"category": "Project depth", "score": 10, "max": 20}, {"category": "Skills", "score": 3}]},
        {"sections": {"projects": {"live_proof": False}}}, {},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(said)], "doc_id long, response string")
    v = normalize.F.col("json")
    rows = [{a["section"]: a for a in r["a"]} for r in normalize.recover_json(df).select("doc_id", normalize.section_audits(v, normalize.breakdown(v)).alias("a")).orderBy("doc_id").collect()]
    assert [[a[s]["score"] for s, *_ in normalize.AUDITS] for a in rows] == [[10, 21, 28, 16, 0, 12], [8, 1, 18, 16, 4, 12], [8, 25, 28, 16, 4, 12], [8, 25, 28, 16, 4, 12]]
    assert rows[0]["summary"]["audit"] == "fine" and rows[1]["summary"]["audit"] == "short" and rows[1]["summary"]["fix_tip"] == "more" and rows[0]["skills"]["matched"] == ["go", "sql"] and rows[0]["skills"]["missing"] == []
    assert rows[0]["projects"]["live_proof"] and rows[0]["projects"]["architecture"] == "high" and not rows[2]["projects"]["live_proof"] and rows[0]["internships"]["relevance"] == 100 and rows[3]["internships"]["relevance"] == 80
    assert [r["certifications"]["count"] for r in rows] == [3, 1, 1, 1] and rows[0]["summary"]["matched"] is None


def test_engine_figures_win(spark):
    df = spark.createDataFrame([(1, '{"overall_score": 99, "jd_score": 98}', 40, 35.5)], "doc_id long, response string, s int, j double")
    r = normalize.normalize_results(normalize.recover_json(df), score="s", jd_score="j").first()
    assert (r["overall_score"], r["jd_score"], r["readiness_tier"]) == (40, 35.5, "Tier 3: Overhaul Required")
