"""Results from reports: promoted columns, strengths, issues, rewrites, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import lexicons
from sievelake.operators import clean, issues, scoring, segment, terms

PREFIXES = ("Engineered and delivered", "Designed and implemented", "Built and optimized")

# Check, severity and advice of the issues that failed checks raise.
ADVICE = (
    ("email", "critical", "Add a machine-readable email address"),
    ("phone", "major", "Add a phone number"),
    ("linkedin", "minor", "Add a LinkedIn profile URL"),
    ("portfolio", "minor", "Add a GitHub or portfolio link"),
    ("jd-skills", "major", "Add the missing skills of the job description that you can prove"),
    ("skill-breadth", "major", "List more of the technologies you have used"),
    ("skill-count", "major", "Name skills in project bullets"),
    ("tooling", "minor", "Name modern tooling"),
    ("project-count", "major", "Describe at least two projects"),
    ("project-depth", "major", "Add measurable outcomes"),
    ("project-verbs", "minor", "Open bullets with strong verbs"),
    ("dates", "major", "Add date ranges"),
    ("exp-explanation", "major", "Explain responsibilities"),
    ("summary", "minor", "Add a short summary"),
    ("typos", "major", "Correct spelling"),
)


def strengths(n: int = 3) -> Column:
    """The first n passed checks that give three points or more."""
    return F.slice(F.transform(F.filter("checks", lambda c: c["passed"] & (c["points"] >= 3)), lambda c: c["id"]), 1, n)


def issues_of_report() -> Column:
    """Structs (severity, area, problem): blockers, then missing required sections, then the first three failed checks."""
    severity = F.create_map(*(F.lit(x) for i, s, _ in ADVICE for x in (i, s)))
    advice = F.create_map(*(F.lit(x) for i, _, t in ADVICE for x in (i, t)))
    blocked = F.transform("blockers", lambda b: F.struct(F.lit("critical").alias("severity"), F.lit("parse").alias("area"), b.alias("problem")))
    need = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("label")) for i, n, required in lexicons.SECTIONS if required))
    missing = F.transform(F.filter(need, lambda s: ~F.array_contains("sections", s["id"])), lambda s: F.struct(F.lit("major").alias("severity"), F.lit("sections").alias("area"), F.concat(F.lit("Missing section: "), s["label"]).alias("problem")))
    failed = F.slice(F.filter("checks", lambda c: ~c["passed"]), 1, 3)
    told = F.transform(failed, lambda c: F.struct(F.when(F.size("blockers") > 0, F.element_at(severity, c["id"])).otherwise(F.when(F.element_at(severity, c["id"]) == "critical", "major").otherwise(F.element_at(severity, c["id"]))).alias("severity"), c["category"].alias("area"), F.element_at(advice, c["id"]).alias("problem")))
    return F.concat(blocked, missing, told)


def section_audits() -> Column:
    """Structs (category, score, max, percent, note): each category of a report, with the checks that it failed."""
    def one(name: str, most: int) -> Column:
        failed = F.transform(F.filter("checks", lambda c: (c["category"] == name) & ~c["passed"]), lambda c: c["id"])
        score = F.col(f"score_{name}")
        note = F.when(F.size(failed) == 0, "all checks passed").otherwise(F.concat(F.lit("failed: "), F.array_join(failed, "; ")))
        return F.struct(F.lit(name).alias("category"), score.alias("score"), F.lit(most).alias("max"), F.floor(score * 100 / most + 0.5).cast("int").alias("percent"), note.alias("note"))

    return F.array(*(one(n, m) for n, m in scoring.CATEGORIES))


def rewrite_bullets(bullets: Column, n: int = 3) -> Column:
    """Structs (original, rewritten) of the first n weak bullets, prefixes taken in turn."""
    weak = F.slice(F.filter(bullets, segment.is_weak), 1, n)
    prefixes = F.array(*(F.lit(p) for p in PREFIXES))
    bare = lambda b: F.regexp_replace(b, r"(?i)^(assisted with|helped with|worked on|responsible for|duties included|tasked with|involved in|participated in|handled|contributed to)\s*", "")
    return F.transform(weak, lambda b, i: F.struct(b.alias("original"), F.concat(F.get(prefixes, i % len(PREFIXES)), F.lit(" "), bare(b)).alias("rewritten")))


def impression() -> Column:
    """What a first look shows, in two sentences: projects with their skills, or what is there without any."""
    names, skills = F.array_join(F.slice("project_names", 1, 2), ", "), F.array_join(F.slice("skills", 1, 3), ", ")
    shown = F.format_string("%d projects (%s) with %s. %s", F.size("project_names"), names, F.when(skills == "", "no skill named").otherwise(skills), F.when(F.col("overall_score") >= 75, "Ready for a technical interview.").otherwise("Results need figures before a competitive screening."))
    bare = F.when(F.col("overall_score") >= 80, "Clear and well ordered, with skills that can be told at once.").otherwise("A start that needs project work with measured outcomes.")
    return F.when(F.size("project_names") > 0, shown).otherwise(bare)


def verdict() -> Column:
    """What is to be done with a candidate: blockers first, else shortlist or refine."""
    blocked = F.format_string("%d critical items: %s. To be resolved before the document is passed on.", F.size("blockers"), F.array_join("blockers", "; "))
    refine = F.concat(F.lit("Refine the figures in "), F.when(F.size("project_names") > 0, F.concat(F.lit("'"), F.get("project_names", F.lit(0)), F.lit("'"))).otherwise("projects"), F.lit(" before it goes to recruiters."))
    return F.when(F.size("blockers") > 0, blocked).when(F.col("overall_score") >= 75, F.concat(F.lit("Ready for the shortlist as "), "role", F.lit("."))).otherwise(refine)


IDEAS = ("Measure latency or throughput and say so in project bullets", "Deploy with a live link and documented interfaces")


def with_details(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """build_results() rows with what exports tell besides: project_names, rewrites, grammar (issue lines), tech_ideas, project_ideas, impression, verdict."""
    lines = segment.to_lines(docs, id_col, text_col)
    projects = segment.to_projects(segment.to_sections(segment.assign_sections(lines, id_col), id_col), id_col).where("name <> ''")
    names = projects.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "name"))), lambda x: x["name"]).alias("project_names"))
    bullets = segment.to_bullets(lines).where(segment.is_weak(F.col("bullet"))).groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "bullet"))), lambda x: x["bullet"]).alias("b"))
    rewrites = bullets.select(id_col, rewrite_bullets(F.col("b")).alias("rewrites"))
    grammar = issues.format_issues(issues.text_issues(docs, None, id_col, text_col), id_col).withColumnRenamed("lines", "grammar")
    out = rows.join(names, id_col, "left").join(rewrites, id_col, "left").join(grammar, id_col, "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({"project_names": F.coalesce("project_names", empty), "grammar": F.coalesce("grammar", empty), "rewrites": F.coalesce("rewrites", F.array().cast("array<struct<original:string,rewritten:string>>"))})
    ideas = F.when((F.col("evaluation_basis") == "jd-fit") & (F.size("missing") > 0), F.transform(F.slice("missing", 1, 4), lambda k: F.concat(F.lit("Build a project that shows "), k))).otherwise(F.array(*map(F.lit, IDEAS)))
    lacking = F.exists("issues", lambda i: i["problem"] == "Missing section: Projects")
    out = out.withColumns({"tech_ideas": ideas, "project_ideas": F.when(lacking, F.array(F.lit("Add two projects of some size, with live links"))).otherwise(empty)})
    return out.withColumns({"impression": impression(), "verdict": verdict()})


def build_results(docs: DataFrame, reports: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """The results table: one row for each document of a report, with what boards and stores need."""
    kept = _with_names(docs, id_col, text_col).select(id_col, "file_name", "seq", "jd_id", *_TOLD)
    return _promoted(kept.join(reports.drop("jd_id"), id_col), "keywords" in reports.columns, id_col)


def score_results(docs: DataFrame, jds: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """build_results() of the reports of the same documents, in one pass over them, without a join by document: columns that nobody reads are not made."""
    rows = _with_names(docs, id_col, text_col)
    return _promoted(scoring.score_corpus(rows, jds, id_col, text_col, keep=("file_name", "seq", "jd_id", *_TOLD)), jds is not None, id_col)


_TOLD = ("candidate_name", "track", "assumed_role")


def _with_names(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = terms.with_role(docs, id_col=id_col, text_col=text_col)
    return rows.withColumns({"candidate_name": clean.extract_name(text, F.col("file_name")), "track": terms.track(text), "assumed_role": F.col("role.arc")}).drop("role")


def _promoted(both: DataFrame, custom: bool, id_col: str) -> DataFrame:
    both = both.withColumn("issues", issues_of_report()).withColumn("recommended", terms.not_owned(F.col("track"), F.col("skills")))
    return both.select(
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias(id_col), "file_name", "seq", "jd_id", "candidate_name", F.col("assumed_role").alias("role"), "assumed_role", F.col("assumed_role").alias("role_arc"),
        F.col("score").alias("overall_score"), F.col("tier").alias("readiness_tier"), F.lit("jd-fit" if custom else "general").alias("evaluation_basis"), "jd_score",
        (F.col("matched") if custom else F.col("skills")).alias("matched"), (F.col("missing") if custom else F.array().cast("array<string>")).alias("missing"), "recommended", "skills", "proven", "issues", "blockers",
        strengths().alias("strengths"), F.size("issues").alias("n_issues"), F.size(F.filter("issues", lambda i: i["severity"] == "critical")).alias("n_critical"),
    )


def terms_found(text: Column) -> Column:
    from sievelake.functions.text import match_terms

    return match_terms(text, lexicons.SKILLS)


def with_effective(results: DataFrame) -> DataFrame:
    """Adds effective_score and fit."""
    return results.withColumn("effective_score", scoring.effective_score()).withColumn("fit", scoring.fit_score(F.col("jd_score"), F.col("effective_score")))


def reevaluate(old: DataFrame, docs: DataFrame, ids: DataFrame, keywords: Column, id_col: str = "doc_id") -> DataFrame:
    """Results in which the rows of ids (column id) are scored anew against other keywords; their manual score is reset, their notes stay.

    Only the documents of ids are scored. old: build_results() rows with manual_score and officer_notes.
    """
    chosen = ids.select("id").distinct()
    some = docs.join(old.join(chosen, "id", "left_semi").select(id_col), id_col, "left_semi")
    one = docs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("jd_id"), keywords.alias("keywords"))
    asked = some.withColumn("jd_id", F.lit(-1).cast("long"))
    fresh = build_results(asked, scoring.score_corpus(asked, one, id_col=id_col), id_col)
    notes = old.join(chosen, "id", "left_semi").select("id", "officer_notes")
    fresh = fresh.join(notes, "id", "left").withColumn("manual_score", F.lit(None).cast("double"))
    return old.join(chosen, "id", "left_anti").unionByName(fresh, allowMissingColumns=True)
