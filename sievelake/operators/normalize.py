"""Model responses to results: JSON recovery, alias-tolerant reading of fields, reconciliation with the engine's report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import lexicons
from sievelake.operators import clean, scoring

TEXT_KEYS = ("text", "issue", "error", "description", "problem", "skill", "idea", "tip")


def _after(text: Column) -> Column:
    """From the first brace on, without reasoning blocks and code fences."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>", ""), r"(?i)</?think>", ""))
    fenced = F.trim(F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1))
    return F.when(fenced != "", fenced).otherwise(t)


def _scan(json: Column) -> Column:
    """A fold over characters: where the first object ends (0: nowhere), and what is still open at the end, innermost first."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        plain = ~a["escaped"] & ~a["quoted"] & (a["end"] == 0)
        opened = F.when(plain & (c == "{"), F.concat(F.lit("}"), a["open"])).when(plain & (c == "["), F.concat(F.lit("]"), a["open"])).when(plain & c.isin("}", "]") & (F.length(a["open"]) > 0), F.substring(a["open"], F.lit(2), F.length(a["open"]))).otherwise(a["open"])
        closes = plain & (c == "}") & (F.length(opened) == 0)
        return F.struct(
            (a["i"] + 1).alias("i"), opened.alias("open"), F.when(~a["escaped"] & (c == '"'), ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"),
            (~a["escaped"] & (c == "\\")).alias("escaped"), F.when(closes, a["i"] + 1).otherwise(a["end"]).alias("end"),
        )

    return F.aggregate(F.filter(F.split(json, ""), lambda c: c != ""), start, step)


def recover_json(df: DataFrame, col: str = "response") -> DataFrame:
    """df with json (variant) and reject (why there is none).

    Tried in order: the first whole object; it without trailing commas; what is left of a cut-off object, its last unfinished member dropped, closed; a score
    named anywhere in the text.
    """
    rows = df.withColumn("_t", _after(F.col(col)))
    rows = rows.withColumn("_t", F.when(F.instr("_t", "{") > 0, F.substring(F.col("_t"), F.instr("_t", "{"), F.length("_t"))).otherwise(F.col("_t")))
    rows = rows.withColumn("_s", F.when(F.startswith("_t", F.lit("{")), _scan(F.col("_t"))))
    whole = F.when(F.col("_s.end") > 0, F.substring(F.col("_t"), F.lit(1), F.col("_s.end"))).when(F.col("_s").isNotNull(), F.col("_t"))
    rows = rows.withColumn("_w", F.regexp_replace(whole, r",\s*([}\]])", "$1")).withColumn("_whole", whole)
    cut = F.regexp_replace(F.regexp_replace("_w", r',\s*"[^"]*"?\s*:?\s*[^,}\]]*$', ""), r",\s*$", "")
    rows = rows.withColumn("_cut", F.when(F.col("_s.end") == 0, cut))
    rows = rows.withColumn("_closed", F.when(F.col("_cut").isNotNull(), F.concat("_cut", _scan(F.col("_cut"))["open"])))
    score = F.regexp_extract(col, r"(?i)overall_score[\"':\s]+(\d+)", 1)
    told = F.when(score != "", F.concat(F.lit('{"overall_score":'), score, F.lit("}")))
    found = F.coalesce(*(F.try_parse_json(c) for c in ("_whole", "_w", "_closed")), F.try_parse_json(told))
    rows = rows.withColumn("json", found)
    return rows.withColumn("reject", F.when(F.col("json").isNull(), "no JSON in the response")).drop("_t", "_s", "_w", "_whole", "_cut", "_closed")


def pick(v: Column, keys: Sequence[str], kind: str) -> Column:
    """The first of several keys that holds something of a type."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{k}", kind) for k in keys))


def number(v: Column, keys: Sequence[str]) -> Column:
    """A number, or the number in a text."""
    text = F.regexp_replace(pick(v, keys, "string"), r"[^\d.-]", "")
    return F.regexp_extract(text, r"^(-?\d*\.?\d+)", 1).try_cast("double")


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.floor(c + 0.5)))).cast("int")


def texts(v: Column, keys: Sequence[str], most: int = 12) -> Column:
    """An array of texts from texts or objects, empty ones dropped."""
    items = F.coalesce(pick(v, keys, "array<variant>"), F.array().cast("array<variant>"))
    is_object = lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
    said = F.transform(items, lambda x: F.trim(F.when(is_object(x), pick(x, TEXT_KEYS, "string")).otherwise(F.try_variant_get(x, "$", "string"))))
    return F.slice(F.filter(said, lambda s: s.isNotNull() & (s != "")), 1, most)


def severity(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike("crit|high|severe|block"), "critical").when(low.rlike("minor|low|info"), "minor").otherwise("major")


def normalize_issues(v: Column, keys: Sequence[str] = ("critical_issues", "criticalIssues", "issues"), most: int = 12) -> Column:
    """Structs (severity, area, problem, evidence, fix) from objects or bare texts; of equal problems, without case, the first."""
    items = F.coalesce(pick(v, keys, "array<variant>"), F.array().cast("array<variant>"))
    is_object = lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
    field = lambda x, *k: F.when(is_object(x), F.coalesce(pick(x, k, "string"), F.lit(""))).otherwise("")
    made = F.transform(
        items,
        lambda x: F.struct(
            severity(field(x, "severity", "level")).alias("severity"), F.when(field(x, "area", "category") == "", "General").otherwise(field(x, "area", "category")).alias("area"),
            F.when(is_object(x), field(x, "problem", "issue", "text", "description")).otherwise(F.try_variant_get(x, "$", "string")).alias("problem"),
            field(x, "evidence").alias("evidence"), field(x, "fix", "suggestion").alias("fix"),
        ),
    )
    some = F.filter(made, lambda i: F.coalesce(i["problem"], F.lit("")) != "")
    lows = F.transform(some, lambda i: F.lower(i["problem"]))
    return F.slice(F.filter(some, lambda i, n: F.array_position(lows, F.lower(i["problem"])) == n + 1), 1, most)


def breakdown(v: Column) -> Column:
    """Structs (category, score, max), scores held between 0 and their maximum."""
    rows = F.coalesce(pick(v, ("score_breakdown", "scoreBreakdown"), "array<variant>"), F.array().cast("array<variant>"))
    most = lambda r: F.when(F.coalesce(number(r, ("max", "outOf")), F.lit(100.0)) == 0, 100.0).otherwise(F.coalesce(number(r, ("max", "outOf")), F.lit(100.0)))
    return F.transform(
        rows,
        lambda r: F.struct(F.coalesce(pick(r, ("category", "name"), "string"), F.lit("Category")).alias("category"), F.greatest(F.lit(0.0), F.least(most(r), F.coalesce(number(r, ("score", "value")), F.lit(0.0)))).alias("score"), most(r).alias("max")),
    )


def normalize_results(rows: DataFrame, json: str = "json", text: str | None = None, file_name: str | None = None, score: str | None = None, jd_score: str | None = None) -> DataFrame:
    """rows with the canonical fields of a response.

    score and jd_score: columns of the engine's own figures, which win over what the response says; else an explicit score, else the sum of three or more
    breakdown rows, else the JD score, else 0. text and file_name: where a name is looked for if the response gives none.
    """
    v = F.col(json)
    said = number(v, ("overall_score", "overallScore", "score"))
    parts = F.col("breakdown")
    total = F.when(F.size(parts) >= 3, F.aggregate(parts, F.lit(0.0), lambda a, r: a + r["score"]))
    told = F.coalesce(number(v, ("jd_match.score", "jdMatch.score", "jd_score", "jdScore")))
    engine = F.col(score).cast("double") if score else F.lit(None).cast("double")
    overall = F.coalesce(engine, clamp(said).cast("double"), F.when(total > 0, clamp(total).cast("double")), clamp(told).cast("double"), F.lit(0.0))
    out = rows.withColumn("breakdown", breakdown(v)).withColumn("overall_score", overall.cast("int"))
    own = F.col(jd_score).cast("double") if jd_score else F.lit(None).cast("double")
    name = F.trim(pick(v, ("candidate_name", "candidateName", "name"), "string"))
    named = (F.length(name) >= 2) & ~F.lower(name).contains("unnamed") & ~name.rlike(r"(?i)^(candidate|resume|cv|document|profile|career\s+objective|summary)$")
    fallback = clean.extract_name(F.col(text) if text else F.lit(""), F.col(file_name) if file_name else None)
    return out.withColumns({
        "jd_score": F.coalesce(own, clamp(told).cast("double"), clamp(F.col("overall_score") * 0.88).cast("double")),
        "candidate_name": F.when(named, name).otherwise(fallback),
        "role": F.coalesce(pick(v, ("assumed_role", "assumedRole", "inferred_role", "role", "target_role", "targetRole", "title"), "string"), F.lit("—")),
        "readiness_tier": scoring.tier(F.col("overall_score"), F.lit(False), pick(v, ("readiness_tier", "readinessTier", "tier"), "string")),
        "strengths": texts(v, ("strengths",), 6),
        "matched": texts(v, ("skill_matrix.matched_skills", "skill_matrix.matched_keywords", "skill_matrix.matched", "skillMatrix.matched", "matched_skills", "matched_keywords"), 60),
        "missing": texts(v, ("skill_matrix.missing_skills", "skill_matrix.missing_critical_skills", "skill_matrix.missing", "skillMatrix.missing", "missing_skills", "missingKeywords"), 60),
        "recommended": texts(v, ("skill_matrix.recommended_skills", "skill_matrix.recommended", "skillMatrix.recommended", "recommended_skills"), 60),
        "issues": normalize_issues(v),
    })


#: The sections that a response may audit: name, highest score, score if nothing is said, what its breakdown row is called, and names that responses use for it.
AUDITS = (
    ("summary", 10, 8, "summary", ("summary", "summary_audit", "professional_summary")),
    ("skills", 30, 25, "skills", ("skills", "skills_audit", "technical_skills_audit", "technical_skills")),
    ("projects", 35, 28, "project", ("projects", "projects_audit", "project_work")),
    ("internships", 20, 16, "internship", ("internships", "internship_experience_audit", "internship_experience", "internships_audit", "experience")),
    ("certifications", 5, 4, "cert", ("certifications", "certifications_audit", "accreditations")),
    ("achievements", 15, 12, "achieve", ("achievements", "achievements_audit", "awards")),
)
#: The members of an audit, with the names that responses use for them.
AUDIT_KEYS = {
    "audit": ("audit", "critique", "assessment"), "fix_tip": ("fix_tip", "fixTip", "tip", "recommendation"), "matched": ("matched_keywords", "matchedKeywords", "matched"),
    "missing": ("missing_critical_skills", "missingCriticalSkills", "missing"), "architecture": ("architecture_rating", "architectureRating", "complexity"),
    "live_proof": ("live_proof", "liveProof", "has_links", "verifiable"), "relevance": ("jd_relevance_pct", "jdRelevancePct", "relevance_pct", "relevance"),
    "relevance_note": ("jd_relevance_explanation", "jdRelevanceExplanation", "relevance_explanation"), "count": ("verified_count", "verifiedCount", "count"),
}


def truthy(v: Column, keys: Sequence[str]) -> Column:
    """Whether the first of several keys that is there holds something: not false, 0 or an empty text."""
    said = pick(v, keys, "string")
    return F.coalesce(~said.isin("false", "0", "0.0", ""), F.lit(False))


def section_audits(v: Column, rows: Column) -> Column:
    """Structs (section, score, max, audit, fix_tip, and what only some sections have) in the order of AUDITS, of a response and its breakdown() rows.

    A score is what the response says, a number or a text with one, else the section's breakdown row scaled to its highest score, else a default; it is
    rounded and held between 0 and the highest. Texts that are not said are empty; relevance is 80 and the count of certificates 1 if nothing is said.
    """
    home = ("section_audits", "sectionAudits", "sections")
    row_of = lambda word: F.get(F.filter(rows, lambda r: F.contains(F.lower(r["category"]), F.lit(word))), F.lit(0))
    made = []
    for name, most, default, called, aliases in AUDITS:
        own = [f"{h}.{a}" for h in home for a in aliases]
        under = lambda keys, own=own: [f"{o}.{k}" for o in own for k in keys]
        row = row_of(called)
        scaled = F.when(row.isNotNull(), F.least(F.lit(most), F.floor(row["score"] / row["max"] * most + 0.5)))
        only = lambda c, *names, name=name: c if name in names else F.lit(None)
        text = lambda k, under=under: F.coalesce(pick(v, under(AUDIT_KEYS[k]), "string"), F.lit(""))
        made.append(F.struct(
            F.lit(name).alias("section"), clamp(F.coalesce(number(v, under(("score",))), scaled.cast("double"), F.lit(float(default))), 0, most).alias("score"), F.lit(most).alias("max"), text("audit").alias("audit"), text("fix_tip").alias("fix_tip"),
            only(texts(v, under(AUDIT_KEYS["matched"])), "skills").cast("array<string>").alias("matched"), only(texts(v, under(AUDIT_KEYS["missing"])), "skills").cast("array<string>").alias("missing"),
            only(text("architecture"), "projects").cast("string").alias("architecture"), only(truthy(v, under(AUDIT_KEYS["live_proof"])), "projects").cast("boolean").alias("live_proof"),
            only(clamp(F.coalesce(number(v, under(AUDIT_KEYS["relevance"])), F.lit(80.0))), "internships").cast("int").alias("relevance"), only(text("relevance_note"), "internships").cast("string").alias("relevance_note"),
            only(clamp(F.coalesce(number(v, under(AUDIT_KEYS["count"])), F.lit(1.0)), 0, 10), "certifications").cast("int").alias("count"),
        ))
    return F.array(*made)


ISSUE = "struct<severity:string,area:string,problem:string,evidence:string,fix:string>"


def derive_issues(rows: DataFrame, most: int = 12) -> DataFrame:
    """Issues for results that came without any and are weak, under 80 or blocked: from blockers, missing sections, bullets without figures, and missing skills.

    rows: issues, overall_score and missing; and of the engine's report, where there is one: blockers, sections (ids found), bullets, quantified. A missing
    experience section is none where there are projects or four bullets; education, certificates and awards are never asked for. Equal problems, without
    case, count once.
    """
    none = F.array().cast(f"array<{ISSUE}>")
    issue = lambda s, area, problem, evidence, fix: F.struct(*(F.lit(x).alias(n) if isinstance(x, str) else x.alias(n) for n, x in zip(("severity", "area", "problem", "evidence", "fix"), (s, area, problem, evidence, fix), strict=True)))
    has = lambda *names: all(n in rows.columns for n in names)
    blocked = F.size("blockers") > 0 if has("blockers") else F.lit(False)
    parts = [F.transform("blockers", lambda b: issue("critical", "Blocker", b, "found by the engine", "Resolve it: documents with it are not read further")) if has("blockers") else none]
    if has("sections", "bullets", "quantified"):
        for i, label, need in lexicons.SECTIONS:
            if need and not any(w in label for w in ("Education", "Certifications", "Achievements", "Extracurricular")):
                gone = ~F.array_contains("sections", i)
                if i == "experience":
                    gone = gone & ~F.array_contains("sections", "projects") & (F.col("bullets") < 4)
                severe = "critical" if "Projects" in label or "Skills" in label else "major"
                parts.append(F.when(gone, F.array(issue(severe, "Missing Section", f"Missing section: {label}", f"no header for {label}", f"Add a section {label} with bullets"))).otherwise(none))
        bare = (F.col("bullets") > 0) & (F.col("quantified") == 0)
        parts.append(F.when(bare, F.array(issue("major", "Quantified Impact", "No measurable outcomes in bullets", F.format_string("%d bullets, none with a figure", "bullets"), "Add figures to what you describe"))).otherwise(none))
    first = lambda n, by: F.array_join(F.slice("missing", 1, n), by)
    gaps = issue("major", "Technical Gaps", F.concat(F.lit("Missing skills: "), first(3, ", ")), F.concat(F.lit("not in the text: "), first(3, ", ")), F.concat(F.lit("Show work with "), first(2, " and ")))
    parts.append(F.when(F.size("missing") > 0, F.array(gaps)).otherwise(none))
    weak = (F.size("issues") == 0) & ((F.col("overall_score") < 80) | blocked)
    made = F.concat(*(p.cast(f"array<{ISSUE}>") for p in parts))
    lows = F.transform(made, lambda i: F.lower(F.trim(i["problem"])))
    once = F.slice(F.filter(made, lambda i, n: F.array_position(lows, F.lower(F.trim(i["problem"]))) == n + 1), 1, most)
    return rows.withColumn("issues", F.when(weak, once).otherwise(F.col("issues")))
