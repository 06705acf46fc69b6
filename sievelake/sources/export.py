"""Exports of results: ranked CSV, Markdown, message drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.operators.board import with_rank


# The columns of the CSV export, in order.
CSV_COLUMNS = (
    "Rank", "Candidate Name", "File Name", "Final Score (0-100)", "Readiness Tier", "Target Role", "Fit Score", "Evaluation Standard", "Recruiter 6-Sec Scan", "Placement Officer Verdict", "Verified Strengths", "Action Items & Fixes",
    "Matched Skills", "Missing Skills", "Priority Tech to Learn", "Recommended Projects", "Sample Bullet Rewrite", "ATS Formatting & Typos", "Officer Notes",
)


def _or(c: Column, default: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(c)


def _numbered(items: Column, text) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), text(x))), "\n")


def csv_rows(results: DataFrame) -> DataFrame:
    """The ranked table of an export, by rank, in 19 columns. results: with_details() rows with effective_score and fit, and with rank and officer_notes if there are any."""
    rows = results if "officer_notes" in results.columns else results.withColumn("officer_notes", F.lit(None).cast("string"))
    ranked = rows if "rank" in rows.columns else with_rank(rows)
    issue = lambda i: F.concat(F.lit("["), F.upper(i["severity"]), F.lit("] "), i["problem"])
    listed = lambda c: F.array_join(c, ", ")
    sample = F.get("rewrites", F.lit(0))
    rewrite = F.when(F.size("rewrites") > 0, F.concat(F.lit('Original: "'), sample["original"], F.lit('"\nRewritten: "'), sample["rewritten"], F.lit('"'))).otherwise("—")
    polish = F.filter("grammar", lambda g: ~F.contains(F.lower(g), F.lit("wrong ->")) & ~F.contains(F.lower(g), F.lit("no error")))
    return ranked.select(
        F.col("rank").alias("Rank"), F.col("candidate_name").alias("Candidate Name"), F.col("file_name").alias("File Name"), F.col("effective_score").alias("Final Score (0-100)"), F.col("readiness_tier").alias("Readiness Tier"),
        _or(F.coalesce("role", "assumed_role"), "—").alias("Target Role"), F.concat(F.regexp_replace(F.col("fit").cast("string"), r"\.0$", ""), F.lit("%")).alias("Fit Score"),
        F.when(F.col("evaluation_basis") == "jd-fit", "Custom JD").otherwise("Global SDE Benchmark").alias("Evaluation Standard"),
        _or(F.col("impression"), "—").alias("Recruiter 6-Sec Scan"), _or(F.col("verdict"), "—").alias("Placement Officer Verdict"),
        _or(_numbered(F.col("strengths"), lambda s: s), "None recorded").alias("Verified Strengths"), _or(_numbered(F.col("issues"), issue), "0 critical issues").alias("Action Items & Fixes"),
        _or(listed("matched"), "—").alias("Matched Skills"), _or(listed("missing"), "—").alias("Missing Skills"), _or(listed("recommended"), "").alias("_learn"), _or(listed("tech_ideas"), "—").alias("_ideas"),
        _or(_numbered(F.col("project_ideas"), lambda s: s), "—").alias("Recommended Projects"), rewrite.alias("Sample Bullet Rewrite"), _or(F.array_join(polish, "\n"), "Clean ATS format").alias("ATS Formatting & Typos"),
        F.coalesce("officer_notes", F.lit("")).alias("Officer Notes"),
    ).withColumn("Priority Tech to Learn", F.when(F.col("_learn") == "", F.col("_ideas")).otherwise(F.col("_learn"))).select(*CSV_COLUMNS)


def export_csv(results: DataFrame, path: str) -> None:
    """All fields quoted, CRLF, in rank order across part files; the first header name carries the byte order mark."""
    rows = csv_rows(results).orderBy("Rank").withColumnRenamed("Rank", "﻿Rank")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def markdown() -> Column:
    """A with_details() row as Markdown: sections only if they hold something, no empty lines."""
    block = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), body))
    bullets = lambda items, text=lambda s: s: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), text(x))), "\n")
    or_dash = lambda c: _or(F.array_join(c, ", "), "—")
    fit = F.concat(F.regexp_replace(F.col("fit").cast("string"), r"\.0$", ""), F.lit("/100"))
    score = F.regexp_replace(F.col("effective_score").cast("string"), r"\.0$", "")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("candidate_name"), F.lit(" — "), score, F.lit("/100")),
        F.concat(F.lit("**File:** "), F.col("file_name")), F.concat(F.lit("**Target role:** "), F.col("role")), F.concat(F.lit("**Readiness:** "), F.col("readiness_tier")), F.concat(F.lit("**JD fit:** "), fit),
        block("First impression", F.col("impression")),
        block("Verdict", F.col("verdict")),
        block("How this was evaluated", F.when(F.col("evaluation_basis") == "jd-fit", "Against the supplied job description.").otherwise(F.concat(F.lit("Against the default role: "), _or(F.col("assumed_role"), "—"), F.lit(".")))),
        block("Issues to fix", bullets(F.col("issues"), lambda i: F.concat(F.lit("**["), F.upper(i["severity"]), F.lit("] "), i["area"], F.lit("** — "), i["problem"]))),
        block("Strengths", bullets(F.col("strengths"))),
        block("Skill matrix", F.concat(F.lit("- **Matched:** "), or_dash("matched"), F.lit("\n- **Missing:** "), or_dash("missing"), F.lit("\n- **Learn next:** "), or_dash("recommended"))),
        block("Bullet rewrites", bullets(F.col("rewrites"), lambda r: F.concat(F.lit("**Before:** "), r["original"], F.lit("\n  - **After:** "), r["rewritten"]))),
        block("Technical improvement plan", bullets(F.col("tech_ideas"))),
        block("Project suggestions", bullets(F.col("project_ideas"))),
        block("Grammar and OCR errors", bullets(F.col("grammar"))),
    )


def export_markdown(results: DataFrame, path: str) -> None:
    """One record for each candidate, parted by ---."""
    results.select(F.concat(markdown(), F.lit("\n---")).alias("value")).write.text(path)


def draft_messages(results: DataFrame, role: str, company: str) -> DataFrame:
    """(id, subject, body): a letter of feedback for each result."""
    fixes = F.array_join(F.slice(F.transform("issues", lambda i: F.concat(F.lit("- "), i["problem"])), 1, 5), "\n")
    body = F.concat_ws(
        "\n\n", F.concat(F.lit("Dear "), F.col("candidate_name"), F.lit(",")), F.format_string(f"Thank you for applying for {role} at {company}. Your document scored %d of 100 (%s).", F.col("effective_score").cast("int"), F.col("readiness_tier")),
        F.when(fixes != "", F.concat(F.lit("What would help most:\n"), fixes)), F.lit("Kind regards"),
    )
    return results.select("id", F.concat(F.lit(f"Your application: {role} — "), F.col("readiness_tier")).alias("subject"), body.alias("body"))


def draft_review(results: DataFrame) -> DataFrame:
    """(id, review): a plain block of lines."""
    part = lambda name, items: F.concat(F.lit(f"{name}: "), _or(F.array_join(items, ", "), "none"))
    return results.select("id", F.concat_ws("\n", F.concat(F.col("candidate_name"), F.lit(" — "), F.col("effective_score").cast("string"), F.lit("/100")), F.col("readiness_tier"), part("Strengths", "strengths"), part("Missing", "missing"), part("Problems", F.transform("issues", lambda i: i["problem"]))).alias("review"))
