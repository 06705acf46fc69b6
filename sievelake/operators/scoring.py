"""The explainable score: checks, categories, total, tier and band."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import lexicons
from sievelake.functions.text import either, found_terms, in_order, one_decimal, terms_in, word_count
from sievelake.operators import issues, segment, terms

CATEGORIES = (("parse", 20), ("skills", 30), ("projects", 25), ("experience", 15), ("hygiene", 10))
#: Columns of terms and their vocabularies; n_ and the name: how many.
_VOCABULARIES = {"skills": lexicons.SKILLS, "proven": lexicons.SKILLS, "high_bar": lexicons.HIGH_BAR_SIGNALS}
CHECK = "struct<category:string,id:string,passed:boolean,points:double,max:int>"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", jds: DataFrame | None = None, jd_col: str = "jd_id", keep: Sequence[str] = ()) -> DataFrame:
    """One row for each document with all that the checks look at, made in place. jds: (jd_id, keywords) joined by jd_col, or none; keep: further columns of docs that stay."""
    text = F.col("text")
    kept = dict.fromkeys([id_col, *([jd_col] if jds is not None else []), *keep])
    rows = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = segment.with_line_features(issues.with_typos(rows, id_col, "text"))
    rows = rows.withColumns({
        "words": word_count(text), **segment.contact_signals(text), "has_dates": segment.has_date_range(text), "_skills": F.array_distinct(found_terms(text, lexicons.SKILLS)), "repetitions": issues.repetitions(text),
        "_proven": F.array_distinct(found_terms(F.col("bullet_text"), lexicons.SKILLS)), "_high_bar": F.array_distinct(found_terms(F.col("evidence"), lexicons.HIGH_BAR_SIGNALS)), "proof": F.col("evidence").rlike(f"(?i){either(lexicons.PROOF)}"),
    }).drop("bullet_text", "evidence")
    # scores need the numbers of terms only; their order is made where somebody reads it
    rows = rows.withColumns({name: in_order(F.col(f"_{name}"), of) for name, of in _VOCABULARIES.items()} | {f"n_{name}": F.size(f"_{name}") for name in _VOCABULARIES})
    rows = rows.withColumn("typos", F.col("typos") + F.col("repetitions"))
    made = [f"_{name}" for name in _VOCABULARIES]
    if jds is None:
        return rows.drop("text", *made)
    rows = rows.join(jds.select(F.col("jd_id").alias(jd_col), "keywords"), jd_col, "left")
    rows = rows.withColumn("matched", terms_in(text, F.col("keywords"))).drop("text")
    return rows.withColumns(terms.jd_overlap(F.col("matched"), F.col("_proven"), F.col("keywords"))).drop(*made)


def _has(section: str) -> Column:
    return F.array_contains("sections", section)


def checks(with_jd: bool) -> list[tuple[str, str, Column, Column, int]]:
    """(category, id, passed, points, max) over the columns of features()."""
    skills, proven, high = (F.col(f"n_{c}").cast("double") for c in _VOCABULARIES)
    entries, lines, quantified, bullets = F.col("entries"), F.col("project_lines"), F.col("quantified"), F.col("bullets")
    power, standard = F.col("power_verbs"), F.col("standard_verbs")
    out = [("parse", name, test, F.when(test, 5.0).otherwise(0.0), 5) for name, test in (("email", F.col("email").isNotNull()), ("phone", F.col("has_phone")), ("linkedin", F.col("has_linkedin")), ("portfolio", F.col("has_portfolio")))]
    tools = F.least(F.lit(5.0), F.greatest(F.lit(2.0), 2 * high + 0.5 * skills))
    if with_jd:
        k, m, both = (c.cast("double") for c in (F.size("keywords"), F.size("matched"), F.col("proven_matched")))
        share = F.when(k > 0, m / F.greatest(k, F.lit(1.0)) * 10 + F.when(m > 0, both / F.greatest(m, F.lit(1.0)) * 5).otherwise(0.0)).otherwise(15.0)
        out += [
            ("skills", "jd-skills", m >= F.least(F.lit(4), F.ceil(k * 0.35)), F.least(F.lit(15.0), share), 15),
            ("skills", "skill-count", proven >= 2, F.least(F.lit(10.0), 2.5 * proven + F.least(F.lit(4.0), 0.5 * skills)), 10),
            ("skills", "tooling", (high >= 1) | (skills >= 4), tools, 5),
        ]
    else:
        out += [
            ("skills", "skill-breadth", skills >= 4, F.least(F.lit(15.0), 2.5 * skills), 15),
            ("skills", "skill-count", proven >= 2, F.least(F.lit(10.0), 3 * proven), 10),
            ("skills", "tooling", (high >= 1) | (skills >= 3), tools, 5),
        ]
    enough = (entries >= 2) | (_has("projects") & (lines >= 4))
    depth = quantified * 2 + F.when(F.col("proof"), 3).otherwise(0)
    return out + [
        ("projects", "project-count", enough, F.when(enough, 12.0).when((entries == 1) | (lines >= 2), 7.0).when(_has("projects"), 4.0).otherwise(0.0), 12),
        ("projects", "project-depth", (quantified >= 2) | F.col("proof"), F.least(F.lit(8.0), F.greatest(F.lit(3.0), depth.cast("double"))), 8),
        ("projects", "project-verbs", (power >= 1) | (standard >= 2), F.least(F.lit(5.0), F.greatest(F.lit(2.0), (power * 2 + standard).cast("double"))), 5),
        ("experience", "dates", F.col("has_dates"), F.when(F.col("has_dates"), 7.0).when(_has("experience"), 3.0).otherwise(0.0), 7),
        ("experience", "exp-explanation", _has("experience") | (bullets >= 4), F.when(_has("experience"), 8.0).otherwise(F.least(F.lit(8.0), bullets * 1.5)), 8),
        ("hygiene", "summary", _has("summary"), F.when(_has("summary"), 4.0).otherwise(2.0), 4),
        ("hygiene", "typos", F.col("typos") == 0, F.greatest(F.lit(0.0), 6 - F.col("typos") * 1.5), 6),
    ]


def with_checks(rows: DataFrame, with_jd: bool) -> DataFrame:
    """Adds checks, an array of structs (category, id, passed, points, max)."""
    made = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(i).alias("id"), p.alias("passed"), one_decimal(x).alias("points"), F.lit(m).alias("max")) for c, i, p, x, m in checks(with_jd)))
    return rows.withColumn("checks", made.cast(f"array<{CHECK}>"))


def category_score(name: str, most: int, with_jd: bool) -> Column:
    """The points of a category's checks, which have fixed places in the list."""
    total = reduce(lambda a, b: a + b, (F.col("checks")[i]["points"] for i, c in enumerate(checks(with_jd)) if c[0] == name), F.lit(0.0))
    return F.least(F.lit(float(most)), F.floor(total * 10 + 0.5) / 10)


def blockers() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("email").isNull(), "No email address detected"),
            F.when(F.col("words") <= 80, "Very little machine-readable text"),
        )
    )


def jd_score(with_jd: bool) -> Column:
    if with_jd:
        ratio = F.when(F.size("keywords") > 0, F.size("matched") / F.greatest(F.size("keywords"), F.lit(1))).otherwise(1.0)
        return F.least(F.lit(100.0), F.greatest(F.lit(15.0), F.floor(ratio * 85 + F.least(F.lit(15), F.col("proven_matched") * 3) + 0.5).cast("double")))
    base = F.least(F.lit(30.0), F.col("n_proven") * 5 + F.col("n_skills") * 1.5)
    return F.least(F.lit(98.0), F.greatest(F.lit(30.0), base + F.when(F.col("proof"), 10).otherwise(5)))


def tier(score: Column, blocked: Column, said: Column | None = None) -> Column:
    """Readiness: blocked or under 65 is Tier 3, 80 and more (or said to be) Tier 1, else Tier 2."""
    told = F.coalesce(F.lower(said), F.lit("")).rlike("tier 1|shortlist") if said is not None else F.lit(False)
    return F.when(blocked | (score < 65), "Tier 3: Overhaul Required").when((score >= 80) | told, "Tier 1: Shortlist Ready").otherwise("Tier 2: Needs Minor Polish")


def score_band(score: Column) -> Column:
    s = F.when(score.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5))))
    return reduce(lambda out, b: F.when(s >= b[1], F.lit(b[0])).otherwise(out), reversed(lexicons.BANDS), F.lit(None).cast("string"))


def effective_score(manual: str = "manual_score", overall: str = "overall_score") -> Column:
    return F.coalesce(F.col(manual).cast("double"), F.col(overall).cast("double"))


def fit_score(jd: Column, effective: Column) -> Column:
    return F.coalesce(jd.cast("double"), F.when(effective.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(effective * 0.88 + 0.5).cast("double")))))


def score_corpus(docs: DataFrame, jds: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text", jd_col: str = "jd_id", keep: Sequence[str] = ()) -> DataFrame:
    """One report for each document: score, jd_score, category scores, tier, band, checks, blockers and the measures they come from.

    jds: (jd_id, keywords), to score against the job description that a document names; without it the general standard applies. keep: further
    columns of docs that stay.
    """
    with_jd = jds is not None
    rows = with_checks(features(docs, id_col, text_col, jds, jd_col, keep), with_jd)
    rows = rows.withColumns({f"score_{n}": category_score(n, m, with_jd) for n, m in CATEGORIES})
    total = F.floor(reduce(lambda a, b: a + b, (F.col(f"score_{n}") for n, _ in CATEGORIES)) + 0.5)
    total = F.when(F.col("email").isNull(), F.least(total, F.lit(60))).otherwise(total)
    total = F.when(F.col("words") <= 80, F.least(total, F.lit(40))).otherwise(total)
    rows = rows.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"), "jd_score": jd_score(with_jd), "blockers": blockers()})
    return rows.withColumns({"tier": tier(F.col("score"), F.size("blockers") > 0), "band": score_band(F.col("score"))})


def check_rows(reports: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The checks of reports in long form: (id, category, check_id, passed, points, max)."""
    return reports.select(id_col, F.inline("checks")).withColumnRenamed("id", "check_id")


def fact_sheet(reports: DataFrame) -> Column:
    """A block of lines that states the score and what failed."""
    failed = lambda n: F.array_join(F.transform(F.filter("checks", lambda c: (c["category"] == n) & ~c["passed"]), lambda c: c["id"]), "; ")
    parts = [F.concat(F.lit("score="), F.col("score").cast("string"), F.lit("/100, jd_match="), F.col("jd_score").cast("string"), F.lit("%"))]
    for n, m in CATEGORIES:
        parts.append(F.concat(F.lit(f"{n}: "), F.col(f"score_{n}").cast("string"), F.lit(f"/{m} — "), F.when(failed(n) == "", "all checks passed").otherwise(failed(n))))
    parts.append(F.concat(F.lit("skills: "), F.when(F.size("skills") == 0, "none").otherwise(F.array_join(F.slice("skills", 1, 25), ", "))))
    parts.append(F.when(F.size("blockers") > 0, F.concat(F.lit("blockers: "), F.array_join("blockers", " | "))))
    return F.concat_ws("\n", *parts)
