"""Documents to lines, bullets, sections and entries, and what is counted on them.

Lines are made in place; everything that needs the order of lines shares one shuffle by document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions import lexicons
from sievelake.functions.text import BULLET, SPACE, bind, bounded, either, match_terms, quick, strip, stripped, word_count

MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def to_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, line_no, line): trimmed lines that aren't blank; line_no counts all lines from 0."""
    each = df.select(id_col, F.posexplode(F.split(F.col(text_col), "\r?\n", -1)).alias("line_no", "line"))
    return each.where(F.col("line").rlike(f"[^{SPACE[1:]}")).select(id_col, "line_no", strip(F.col("line")).alias("line"))


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET) | ((F.length(line) > 40) & line.rlike("^[A-Z][a-z]+(ed|ing)(?![A-Za-z0-9_])"))


def bullet_text(line: Column) -> Column:
    return bind(F.regexp_replace(line, BULLET + r"+\s*", ""), stripped)


def to_bullets(lines: DataFrame) -> DataFrame:
    """The bullets among lines, with a column bullet: the text without its marker."""
    return lines.where(is_bullet(F.col("line"))).withColumn("bullet", bullet_text(F.col("line")))


def header_title(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"^[#•\-*|>:\s]+|[#•\-*|>:\s]+$", ""))


def header_type(line: Column) -> Column:
    """The section that a line opens, or null: the first kind of header whose words occur anywhere in a short line that is no bullet."""
    any_own = quick(bounded(either("|".join(own for _, own in lexicons.HEADERS))))

    def kind_of(title: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, own in reversed(lexicons.HEADERS):
            kind = F.when(title.rlike(quick(bounded(own))), F.lit(name)).otherwise(kind)
        return kind

    # most lines hold no word of any header, and the few that do have their title made once
    return F.when((F.length(line) <= 65) & ~line.rlike(r"^[-•*▪◦‣·–—>\d.]\s") & line.rlike(any_own), bind(header_title(line), kind_of))


def assign_sections(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines with header (the kind a header line opens), section_no (0 before the first header), type and last_no (of the document's last section)."""
    order = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("header", header_type(F.col("line")))
    out = marked.withColumn("section_no", F.count("header").over(order).cast("int")).withColumn("type", F.coalesce(F.last("header", ignorenulls=True).over(order), F.lit("contact")))
    return out.withColumn("last_no", F.max("section_no").over(W.partitionBy(id_col)))


def _joined(what: Column, given: Column) -> Column:
    """What, of the rows for which `given` holds, as an array in line order."""
    return F.transform(F.array_sort(F.collect_list(F.when(given, F.struct("line_no", what.alias("v"))))), lambda x: x["v"])


def to_sections(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, section_no, type, title, lines) from assign_sections(). An empty first section and an empty last one are left out, other empty ones stay."""
    content = F.col("header").isNull()
    each = sections.groupBy(id_col, "section_no", "type", "last_no").agg(F.max(F.when(~content, header_title(F.col("line")))).alias("title"), _joined(F.col("line"), content).alias("lines"))
    kept = each.where((F.size("lines") > 0) | ((F.col("section_no") > 0) & (F.col("section_no") < F.col("last_no"))))
    return kept.select(id_col, "section_no", "type", F.coalesce("title", F.lit("Header")).alias("title"), "lines")


def opens_entry(line: Column) -> Column:
    """Whether a line of a projects section opens an entry."""
    detail = line.rlike(BULLET) | ((F.length(line) > 40) & line.rlike("^[A-Z]"))
    return ~detail & (F.length(line) < 50) & ~line.rlike(rf"(?i)^(20\d\d|19\d\d|{MONTHS})")


def to_projects(sections: DataFrame, id_col: str = "doc_id", vocabulary: tuple[str, ...] = lexicons.SKILLS) -> DataFrame:
    """(id, entry_no, name, bullets, tools) of the first projects section of to_sections()."""
    first = sections.where(F.col("type") == "projects").groupBy(id_col).agg(F.min_by("lines", "section_no").alias("lines"))
    each = first.select(id_col, F.posexplode("lines").alias("line_no", "line")).withColumn("opens", opens_entry(F.col("line")))
    order = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("entry_no", F.count_if("opens").over(order).cast("int")).where(F.col("entry_no") > 0)
    bullet = ~F.col("opens") & (F.col("line").rlike(BULLET) | ((F.length("line") > 40) & F.col("line").rlike("^[A-Z]")))
    tools = _joined(match_terms(F.col("line"), vocabulary), ~F.col("opens"))
    return each.groupBy(id_col, "entry_no").agg(
        F.max(F.when(F.col("opens"), strip(F.regexp_replace("line", r"[:\-–|]+$", "")))).alias("name"),
        _joined(bullet_text(F.col("line")), bullet).alias("bullets"),
        F.array_distinct(F.flatten(tools)).alias("tools"),
    )


def first_words(bullet: Column) -> Column:
    return F.slice(F.split(F.lower(bullet), "[^a-z]+", 3), 1, 2)


def opens_with(bullet: Column, verbs: tuple[str, ...]) -> Column:
    """Whether one of a bullet's first two words is one of these verbs."""
    return _among(first_words(bullet), verbs)


def _among(opening: Column, verbs: tuple[str, ...]) -> Column:
    return F.exists(opening, lambda w: w.isin(*verbs))


def _opens(low: Column, verbs: tuple[str, ...]) -> Column:
    """opens_with() of a lower-cased bullet, by one pattern that is tried at its start only."""
    return low.rlike(rf"\A(?:[a-z]*+[^a-z]++)?{either('|'.join(v for v in verbs if re.fullmatch('[a-z]+', v)))}(?![a-z])")


def is_weak(bullet: Column) -> Column:
    return _weak(F.lower(bullet))


def _weak(low: Column) -> Column:
    firsts = "".join(dict.fromkeys(p[0] for p in lexicons.PASSIVE_PHRASES))
    return low.rlike(f"(?=[{firsts}])(?<![^ ])(?:{'|'.join(map(re.escape, lexicons.PASSIVE_PHRASES))})")


def n_words(stripped: Column) -> Column:
    """How many parts white space cuts a text into that has none at its ends."""
    return F.when(stripped.rlike(r"(?=\s)(?:  |[^ ])"), F.size(F.split(stripped, r"\s+"))).otherwise(F.length(stripped) - F.length(F.replace(stripped, F.lit(" "), F.lit(""))) + 1)


def line_features(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document that has lines: counts over bullets, sections and entries, and the texts that evidence is searched in."""
    line, content = F.col("line"), F.col("header").isNull()
    bullet = is_bullet(line)
    # a section counts if it has lines or another one follows
    real = content | (F.col("section_no") < F.col("last_no"))
    rows = sections.withColumn("bullet", F.when(bullet, bullet_text(line))).withColumn("real_type", F.when(real, F.col("type")))
    first = F.min(F.when(F.col("real_type") == "projects", F.col("section_no"))).over(W.partitionBy(id_col))
    # made once for each line, before the window
    rows = rows.withColumns({"_opening": first_words(F.col("bullet")), "_n_words": F.size(F.split("bullet", r"\s+"))}).withColumn("first_projects", first)
    own = content & F.col("type").isin("experience", "projects")
    n_words = F.col("_n_words")
    return rows.groupBy(id_col).agg(
        F.count("bullet").alias("bullets"),
        F.count_if(F.col("bullet").rlike(f"(?i){lexicons.QUANTIFIED}")).alias("quantified"),
        F.coalesce(F.max(n_words), F.lit(0)).alias("longest_bullet"),
        F.coalesce(F.sum(n_words), F.lit(0)).alias("bullet_words"),
        F.count_if(_among(F.col("_opening"), lexicons.POWER_VERBS)).alias("power_verbs"),
        F.count_if(_among(F.col("_opening"), lexicons.STANDARD_VERBS)).alias("standard_verbs"),
        F.count_if(is_weak(F.col("bullet"))).alias("weak_bullets"),
        F.array_join(_joined(F.col("bullet"), F.col("bullet").isNotNull()), " ").alias("bullet_text"),
        F.array_join(_joined(line, own), "\n").alias("evidence"),
        F.array_sort(F.collect_set("real_type")).alias("sections"),
        F.count_if(content & (F.col("section_no") == F.col("first_projects")) & opens_entry(line)).alias("entries"),
        F.count_if(content & (F.col("type") == "projects") & (line.rlike(BULLET) | (F.length(line) > 30))).alias("project_lines"),
    )


def with_line_features(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with the columns of line_features(), made in place from a text without a shuffle: sections are slices of its lines. Without lines counts are 0, the two numbers of words null."""
    of = lambda name, f: F.transform(name, f)
    n_if = lambda items, test: F.size(F.filter(items, test)).cast("long")
    # a carriage return at the end of a line goes with the other white space
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), stripped), lambda s: s != "")
    rows = rows.withColumn("_lines", lines)
    heads = F.filter(of("_lines", lambda s, i: F.struct(i.alias("at"), header_type(s).alias("kind"))), lambda h: h["kind"].isNotNull())
    rows = rows.withColumns({
        "_heads": F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("contact").alias("kind"))), heads),
        "_bullets": F.transform(F.filter("_lines", is_bullet), bullet_text),
    })
    end = lambda j: F.coalesce(F.get("_heads", j + 1)["at"], F.size("_lines"))
    own = lambda h, j: F.slice(F.col("_lines"), h["at"] + 2, end(j) - h["at"] - 1)
    rows = rows.withColumns({
        "_sections": of("_heads", lambda h, j: F.struct(j.alias("no"), h["kind"].alias("type"), own(h, j).alias("lines"))),
        "_n_words": of("_bullets", n_words), "_low": of("_bullets", F.lower),
    })
    # a section counts if it has lines or another one follows
    rows = rows.withColumn("_real", F.filter("_sections", lambda s: (F.size(s["lines"]) > 0) | ((s["no"] > 0) & (s["no"] < F.size("_heads") - 1))))
    texts = lambda items, test: F.flatten(F.transform(F.filter(items, test), lambda s: s["lines"]))
    projects, some = (lambda s: s["type"] == "projects"), F.size("_lines") > 0
    out = {
        "bullets": F.size("_bullets").cast("long"),
        "quantified": n_if("_bullets", lambda b: b.rlike("[0-9]") & b.rlike(rf"(?i)(?=[0-9$₹]){lexicons.QUANTIFIED}")),
        "longest_bullet": F.when(some, F.coalesce(F.array_max("_n_words"), F.lit(0))),
        "bullet_words": F.when(some, F.aggregate("_n_words", F.lit(0).cast("long"), lambda a, n: a + n)),
        "power_verbs": n_if("_low", lambda b: _opens(b, lexicons.POWER_VERBS)),
        "standard_verbs": n_if("_low", lambda b: _opens(b, lexicons.STANDARD_VERBS)),
        "weak_bullets": n_if("_low", _weak),
        "bullet_text": F.array_join("_bullets", " "),
        "evidence": F.array_join(texts("_sections", lambda s: s["type"].isin("experience", "projects")), "\n"),
        "sections": F.array_sort(F.array_distinct(F.transform("_real", lambda s: s["type"]))),
        "entries": n_if(texts(F.slice(F.filter("_real", projects), 1, 1), lambda s: F.lit(True)), opens_entry),
        "project_lines": n_if(texts("_sections", projects), lambda s: s.rlike(BULLET) | (F.length(s) > 30)),
    }
    return rows.withColumns(out).drop("_lines", "_heads", "_bullets", "_sections", "_n_words", "_low", "_real")


def section_coverage(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, found, missing): labels of the sections found, and of the required ones that are missing."""
    labels = lambda keep: F.filter(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("label")) for i, n, need in lexicons.SECTIONS if keep(need))), lambda s: F.lit(True))
    has = lambda s: F.array_contains("sections", s["id"])
    return features.select(
        id_col,
        F.transform(F.filter(labels(lambda need: True), has), lambda s: s["label"]).alias("found"),
        F.transform(F.filter(labels(lambda need: need), lambda s: ~has(s)), lambda s: s["label"]).alias("missing"),
    )


def education_snippet(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, snippet): the first three lines of the first education section."""
    first = sections.where(F.col("type") == "education").groupBy(id_col).agg(F.min_by("lines", "section_no").alias("lines"))
    return first.select(id_col, F.array_join(F.slice("lines", 1, 3), ", ").alias("snippet"))


def has_date_range(text: Column) -> Column:
    # most texts have no year, and what is tried at each place is first a class of characters
    return (text.contains("19") | text.contains("20")) & (
        text.rlike(r"(?i)(?=[12])(?:19|20)\d{2}\s*(?:[-–—]|to)\s*(?:(?:19|20)\d{2}|present|current)")
        | text.rlike("(?=[0-9])" + bounded(r"(?:0?[1-9]|1[0-2])/(?:19|20)\d{2}\s*[-–—]\s*(?:0?[1-9]|1[0-2])/(?:19|20)\d{2}"))
        | text.rlike(rf"(?i)(?=[{''.join(dict.fromkeys(m[0] for m in MONTHS.split('|')))}])(?<![A-Za-z0-9_])(?:{MONTHS})[a-z]*\s+(?:19|20)\d{{2}}\s*[-–—]")
    )


# What dates, contacts and links look like, here and in what follows and precedes.
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+"


def contact_signals(text: Column) -> dict[str, Column]:
    """email (the first, or null), has_phone, has_linkedin, has_portfolio."""
    email = F.regexp_extract(text, f"({EMAIL})", 1)
    return {
        "email": F.when(text.contains("@") & (email != ""), email),
        "has_phone": text.rlike(r"\+?\d[\d\s().-]{7,}\d"),
        "has_linkedin": text.rlike(r"(?i)linkedin\.com/[a-z0-9-]+"),
        "has_portfolio": text.rlike(r"(?i)(github\.com/|gitlab\.com/|https?://[a-z0-9-]+\.(dev|io|com|app|me)(?![A-Za-z0-9_]))"),
    }


def doc_metrics(docs: DataFrame, features: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, words, pages, bullets, quantified, longest_bullet, words_per_bullet)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = docs.select(id_col, word_count(F.coalesce(text_col, F.lit(""))).alias("words")).join(features, id_col, "left")
    mean = F.when(zero("bullets") > 0, F.floor(F.col("bullet_words") / F.col("bullets") * 10 + 0.5) / 10).otherwise(0.0)
    pages = F.greatest(F.lit(1.0), F.floor(F.col("words") / 500 * 10 + 0.5) / 10)
    return rows.select(id_col, "words", pages.alias("pages"), zero("bullets").alias("bullets"), zero("quantified").alias("quantified"), zero("longest_bullet").alias("longest_bullet"), mean.alias("words_per_bullet"))
