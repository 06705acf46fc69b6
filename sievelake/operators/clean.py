"""Text repair: one chain of column expressions, each step counted on the text that it meets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.text import SPACE, bind, strip, stripped
from sievelake.operators.segment import EMAIL

# The repairs in their order. Kind, pattern, replacement.
CHARACTERS = (
    ("ligature ﬀ", "ﬀ", "ff"),
    ("ligature ﬁ", "ﬁ", "fi"),
    ("ligature ﬂ", "ﬂ", "fl"),
    ("ligature ﬃ", "ﬃ", "ffi"),
    ("ligature ﬄ", "ﬄ", "ffl"),
    ("smart quote", "[‘’‚‛′]", "'"),
    ("smart double quote", "[“”„‟″]", '"'),
    ("en/em dash", "[–—―]", "-"),
    ("ellipsis", "…", "..."),
    ("non-breaking space", " ", " "),
    ("zero-width char", "[​-‍﻿]", ""),
    ("bullet glyph", "[•●▪◦⁃·∙]", "* "),
)
HYPHEN = (("hyphen line-wrap", "([a-z])-\n([a-z])", "$1$2"),)
BULLETS = (("broken bullet marker", r"(?md)^[\s]*(?:[o0OØ•·▪–—*+·]|[|]{1,2}|[lI])[\s]{1,4}(?=[A-Z(])", "* "),)
DIGITS = (
    ("digit 0 inside word -> o", "(?<=[A-Za-z]{2})0(?=[A-Za-z])|(?<=[A-Za-z])0(?=[A-Za-z]{2})", "o"),
    ("digit 1 inside word -> l", "(?<=[a-z]{2})1(?=[a-z])", "l"),
    ("digit 5 -> S", "(?<![A-Za-z0-9_])5(?=[A-Z]{2})", "S"),
    ("digit 0 starting word -> O", "(?<![A-Za-z0-9_])0(?=[a-z]{3,})", "O"),
    ("digit 1 starting word -> l", "(?<![A-Za-z0-9_])1(?=[a-z]{3,})", "l"),
    ("digit 5 starting word -> S", "(?<![A-Za-z0-9_])5(?=[a-z]{3,})", "S"),
    ("letter O inside number -> 0", r"(?<=\d)O(?=\d)|(?<=\d)O(?![A-Za-z0-9_])", "0"),
)
PUNCTUATION = (("space before punctuation", " +([,.;:%)])", "$1"),)
STEPS = (*CHARACTERS, *HYPHEN, *BULLETS, *DIGITS, *BULLETS)


@F.pandas_udf(T.StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalize_unicode(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """NFKC, then line feeds alone as line ends. The one step that no built-in function does; it runs in Arrow batches."""
    return df.withColumn(text_col, F.regexp_replace(_nfkc(F.col(text_col)), "\r\n?", "\n"))


def repair(text: Column, steps) -> Column:
    """The text after steps (kind, pattern, replacement)."""
    return reduce(lambda t, s: F.regexp_replace(t, s[1], s[2].replace("\\", "\\\\")), steps, text)


def collapse_ws(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), " +\n", "\n"), r"\n{3,}", "\n\n"))


def glue_continuations(text: Column) -> Column:
    """Lines that go on the one before, which begin in lower case or with closing punctuation, are joined to it."""
    return F.regexp_replace(text, r"\n([a-z,;)])", " $1")


def clean(text: Column) -> Column:
    """All repairs of a text that is in NFKC and has line feeds alone."""
    return glue_continuations(repair(collapse_ws(repair(text, STEPS)), PUNCTUATION))


#: What a text must hold for any step of a group to fire.
_ODD = "[\uFB00-\uFB04\u2018-\u201B\u2032\u201C-\u201F\u2033\u2013-\u2015\u2026\u00A0\u200B-\u200D\uFEFF\u2022\u25CF\u25AA\u25E6\u2043\u00B7\u2219]"
_DIGIT = r"[A-Za-z][01]|[015][A-Za-z]|\dO"


def fix_tally(df: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, clean, fixes): the repaired text, and structs (kind, count) of the repairs that fired, counts of one kind added up.

    Each count is taken on the text that its step meets. Steps are projections with constant patterns, one after the other; a text is replaced in only where
    a step fires, and steps of a group are tried only on texts that hold any of their characters. Characters of one rule never come from another's repair,
    so that their counts are taken at once.
    """
    own = lambda steps, n: [F.when(F.col("x"), F.regexp_count("t", F.lit(p))).otherwise(0).alias(f"n{n + i}") for i, (_, p, _) in enumerate(steps)]
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("x", F.col("t").rlike(_ODD))
    rows = rows.select(id_col, F.when(F.col("x"), repair(F.col("t"), CHARACTERS)).otherwise(F.col("t")).alias("t"), *own(CHARACTERS, 0))
    held, n = [id_col, *(f"n{i}" for i in range(len(CHARACTERS)))], len(CHARACTERS)
    for group, needed in ((HYPHEN, "-\n"), (BULLETS, ""), (DIGITS, _DIGIT), (BULLETS, "")):
        rows = rows.withColumn("x", F.col("t").rlike(needed) if needed else F.lit(True))
        for step in group:
            rows = rows.withColumn(f"n{n}", own((step,), n)[0])
            rows = rows.select(*held, "x", f"n{n}", F.when(F.col(f"n{n}") > 0, repair(F.col("t"), (step,))).otherwise(F.col("t")).alias("t"))
            held, n = [*held, f"n{n}"], n + 1
    rows = rows.withColumn("c", collapse_ws(F.col("t")))
    counts = [(k, F.col(f"n{i}")) for i, (k, _, _) in enumerate(STEPS)]
    counts += [("collapsed whitespace", F.length("t") - F.length("c")), (PUNCTUATION[0][0], F.regexp_count("c", F.lit(PUNCTUATION[0][1])))]
    # the step that comes twice is counted where it fires first
    twice = [i for i, (k, _) in enumerate(counts) if k == BULLETS[0][0]]
    one, two = (counts[i][1] for i in twice)
    counts[twice[0]], counts[twice[1]] = (BULLETS[0][0], F.when(one > 0, one + two).otherwise(0)), (BULLETS[0][0], F.when(one > 0, 0).otherwise(two))
    fixes = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("int").alias("count")) for k, c in counts)), lambda f: f["count"] > 0)
    return rows.select(id_col, glue_continuations(repair(F.col("c"), PUNCTUATION)).alias("clean"), fixes.alias("fixes"))


def fix_profile(tally: DataFrame) -> DataFrame:
    """(kind, docs, total) over a corpus."""
    # an outer inline: what Spark infers from an inner one it would push down and write out through all steps of the tally
    return tally.select(F.inline_outer("fixes")).groupBy("kind").agg(F.count(F.lit(1)).alias("docs"), F.sum("count").alias("total")).where(F.col("kind").isNotNull())


def quality_warnings(clean_text: Column, raw: Column) -> Column:
    """What a reader should look at: six tests, as an array of their names."""
    upper, letters = F.regexp_count(clean_text, F.lit("[A-Z]")), F.regexp_count(clean_text, F.lit("[A-Za-z]"))
    return F.array_compact(
        F.array(
            F.when(~clean_text.rlike(EMAIL), "no email"),
            F.when(~clean_text.rlike(r"\+?\d[\d\s\-()]{7,}\d"), "no phone"),
            F.when(F.length(F.regexp_replace(clean_text, f"{SPACE}+", "")) < 400, "little text"),
            F.when(clean_text.rlike(r"(.)\1{6,}"), "repeated characters"),
            F.when(upper / F.greatest(letters, F.lit(1)) > 0.55, "mostly upper case"),
            F.when(raw.contains("\t") | raw.rlike(r"\|\s*\w+\s*\|"), "table structure"),
        )
    )


def clean_stats(raw: Column, clean_text: Column) -> Column:
    return F.struct(F.length(raw).alias("raw_chars"), F.length(clean_text).alias("clean_chars"), (F.length(raw) - F.length(clean_text)).alias("saved_chars"))


def cap_text(text: Column, n: int = 9000) -> Column:
    """Head and tail of a text of more than n characters, with a mark between them."""
    head = int(n * 0.72)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, head), F.lit("\n\n[...trimmed for length...]\n\n"), F.right(text, F.lit(n - head - 40)))).otherwise(text)


def readable(df: DataFrame, text_col: str = "raw_text", least: int = 100) -> DataFrame:
    """df with a column reject: why a document has too little text, or null."""
    n = F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+", ""))
    return df.withColumn("reject", F.when(n < least, F.concat(F.lit("too little text: "), n.cast("string"))))


def ascii_text(text: Column) -> Column:
    """Text for fonts that hold ASCII only."""
    steps = ((r"[‘’‚′]", "'"), (r"[“”„″]", '"'), (r"[–—−]", "-"), (r"…", "..."), (r"[•●▪]", "-"), (r"→", "->"), (r" ", " "), (r"[^\x09\x0a\x0d\x20-\x7e]", ""))
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


# What names are told by.
HONORIFICS = ("mr", "mrs", "ms", "dr", "er", "prof", "shri", "smt")
NAME_LABEL = r"(?:candidate\s+name|full\s+name|name)\s*[:\-]\s*"
NAME_MARKS = r"#*•▪◦‣·–—>|\s~_👤()\[\]"
NOT_NAMES = (
    r"curriculum\s+vitae", "resume", "cv", "biodata", r"bio\s*data", "profile", "summary", "contact", "objective", r"career\s+objective", r"professional\s+summary", "education", "skills", r"technical\s+skills", "projects", "experience",
    r"work\s+experience", "achievements", "certifications", "declaration", r"personal\s+details", r"personal\s+profile", r"academic\s+profile", "student", "engineer", "developer", "fresher", "candidate", "details", "address", "phone", "email",
)
NAMES_OF_PLACES = ("college", "university", "institute", "school", "polytechnic", "technologies", "solutions", "services", "ltd", "pvt", "inc", "corp", "engineering", "department", "campus", "foundation")
TITLES_AFTER_NAMES = (
    r"b\.?e\.?", r"b\.?tech\.?", r"m\.?tech\.?", r"m\.?c\.?a\.?", r"b\.?sc\.?", "bca", "msc", r"software\s+engineer", r"full\s*stack", "developer", "frontend", "backend", r"data\s+scientist", r"ai\s+engineer", r"web\s+developer", "fresher", "sde",
)
FILE_WORDS = (
    "ats", "fr[ei]{2}ndly", r"single\s*column", "resume", "cv", "biodata", r"bio\s*data", "profile", "copy", r"v\d+", "compressed", "new", "final", "latest", "updated", "developer", "engineer", "software", r"full\s*stack", "frontend", "backend",
    "intern", "internship", "fresher", "sde", "tech", "draft", "document", "doc",
)


def _without(text: Column, *patterns: str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def _title(name: Column) -> Column:
    """Words in title case, of one or two letters in upper case, without honorifics."""
    honorific = "|".join(HONORIFICS)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, rf"(?i)\b({honorific})\.?\b", ""), "([a-z])([A-Z])", "$1 $2"), r"[_\-.]+", " ")
    kept = F.filter(F.split(F.trim(bare), r"\s+"), lambda w: (w != "") & ~w.rlike(rf"(?i)^({honorific})\.?$"))
    return F.array_join(F.transform(kept, lambda w: F.when(F.length(w) <= 2, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 60))))), " ")


def _bare(line: Column) -> Column:
    """A line without marks, numbers, a label, a courtesy title, and degrees or jobs after the name."""
    s = _without(line, rf"^[{NAME_MARKS}]+", rf"[{NAME_MARKS}]+$", r"^\d{4,}[\s\-_:.]*", f"(?i)^{NAME_LABEL}", r"(?i)^(mr\.|mrs\.|ms\.|dr\.|er\.|prof\.)\s+")
    return strip(_without(strip(s), rf"(?i)[\s|–—\-,]+({'|'.join(TITLES_AFTER_NAMES)}).*$"))


def _is_name(line: Column) -> Column:
    return (
        F.length(line).between(2, 50) & line.rlike(r"^[A-Za-z\s.'’\-]+$") & F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")).between(1, 5)
        & ~line.rlike(r"(?i)\.com|\.in|\.org|\.edu|\.net") & ~line.rlike(rf"(?i)^({'|'.join(NOT_NAMES)})$") & ~line.rlike(rf"(?i)\b({'|'.join(NAMES_OF_PLACES)})\b")
    )


def extract_name(text: Column, file_name: Column | None = None) -> Column:
    """A candidate's name: a labelled field of the first 25 lines, else the first of 10 lines that looks like a name, else the email's user, else the file's name."""
    file_name = F.lit(None).cast("string") if file_name is None else file_name
    # most texts hold neither mark, nor a label
    unmarked = lambda t: F.when(t.contains("[") | t.contains("---"), _without(t, r"(?i)\[DOCUMENT METRICS:[^\]]*\]", r"(?i)--- Page \d+ ---")).otherwise(t)
    bare = bind(bind(text, stripped), unmarked)
    lines = F.filter(F.transform(F.slice(F.filter(F.split(bare, r"\r?\n"), lambda s: s.rlike(r"\S")), 1, 25), stripped), lambda s: s != "")
    label = lambda s: F.regexp_extract(s, rf"(?i)^{NAME_LABEL}([A-Za-z\s.'\-]+)", 1)
    other = lambda s: s.rlike(r"(?i)@|https?:|\.com|\.in|\.org|\+?\d{8,}|\b(phone|mobile|email|linkedin|github)\b") | (F.length(s) > 60) | s.rlike("[.,;!?]$")
    named = lambda s: bind(_bare(s), lambda b: F.when(_is_name(b), b))
    # lines are looked at until one gives a name
    first = lambda items, of: F.aggregate(items, F.lit(None).cast("string"), lambda found, s: F.when(found.isNotNull(), found).otherwise(of(s)))
    labelled = lambda items: first(items, lambda s: bind(label(s), lambda x: F.when(x != "", named(x))))
    headed = lambda items: first(F.slice(items, 1, 10), lambda s: F.when(~other(s), named(s)))
    user = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"([A-Za-z0-9_.+-]+)@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+", 1), r"\d+", ""), r"[_\-.]+", " "))
    ask = (file_name.isNull() | (file_name == "") | file_name.rlike("(?i)resume|cv")) & (F.length(user) >= 3) & user.rlike(r"^[A-Za-z\s]+$") & (F.size(F.split(user, r"\s+")) <= 4) & _is_name(_title(user))
    own = _without(strip(F.coalesce(file_name, F.lit(""))), r"\.[^/.]+$", r"\s*\(\d+\)$", r"^\d{4}[-_.]\d{2}[-_.]\d{2}[-_.]*", r"^\s*\d{6,}[\s\-_.]*")
    own = F.regexp_replace(F.regexp_replace(own, "([a-z])([A-Z])", "$1 $2"), r"[_\-.]+", " ")
    own = F.trim(F.regexp_replace(F.regexp_replace(own, rf"(?i)\b({'|'.join(FILE_WORDS)})\b", " "), r"\s+", " "))
    told = bind(lines, lambda items: F.coalesce(F.when(text.rlike("(?i)name"), labelled(items)), headed(items)))
    return _title(F.coalesce(told, F.when(ask, user), F.when(_is_name(own), own), F.lit("Candidate")))
