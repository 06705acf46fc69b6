"""Language issues of documents: rule tables applied to text with links and addresses masked."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions import lexicons
from sievelake.functions.text import bind, bounded, either, quick, strip, values_table, words
from sievelake.operators import segment
from sievelake.operators.term_index import with_terms

# Links, addresses and domains, in which nothing is an issue; limits; words with digits that are right.
IGNORED = (
    r"(?i)https?://[^\s\"'<>]+|www\.[^\s\"'<>]+|(?:github|linkedin|gitlab|leetcode|hackerrank|codeforces|kaggle|medium|vercel|netlify|render)\.com/[^\s\"'<>]+"
    r"|[a-zA-Z0-9_.-]+@[a-zA-Z0-9_.-]+\.[a-zA-Z]{2,}|(?:github|linkedin|portfolio|profile|website):\s*[^\s|,;]+"
    r"|[a-zA-Z0-9-]+\.(?:dev|io|app|tech|org|net|co|me|in|com)(?:/[^\s\"'<>]*)?"
)
#: Ends of lines over which no match of IGNORED goes, as white space in one follows a colon: a text is cut there, and only parts that can hold one are searched.
PART_ENDS = r"(?=[ \t\r]*\n)(?<=[^\s:])"
#: What every match of IGNORED holds.
_IGNORED_CUE = r"(?i)(?=[@:.])(?:@|:(?=//)|(?<=github|linkedin|portfolio|profile|website):|(?<=www)\.|\.(?:dev|io|app|tech|org|net|co|me|in|com))"
_QUICK_IGNORED = IGNORED.replace("a-zA-Z0-9", f"{string.ascii_letters}{string.digits}")
#: Stands on both sides of what is masked, until it is.
_MARK = "\u0001"
LIMIT, PUNCTUATION_LIMIT, OCR_LIMIT = 50, 8, 15
REPEATED = r"(\w{3,})\s+\2"
TECHNICAL = r"(?i)^(h[1-6]|s3|ec2|mp[34]|utf8|x86|i18n|l10n|k8s|c\d|m\d|t\d|r\d|p\d)$"
MIXED = bounded(r"[a-z]+\d[a-z0-9]*|[a-z0-9]*\d[a-z]+")

#: Words that a digit-damaged word is corrected to, if none are given: those of the other vocabularies.
REFERENCE_WORDS = tuple(dict.fromkeys(w for t in (*lexicons.POWER_VERBS, *lexicons.STANDARD_VERBS, *lexicons.SKILLS, *lexicons.STOP_WORDS, *lexicons.CORPORATE_WORDS, *lexicons.PASSIVE_PHRASES) for w in t.split(" ") if w.isalpha() and len(w) >= 3))


def masked(text: Column) -> Column:
    """A text of the same length in which links, addresses and domains are blanked out, so that places in it are places in the text."""
    def covered(part: Column) -> Column:
        between = F.split(part, IGNORED, -1)
        covers = F.transform(F.regexp_extract_all(part, F.lit(f"({IGNORED})"), F.lit(1)), lambda m: F.repeat(F.lit("\u0000"), F.length(m)))
        return F.array_join(F.zip_with(between, covers, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    def marked(part: Column) -> Column:
        pieces = F.split(F.regexp_replace(part, _QUICK_IGNORED, f"{_MARK}$0{_MARK}"), _MARK, -1)
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit("\u0000"), F.length(p))).otherwise(p)), "")

    # matches are marked in one pass; a text that holds the mark itself takes two
    parts = F.transform(F.split(text, PART_ENDS, -1), lambda p: F.when(~p.rlike(_IGNORED_CUE), p).when(p.contains(_MARK), covered(p)).otherwise(marked(p)))
    return F.when(text.rlike(r"[@:/]|\.[A-Za-z]"), F.array_join(parts, "")).otherwise(text)


def cue(pattern: str) -> str:
    """The longest lower-cased run of letters that every match of a pattern holds; empty if there is none."""
    from re import _parser as parser

    found = [""]

    def walk(items) -> None:
        run = ""
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL" and chr(value).isascii() and chr(value).isalnum():
                run += chr(value).lower()
                continue
            found.append(run)
            run = ""
            if name == "SUBPATTERN":
                walk(value[-1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                walk(value[2])
        found.append(run)

    walk(parser.parse(pattern))
    return max(found, key=len)


def rule_table(spark: SparkSession, spelling=lexicons.SPELLING, grammar=lexicons.GRAMMAR, punctuation=lexicons.PUNCTUATION) -> DataFrame:
    """(phase, rule, type, severity, pattern, fix, explanation, cue): the rules of the three first phases, in order. Any table of these columns will do."""
    kind = lambda why: "repetition" if "repetition" in why else "grammar"
    rows = [(1, i, "spelling", "major", bounded(p), fix, why, cue(p)) for i, (p, fix, why) in enumerate(spelling)]
    rows += [(2, i, kind(why), s, bounded(p), fix, why, cue(p)) for i, (p, fix, why, s) in enumerate(grammar)]
    rows += [(3, i, "punctuation", "minor", p, fix, why, cue(p)) for i, (p, fix, why) in enumerate(punctuation)]
    return values_table(spark, rows, "phase, rule, type, severity, pattern, fix, explanation, cue")


def located(rows: DataFrame, keys: list[str], text: Column, pattern: Column) -> DataFrame:
    """(keys, pos, error, start): the matches of a pattern in a text, their number and the place where they begin, both from 0.

    A match begins after all that lies between the matches before it, and after those matches: prefix sums over the matches of a text.
    """
    rows = rows.select(*keys, text.alias("_t"), pattern.alias("_p")).select(*keys, "_t", "_p", F.regexp_extract_all("_t", F.col("_p"), F.lit(0)).alias("_m")).where(F.size("_m") > 0)
    pairs = F.zip_with(F.slice(F.split("_t", F.col("_p"), -1), F.lit(1), F.size("_m")), "_m", lambda a, m: F.struct(F.length(a).alias("gap"), m.alias("error")))
    each = rows.select(*keys, F.posexplode(pairs).alias("pos", "x")).select(*keys, "pos", "x.*")
    so_far = F.sum(F.col("gap") + F.length("error")).over(W.partitionBy(*keys).orderBy("pos")) - F.length("error")
    return each.select(*keys, "pos", "error", so_far.cast("int").alias("start"))


def rule_issues(docs: DataFrame, rules: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, phase, rule, start, type, severity, error, fix, explanation): what the rules of a table find outside of links and addresses.

    Rules are found for a text through the index of their cues; those without a cue are tried on every text. The same word (without case) under the same
    explanation is one spelling issue, the first; the same phrase is one grammar issue; the same characters are one punctuation issue, and a rule has
    PUNCTUATION_LIMIT of them; repeated words are an issue each. Repeated numbers, decimals and versions are none.
    """
    rules = rule_table(docs.sparkSession) if rules is None else rules
    rules = rules.select(F.struct("phase", "rule", "type", "severity", "pattern", "fix", "explanation").alias("term_id"), F.col("cue").alias("term"), F.lit(True).alias("anywhere"))
    texts = docs.select(id_col, masked(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    always = rules.where("term = ''").agg(F.collect_list("term_id").alias("always"))
    tried = with_terms(texts, rules.where("term <> ''"), id_col, "t").crossJoin(F.broadcast(always))  # one row
    each = tried.select(id_col, "t", F.explode(F.concat("met", "always")).alias("r"))
    found = located(each, [id_col, "r"], F.col("t"), F.col("r.pattern")).select(id_col, "r.*", "pos", "error", "start")
    numbers = (F.col("phase") == 2) & F.col("error").rlike(r"^\d+\s+\d+$") | (F.col("phase") == 3) & F.col("error").rlike(r"^\d[.:]\d$")
    low = F.lower("error")
    same = F.when(F.col("phase") == 1, F.concat("explanation", F.lit("\u0000"), low)).when(F.col("type") == "grammar", low).when(F.col("phase") == 3, F.col("error")).otherwise(F.concat_ws("\u0000", "rule", "pos"))
    first = found.where(~numbers).withColumn("_n", F.row_number().over(W.partitionBy(id_col, "phase", "type", same).orderBy("rule", "pos"))).where(F.col("_n") == 1)
    nth = F.row_number().over(W.partitionBy(id_col, "phase", "rule").orderBy("pos"))
    some = first.withColumn("_n", nth).where((F.col("phase") != 3) | (F.col("_n") <= PUNCTUATION_LIMIT))
    fix = F.regexp_replace("error", F.col("pattern"), F.col("fix"))
    return some.select(id_col, "phase", "rule", "start", "type", "severity", "error", fix.alias("fix"), "explanation")


def spelling_issues(docs: DataFrame, rules: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """Issues of the spelling rules alone: see rule_issues()."""
    rules = rule_table(docs.sparkSession) if rules is None else rules
    return rule_issues(docs, rules.where("phase = 1"), id_col, text_col)


def _damaged(error: Column) -> Column:
    """Whether a word of letters and digits may be one that was misread."""
    return (F.length(error) >= 3) & ~error.rlike(TECHNICAL) & ~error.rlike(r"(?i)^(v\d|\d+\.\d|0x|#[0-9a-f])")


def ocr_words(docs: DataFrame, words: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, pos, start, error, fix): words in which digits stand for letters, told by a list of correct words (a column word).

    The list is a table: it is joined, not compiled into the plan. At most OCR_LIMIT distinct words of a document, in order.
    """
    if words is None:
        words = values_table(docs.sparkSession, [(w,) for w in REFERENCE_WORDS], "word")
    each = located(docs.where(F.col(text_col).rlike("[0-9]")), [id_col], masked(F.coalesce(F.col(text_col), F.lit(""))), F.lit(MIXED))
    each = each.where(_damaged(F.col("error")))
    fixed = each.withColumn("fix", F.translate(F.lower("error"), "01586372", "olsbgetz"))
    known = fixed.where(F.col("fix") != F.lower("error")).join(words.select(F.col("word").alias("fix")).distinct(), "fix", "left_semi")
    first = known.groupBy(id_col, F.lower("error").alias("low")).agg(F.min(F.struct("pos", "start", "error", "fix")).alias("x")).select(id_col, "x.*")
    return first.withColumn("nth", F.row_number().over(W.partitionBy(id_col).orderBy("pos"))).where(F.col("nth") <= OCR_LIMIT).drop("nth")


def tense_mix(bullets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, past, present, example): documents of three or more bullets whose bullets open in both tenses, at least twice each; the first bullet in the rarer tense."""
    word = lambda w: F.col("bullet").rlike(f"(?i)^(?:{w})(?![A-Za-z0-9_])")
    past, present = word(lexicons.PAST), word(lexicons.PRESENT)
    first = lambda c: F.min(F.when(c, F.struct("line_no", "bullet")))["bullet"]
    n = bullets.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(past).alias("past"), F.count_if(~past & present).alias("present"), first(past).alias("first_past"), first(~past & present).alias("first_present"))
    example = F.when(F.col("past") < F.col("present"), F.col("first_past")).otherwise(F.col("first_present"))
    return n.where((F.col("n") >= 3) & (F.least("past", "present") >= 2)).select(id_col, "past", "present", example.alias("example"))


def in_place(issues: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """issues with context (around, characters on both sides, if it is not null) and line, from the place start; of a bounded number for each document."""
    names = [c for c in issues.columns if c != id_col]
    held = issues.groupBy(id_col).agg(F.collect_list(F.struct(*names)).alias("i"))
    each = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(held, id_col)
    low, high = (lambda x: F.greatest(F.lit(0), x["start"] - x["around"])), (lambda x: x["start"] + F.length(x["error"]) + x["around"])
    near = lambda x: F.concat(F.lit('"…'), strip(F.regexp_replace(F.substring(F.col("_t"), low(x) + 1, high(x) - low(x)), r"\r?\n", " ")), F.lit('…"'))
    before = lambda x: F.substring(F.col("_t"), F.lit(1), x["start"])
    line = lambda x: (F.length(before(x)) - F.length(F.replace(before(x), F.lit("\n"), F.lit(""))) + 1).cast("int")
    made = F.transform("i", lambda x: x.withField("context", F.coalesce(near(x), x["context"])).withField("line", F.when(x["start"].isNotNull(), line(x))))
    return each.select(id_col, F.explode(made).alias("x")).select(id_col, "x.*")


def text_issues(docs: DataFrame, rules: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text", limit: int = LIMIT) -> DataFrame:
    """(id, seq, type, severity, error, fix, explanation, context, line): spelling, grammar, punctuation, OCR and tense issues in that order, at most `limit` of a document.

    context: what stands around a spelling, grammar or OCR issue, without line breaks; for mixed tenses an example. line: from 1, null for mixed tenses.
    """
    none = F.lit(None).cast("string")
    found = rule_issues(docs, rules, id_col, text_col).withColumns({"context": none, "around": F.when(F.col("phase") != 3, F.lit(25))})
    ocr = ocr_words(docs, None, id_col, text_col).select(
        id_col, F.lit(4).alias("phase"), F.lit(0).alias("rule"), "start", F.lit("ocr").alias("type"), F.lit("critical").alias("severity"), "error", "fix",
        F.concat(F.lit("OCR corruption: digit(s) substituted for letter(s) — '"), "error", F.lit("' should be '"), "fix", F.lit("'")).alias("explanation"), none.alias("context"), F.lit(20).alias("around"),
    )
    mixed = tense_mix(segment.to_bullets(segment.to_lines(docs, id_col, text_col)), id_col)
    most = F.when(F.col("past") >= F.col("present"), "past").otherwise("present")
    tense = mixed.select(
        id_col, F.lit(5).alias("phase"), F.lit(0).alias("rule"), F.lit(None).cast("int").alias("start"), F.lit("grammar").alias("type"), F.lit("major").alias("severity"),
        F.format_string("Mixed tenses: %d past-tense + %d present-tense bullets", "past", "present").alias("error"), F.concat(F.lit("Standardize all bullets to "), most, F.lit(" tense for consistency")).alias("fix"),
        F.format_string("%d bullets are in the other tense", F.least("past", "present")).alias("explanation"), F.concat(F.lit('Example: "'), F.substring("example", 1, 60), F.lit('…"')).alias("context"), F.lit(None).cast("int").alias("around"),
    )
    order = W.partitionBy(id_col).orderBy("phase", "rule", "start")
    some = found.unionByName(ocr).unionByName(tense).withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= limit).withColumn("line", F.lit(None).cast("int"))
    return in_place(some, docs, id_col, text_col).select(id_col, "seq", "type", "severity", "error", "fix", "explanation", "context", "line")


def repetitions(text: Column) -> Column:
    """How often a word of a text is repeated at once."""
    found = F.regexp_extract_all(text, F.lit(f"({quick(bounded(REPEATED)).replace('{3,}', '{3,}+')})"), F.lit(1))
    return F.size(F.filter(found, lambda m: ~m.rlike(r"^\d+\s+\d+$")))


def with_typos(rows: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", rules: DataFrame | None = None) -> DataFrame:
    """rows with typos, the number of spelling and OCR issues, counted in place: the same as spelling_issues() and ocr_words() have for a document."""
    # most texts hold no misspelling: the given rules are tried as one pattern before each of them is
    some = F.lit(True) if rules is not None else F.col("_masked").rlike(quick(bounded(either("|".join(p for p, _, _ in lexicons.SPELLING)))))
    rules = rule_table(rows.sparkSession) if rules is None else rules
    rules = rules.where("phase = 1").select(F.struct("rule", "type", "pattern", "explanation").alias("term_id"), F.col("cue").alias("term"), F.lit(True).alias("anywhere"))
    always = rules.where("term = ''").agg(F.collect_list("term_id").alias("_always"))
    texts = rows.withColumn("_masked", masked(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_tried", F.when(some, F.col("_masked")).otherwise(""))
    tried = with_terms(texts, rules.where("term <> ''"), id_col, "_tried").crossJoin(F.broadcast(always))  # one row
    matches = lambda p: F.regexp_extract_all("_masked", p, F.lit(0))
    of_rule = lambda r: F.transform(matches(r["pattern"]), lambda e: F.concat(r["type"], F.lit("\u0000"), r["explanation"], F.lit("\u0000"), F.lower(e)))
    spelled = F.size(F.array_distinct(F.flatten(F.transform(F.concat("met", "_always"), of_rule))))
    fix = lambda low: F.translate(low, "01586372", "olsbgetz")
    odd = lambda e: _damaged(e) & bind(F.lower(e), lambda low: (fix(low) != low) & F.array_contains(words(REFERENCE_WORDS), fix(low)))
    damaged = F.least(F.lit(OCR_LIMIT), F.size(F.array_distinct(F.transform(F.filter(matches(F.lit(MIXED)), odd), F.lower))))
    n = F.when((F.col("_tried") != "") & (F.size("met") + F.size("_always") > 0), spelled).otherwise(0) + F.when(F.col("_masked").rlike("[A-Za-z][0-9]|[0-9][A-Za-z]"), damaged).otherwise(0)
    return tried.withColumn("typos", n.cast("long")).drop("_masked", "_tried", "_always", "met")


def typo_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, typos): spelling and OCR issues of the documents that have any."""
    return with_typos(docs.select(id_col, text_col), id_col, text_col).where(F.col("typos") > 0).select(id_col, "typos")


def issue_penalty(issues: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, penalty): 5 for a critical issue, 2.5 for a major one, 1 for a minor one, 20 at most."""
    cost = F.when(F.col("severity") == "critical", 5.0).when(F.col("severity") == "major", 2.5).otherwise(1.0)
    return issues.groupBy(id_col).agg(F.least(F.lit(20.0), F.sum(cost)).alias("penalty"))


def format_issues(issues: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, lines): one line of text for each issue, in order."""
    place = F.when(F.col("line").isNotNull(), F.format_string(" (line %d)", "line")).otherwise("")
    line = F.concat(F.lit("["), F.upper("type"), F.lit('] "'), "error", F.lit('" → "'), "fix", F.lit('" — '), "explanation", place)
    return issues.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]).alias("lines"))


def merge_text_issues(first: Column, second: Column) -> Column:
    """Two lists of issue lines as one: lines about links, addresses or casing left out, equal ones (without case and quotes) once."""
    both = F.filter(F.concat(first, second), lambda s: (strip(s) != "") & ~s.rlike("(?i)https?://|www\\.|linkedin\\.com|github\\.com|@[a-z]|capitali[sz]|casing|lowercase|uppercase"))
    keys = F.transform(both, lambda s: F.regexp_replace(F.lower(s), "[\"'“”‘’]", ""))
    return F.filter(both, lambda s, i: F.array_position(keys, F.get(keys, i)) == i + 1)
