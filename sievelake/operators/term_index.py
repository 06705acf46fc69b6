"""Which terms of a table occur in which documents: an inverted index of the terms, joined with the tokens of the documents.

A term is filed under one lead, a run of its characters. Where the term's boundaries make a run a whole token of every text that holds the term, its rarest
such run is the lead, and an equi-join with the texts' tokens finds it. A term that counts inside of words has its longest run as lead; which tokens hold
that run is told once for each different token of the corpus, by a join on short runs of characters. Only terms that are more than their lead are then
searched in the text. The table can be of any size; it is data, and no part of the plan. Where it holds only terms that count inside of words, and up to
SCANNED of them, it is broadcast as one row and each text is scanned in place.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.text import TERM_CHARS, bind, tokens, values_table

#: Characters by which a lead is looked for in tokens.
GRAM = 3
#: So many terms that count inside of words are looked for in each text, one after the other.
SCANNED = 1000
#: The lead of terms without a term character, which every text has.
_EVERY = "~"


def term_table(spark: SparkSession, terms: Iterable[str], anywhere: bool = False) -> DataFrame:
    """(term_id, term, anywhere) of a vocabulary in order. anywhere: a term counts inside of words too, not only between boundaries."""
    return values_table(spark, [(i, t, anywhere) for i, t in enumerate(terms)], "term_id, term, anywhere")


def token_frequencies(docs: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """(token, n): in how many documents a token occurs."""
    each = docs.select(F.explode(F.array_distinct(tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("token"))
    return each.where(F.col("token") != "").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def index_terms(terms: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """terms (term_id, term, anywhere) with lead, inside (the lead may be part of a token) and sure (a text that holds the lead holds the term).

    The lead is the rarest of the runs that must be whole tokens, by frequencies (token, n) if given, else the longest; for a term that counts anywhere, the
    longest of its runs; without any run a mark, so that the term is tried on every text.
    """
    rows = terms.withColumn("_runs", F.regexp_extract_all("term", F.lit(f"([{TERM_CHARS}]+)"), F.lit(1)))
    longest = F.array_max(F.transform("_runs", lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r"))))["r"]
    lead = F.coalesce(longest, F.lit(_EVERY))
    if frequencies is not None:
        each = rows.where(~F.col("anywhere")).select("term_id", F.explode("_runs").alias("token")).join(frequencies, "token", "left")
        rarest = each.groupBy("term_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token")).alias("_rarest"))
        rows, lead = rows.join(rarest, "term_id", "left"), F.coalesce("_rarest", lead)
    return rows.withColumn("lead", lead).select("term_id", "term", "anywhere", "lead", (F.col("anywhere") & (F.col("lead") != _EVERY)).alias("inside"), (F.col("lead") == F.col("term")).alias("sure"))


def _grams(c: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, GRAM + 1)))))


def tokens_with(vocabulary: DataFrame, index: DataFrame) -> DataFrame:
    """(token, term_id, term, anywhere, sure): which tokens of a vocabulary hold the leads that may be part of one."""
    inside = index.where("inside").withColumn("gram", F.substring("lead", 1, GRAM))
    each = vocabulary.select("token", F.explode(_grams(F.col("token"))).alias("gram"))
    return each.join(inside, "gram").where(F.contains("token", F.col("lead"))).select("token", "term_id", "term", "anywhere", "sure")


def _holds(low: Column, t: Column) -> Column:
    return t["sure"] | (F.contains(low, t["term"]) & (t["anywhere"] | F.rlike(low, F.concat(F.lit(rf"(^|[^{TERM_CHARS}])\Q"), t["term"], F.lit(rf"\E([^{TERM_CHARS}]|$)")))))


def _few(index: DataFrame) -> bool:
    """Whether all terms count inside of words and are so few that one pattern can hold them."""
    n = index.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("anywhere") & (F.col("term") != "")).alias("inside")).first()
    return n["all"] == n["inside"] <= SCANNED


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _scanned(texts: DataFrame, index: DataFrame, text_col: str) -> DataFrame:
    """texts with met, structs (term_id, term) of the terms in each, without a shuffle: the terms are one row of SCANNED at most, met by one pattern in one pass.

    Alternatives are filed by their first character, the longest first; what a place holds beside the one found is part of that one.
    """
    table = index.agg(F.collect_set(F.struct("term_id", "term")).alias("_terms"))
    longest_first = F.transform(F.array_sort(F.transform(F.array_distinct(F.transform("_terms", lambda t: t["term"])), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda x: x["k"])
    table = table.withColumn("_keys", longest_first)
    any_of = lambda cs: F.concat(F.lit("(?=["), _quoted(F.array_join(cs, "")), F.lit("])"))
    nth = lambda ks, n: F.array_distinct(F.transform(ks, lambda k: F.substring(k, n, 1)))
    rest = lambda c: F.transform(F.filter("_keys", lambda k: F.substring(k, 1, 1) == c), lambda k: F.substring(k, 2, 1 << 30))
    second = lambda rs: F.when(F.array_contains(rs, ""), "").otherwise(any_of(nth(rs, 1)))
    file = lambda c: bind(rest(c), lambda rs: F.concat(_quoted(c), second(rs), F.lit("(?:"), F.array_join(F.transform(rs, _quoted), "|"), F.lit(")")))
    table = table.withColumn("_firsts", F.array_sort(nth("_keys", 1)))
    # a place is tried with a few first characters at once, then with one
    some = F.transform(F.sequence(F.lit(0), F.floor(F.size("_firsts") / 5).cast("int")), lambda g: F.slice("_firsts", (g * 5 + 1).cast("int"), F.lit(5)))
    files = F.array_join(F.transform(F.filter(some, lambda cs: F.size(cs) > 0), lambda cs: F.concat(any_of(cs), F.lit("(?:"), F.array_join(F.transform(cs, file), "|"), F.lit(")"))), "|")
    places = F.transform("_terms", lambda t, i: F.struct(i.alias("i"), t["term"].alias("term")))
    parts = F.transform("_keys", lambda k: F.transform(F.filter(places, lambda p: F.contains(k, p["term"])), lambda p: p["i"]))
    table = table.select("_terms", F.when(F.size("_keys") > 0, F.concat(F.lit("(?=("), files, F.lit("))"))).otherwise("(?!)").alias("_pattern"), F.map_from_arrays("_keys", parts).alias("_parts"))
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.col("_pattern"), F.lit(1)))
    own = F.array_distinct(F.flatten(F.transform(found, lambda k: F.element_at("_parts", k))))
    met = F.transform(own, lambda i: F.get("_terms", i))
    # the table is long, so that a text without a character is not joined with it
    held = texts.join(F.broadcast(table), F.col(text_col) != "", "left")
    return held.withColumn("met", F.coalesce(met, F.array().cast(table.schema["_terms"].dataType))).drop("_terms", "_pattern", "_parts")


def with_terms(texts: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """texts with met, the term_ids of the terms in each, in no order: term_hits() by row. Ids are unique."""
    index = index_terms(terms)
    if _few(index):
        return _scanned(texts, index, text_col).withColumn("met", F.transform("met", lambda t: t["term_id"]))
    met = term_hits(texts, terms, id_col, text_col).groupBy(id_col).agg(F.collect_list("term_id").alias("met"))
    return texts.join(met, id_col, "left").withColumn("met", F.coalesce("met", F.slice(F.array(F.lit(None)).cast(met.schema["met"].dataType), 1, 0)))


def term_hits(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", frequencies: DataFrame | None = None) -> DataFrame:
    """(id, term_id, term): each term of each document once. terms: term_id (of any type), term (lower-cased), anywhere. Ids are unique; null texts have none."""
    index = index_terms(terms, frequencies)
    if _few(index):
        texts = docs.select(id_col, F.col(text_col).alias("low")).where(F.col("low").isNotNull())
        return _scanned(texts, index, "low").select(id_col, F.explode("met").alias("t")).select(id_col, "t.term_id", "t.term")
    texts = docs.select(id_col, F.lower(F.col(text_col)).alias("low")).where(F.col("low").isNotNull())
    own = F.array_append(F.filter(tokens(F.col("low")), lambda t: t != ""), F.lit(_EVERY))
    each = texts.select(id_col, F.explode(F.array_distinct(own)).alias("token"))
    filed = index.where("NOT inside").select(F.col("lead").alias("token"), "term_id", "term", "anywhere", "sure").unionByName(tokens_with(each.select("token").distinct(), index))
    met = each.join(filed, "token").groupBy(id_col).agg(F.collect_set(F.struct("term_id", "term", "anywhere", "sure")).alias("met"))
    checked = texts.join(met, id_col).select(id_col, F.explode(F.filter("met", lambda t: _holds(F.col("low"), t))).alias("t"))
    return checked.select(id_col, "t.term_id", "t.term")


def found_terms(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", frequencies: DataFrame | None = None) -> DataFrame:
    """(id, terms): the terms of each document in the order of their term_id; every document is kept."""
    hits = term_hits(docs, terms, id_col, text_col, frequencies).groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("term_id", "term"))), lambda x: x["term"]).alias("terms"))
    return docs.select(id_col).join(hits, id_col, "left").select(id_col, F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
