"""Documents against vocabularies, job descriptions, roles and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions import lexicons
from sievelake.functions.text import bind, has_term, match_terms, values_table, words as word_array
from sievelake.operators.term_index import term_hits, with_terms


def job_descriptions(spark: SparkSession) -> DataFrame:
    """The preset job descriptions."""
    rows = values_table(spark, [(i, a, b, c, d, e) for i, (a, b, c, d, e) in enumerate(lexicons.JOB_DESCRIPTIONS)], "jd_id, preset_id, role_title, category, core_skills, description")
    return rows.withColumn("jd_id", F.col("jd_id").cast("long"))


def jd_keywords(jds: DataFrame, vocabulary: tuple[str, ...] = lexicons.SKILLS) -> DataFrame:
    """(jd_id, keywords): the vocabulary's terms if there are three or more; else those and the ten most frequent other tokens, ties by first appearance, 15 at most."""
    known = jds.select("jd_id", "description", match_terms(F.col("description"), vocabulary).alias("terms"))
    stop = word_array(tuple(dict.fromkeys(lexicons.STOP_WORDS + lexicons.CORPORATE_WORDS)))
    words = F.split(F.regexp_replace(F.lower("description"), r"[^a-z0-9+#./\s-]", " "), r"\s+")
    few = known.where(F.size("terms") < 3).select("jd_id", F.posexplode(words).alias("pos", "token"))
    few = few.where((F.length("token") >= 3) & ~F.array_contains(stop, F.col("token")) & ~F.col("token").rlike(r"^\d+$"))
    counted = few.groupBy("jd_id", "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    top = counted.withColumn("rank", F.row_number().over(W.partitionBy("jd_id").orderBy(F.desc("n"), "pos"))).where(F.col("rank") <= 10)
    more = top.groupBy("jd_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("more"))
    both = known.join(more, "jd_id", "left")
    mixed = F.slice(F.array_distinct(F.concat("terms", F.coalesce("more", F.array().cast("array<string>")))), 1, 15)
    return both.select("jd_id", F.when(F.size("terms") >= 3, F.col("terms")).otherwise(mixed).alias("keywords"))


def jd_overlap(matched: Column, proven: Column, keywords: Column) -> dict[str, Column]:
    """matched and missing keywords, and how many of the matched ones are proven; matched: a column of terms_in(), so that the text is searched once."""
    return {"matched": matched, "missing": F.slice(F.array_except(keywords, matched), 1, 20), "proven_matched": F.size(F.array_intersect(matched, proven))}


def match_jds(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, jd_id, matched, keywords): for many job descriptions at once, all pairs with a keyword in common.

    Keywords are turned around into an equi-join on the keyword, so that the work follows the matches, not documents times descriptions.
    """
    words = keywords.select("jd_id", F.explode("keywords").alias("keyword"), F.size("keywords").alias("n_keywords"))
    spaced = ~F.col("keyword").rlike("^[a-z0-9+#.]+$")
    runs = docs.select(id_col, F.explode(F.array_distinct(F.split(F.lower(text_col), "[^a-z0-9+#.]+"))).alias("keyword"))
    hits = runs.join(words.where(~spaced), "keyword").select(id_col, "jd_id", "keyword", "n_keywords")
    # a term with separators is found by its first run, then checked in the text
    lead = words.where(spaced).withColumn("run", F.regexp_extract("keyword", "([a-z0-9+#.]+)", 1))
    tried = runs.withColumnRenamed("keyword", "run").join(lead, "run").join(docs.select(id_col, text_col), id_col)
    hits = hits.union(tried.where(has_term(F.col(text_col), F.col("keyword"))).select(id_col, "jd_id", "keyword", "n_keywords").distinct())
    return hits.groupBy(id_col, "jd_id", "n_keywords").agg(F.count(F.lit(1)).alias("n_matched"), F.array_sort(F.collect_list("keyword")).alias("matched"))


def arc_table(spark: SparkSession, arcs=lexicons.ROLE_ARCS) -> DataFrame:
    """(arc_no, arc, signal_no, signal): roles in order of precedence, with their signals."""
    return values_table(spark, [(i, a, k, s) for i, (a, signals) in enumerate(arcs) for k, s in enumerate(signals)], "arc_no, arc, signal_no, signal")


def role_arcs(docs: DataFrame, arcs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, arc, arc_score, arc_signals): the role with most signals anywhere in a text, ties to the earlier role, a default where there is none.

    arcs is a table of any size; its signals are found through an inverted index.
    """
    rows = with_role(docs.select(id_col, text_col), arcs, id_col, text_col)
    return rows.select(id_col, "role.arc", "role.arc_score", "role.arc_signals")


def with_role(rows: DataFrame, arcs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """rows with role, a struct of the columns of role_arcs()."""
    arcs = arc_table(rows.sparkSession) if arcs is None else arcs
    signals = arcs.select(F.struct("arc_no", "arc", "signal_no", F.lower("signal").alias("term")).alias("term_id"), F.lower("signal").alias("term"), F.lit(True).alias("anywhere"))
    found = with_terms(rows, signals, id_col, text_col)
    of_arc = lambda a: F.filter("met", lambda m: m["arc_no"].eqNullSafe(a["arc_no"]) & m["arc"].eqNullSafe(a["arc"]))
    arcs_met = F.array_distinct(F.transform("met", lambda m: F.struct(m["arc_no"], m["arc"])))
    best = F.array_max(F.transform(arcs_met, lambda a: F.struct(F.size(of_arc(a)).alias("n"), (-a["arc_no"]).alias("no"), a["arc_no"].alias("arc_no"), a["arc"].alias("arc"))))
    own = F.transform(F.array_sort(F.transform(of_arc(F.col("_best")), lambda m: F.struct(m["signal_no"], m["term"]))), lambda x: x["term"])
    none = F.struct(F.lit(lexicons.DEFAULT_ARC).alias("arc"), F.lit(0).alias("arc_score"), F.array().cast("array<string>").alias("arc_signals"))
    role = F.when(F.col("_best").isNotNull(), F.struct(F.col("_best.arc").alias("arc"), F.col("_best.n").alias("arc_score"), own.alias("arc_signals"))).otherwise(none)
    return found.withColumn("_best", best).withColumn("role", role).drop("_best", "met")


def tool_table(spark: SparkSession, tools=lexicons.AI_TOOLS) -> DataFrame:
    """(tool_no, name, category, domestic)."""
    return values_table(spark, [(i, *t) for i, t in enumerate(tools)], "tool_no, name, category, domestic")


def ai_tools(docs: DataFrame, tools: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, tools): structs (name, category, domestic) of the tools named anywhere in a text, in table order; documents that name none are left out."""
    tools = tool_table(docs.sparkSession) if tools is None else tools
    names = tools.select(F.struct("tool_no", "name", "category", "domestic").alias("term_id"), F.lower("name").alias("term"), F.lit(True).alias("anywhere"))
    found = term_hits(docs, names, id_col, text_col).groupBy(id_col).agg(F.array_sort(F.collect_list("term_id")).alias("t"))
    return found.select(id_col, F.transform("t", lambda x: x.dropFields("tool_no")).alias("tools"))


def tool_summary(tools: Column) -> Column:
    names = F.array_join(F.slice(F.transform(tools, lambda t: t["name"]), 1, 5), ", ")
    labels = F.create_map(*(F.lit(x) for pair in lexicons.TOOL_LABELS for x in pair))
    kinds = F.transform(F.array_distinct(F.transform(tools, lambda t: t["category"])), lambda c: F.element_at(labels, c))
    return F.when(F.size(tools) == 0, "Standard Engineering Stack").otherwise(F.array_join(F.concat(F.array(F.concat(F.lit("AI Stack ("), names, F.lit(")"))), kinds), " · "))


def recommendations(text: Column, owned: Column, tracks=lexicons.TRACKS) -> Column:
    """Three skills of the first track that the text names a word of, without those owned."""
    return not_owned(track(text, tracks), owned)


def not_owned(pool: Column, owned: Column) -> Column:
    """The first three skills of a pool without those owned."""
    return bind(F.transform(owned, F.lower), lambda held: F.slice(F.filter(pool, lambda s: ~F.array_contains(held, F.lower(s))), 1, 3))


def track(text: Column, tracks=lexicons.TRACKS) -> Column:
    """The skills of the first track that the text names a word of."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pool = None
    for words, skills in reversed(tracks):
        own = F.array(*(F.lit(s) for s in skills))
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        pool = own if pool is None else F.when(test, own).otherwise(pool)
    return pool


def arc_profile(docs: DataFrame, arcs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(arc, docs)."""
    return role_arcs(docs, arcs, id_col, text_col).groupBy("arc").agg(F.count(F.lit(1)).alias("docs"))


def tool_profile(docs: DataFrame, tools: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(category, docs): documents that name a tool of the category."""
    kinds = F.array_distinct(F.transform("tools", lambda t: t["category"]))
    return ai_tools(docs, tools, id_col, text_col).select(F.explode(kinds).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("docs"))
