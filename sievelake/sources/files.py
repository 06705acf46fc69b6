"""Corpora from files and tables, page layout, and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE, MAX_BATCH = 15 * 1024 * 1024, 150 * 1024 * 1024
KINDS = (("pdf", r"\.pdf$"), ("docx", r"\.docx$"), ("image", r"\.(png|jpe?g|webp|bmp|tiff?)$"), ("text", r"\.(txt|md|rtf|csv)$"))


def file_kind(name: Column) -> Column:
    kind = F.lit("unsupported")
    for k, p in reversed(KINDS):
        kind = F.when(F.lower(name).rlike(p), k).otherwise(kind)
    return kind


def classify_files(files: DataFrame) -> DataFrame:
    """path, length to path, file_name, kind, length: without unsupported and junk files, and those that are empty or too large."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("file_name", name).withColumn("kind", file_kind(name))
    junk = F.col("path").contains("__MACOSX") | F.col("file_name").startswith(".")
    return rows.where((F.col("kind") != "unsupported") & ~junk & F.col("length").between(1, MAX_FILE))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, kind, length, content) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return classify_files(files).select("path", "file_name", "kind", "length", "content")


def quota_report(files: DataFrame, most: int = MAX_BATCH) -> DataFrame:
    """One row: files, bytes, whether within the quota."""
    total = F.coalesce(F.sum("length"), F.lit(0))
    return files.agg(F.count(F.lit(1)).alias("files"), total.alias("bytes"), (total <= most).alias("within"))


def decode_text(files: DataFrame) -> DataFrame:
    """Adds text: the content of text files as UTF-8, bytes that are none replaced, trimmed."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("text", F.when(F.col("kind") == "text", F.regexp_replace(text, r"^\s+|\s+\z", "")))


def submissions(docs: DataFrame) -> DataFrame:
    """(doc_id, file_name, seq, raw_text) of rows of the documents table, batch or stream."""
    return docs.select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.lit(1).alias("seq"), F.col("text").alias("raw_text"))


def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions from the documents table."""
    return submissions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def reconstruct_layout(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, text) from positioned tokens (doc_id, page, page_width, seq, str, x, y, w, h).

    A page of more than 20 tokens is in two columns if each side holds over a quarter of them and both at least 85 %, apart from a gutter of 15 on both sides
    of the middle. A line holds the tokens within 3.5 of its first one's height; a gap of over 2.5 becomes a blank.
    """
    page = ["doc_id", "page"]
    half = F.col("page_width") / 2
    side = F.when(F.col("x") + F.greatest(F.col("w"), F.lit(0.0)) <= half + 15, "left").when(F.col("x") >= half - 15, "right").otherwise("both")
    n = tokens.withColumn("side", side).groupBy(*page).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "left").alias("nl"), F.count_if(F.col("side") == "right").alias("nr"))
    two = (F.col("n") > 20) & (F.col("nl") > 0.25 * F.col("n")) & (F.col("nr") > 0.25 * F.col("n")) & (F.col("nl") + F.col("nr") >= 0.85 * F.col("n"))
    placed = tokens.join(n.select(*page, two.alias("two")), page).withColumn("column", F.when(F.col("two") & (F.col("x") >= half - 15), 1).otherwise(0))
    token = F.struct((-F.col("y")).alias("down"), "x", "seq", "str", "w", "y")
    columns = placed.groupBy(*page, "column").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    line = "struct<y:double,items:array<struct<x:double,seq:int,str:string,w:double>>>"

    def fold(acc: Column, t: Column) -> Column:
        item = F.struct(t["x"].alias("x"), t["seq"].cast("int").alias("seq"), t["str"].alias("str"), t["w"].alias("w"))
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.abs(last["y"] - t["y"]) <= 3.5)
        grown = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["y"].alias("y"), F.array_append(last["items"], item).alias("items")))
        return F.when(joins, grown).otherwise(F.array_append(acc, F.struct(t["y"].alias("y"), F.array(item).alias("items"))))

    def line_text(x: Column) -> Column:
        start = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("right"))

        def put(acc: Column, t: Column) -> Column:
            gap = acc["right"].isNotNull() & (t["x"] - acc["right"] > 2.5) & ~acc["t"].endswith(" ")
            return F.struct(F.concat(acc["t"], F.when(gap, " ").otherwise(""), t["str"]).alias("t"), (t["x"] + F.greatest(t["w"], 4.0 * F.length(t["str"]))).alias("right"))

        return F.aggregate(F.array_sort(x["items"]), start, put, lambda a: F.trim(a["t"]))

    lines = F.aggregate("tokens", F.array().cast(f"array<{line}>"), fold)
    texts = columns.select(*page, "column", F.array_join(F.filter(F.transform(lines, line_text), lambda s: s != ""), "\n").alias("t"))
    both = texts.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("column", "t"))).alias("c"))
    return both.select(*page, F.array_join(F.filter(F.transform("c", lambda c: c["t"]), lambda s: s != ""), "\n\n").alias("text"))


def assemble_pages(pages: DataFrame, least: int = 40) -> DataFrame:
    """(doc_id, n_pages, text, reject): pages in order under their marks; documents of at most `least` characters that aren't blank are rejected."""
    each = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.trim("text").alias("t")))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.concat(F.lit("--- Page "), x["page"].cast("string"), F.lit(" ---\n"), x["t"])), "\n\n")
    n = F.aggregate("p", F.lit(0), lambda a, x: a + F.length(F.regexp_replace(x["t"], r"\s", "")))
    return each.select("doc_id", F.size("p").alias("n_pages"), body.alias("text"), F.when(n <= least, "no readable text").alias("reject"))
