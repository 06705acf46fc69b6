"""From raw documents to packed training sequences: five stages, each over all rows that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. run() writes each result as Parquet to
the shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import decontam, langid, line_dedup, near_dedup, packing
from sievelake.llm.common import keyed, row_key, table, written

#: Languages to keep (None: all that were learned), and the least score that a document of them needs.
LANGUAGES: tuple[str, ...] | None = None
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES, least: float = LEAST_SCORE) -> DataFrame:
    """Keep the documents in the languages to keep; those of others, of none that was learned, and without letters go.

    Null and empty texts go; long texts are scored whole; ties of score go to the first language; repeated rows are kept or go together, and all of them
    are kept; ids may be null or shared; an empty table gives no rows; further columns are kept, whatever their names.
    """
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    rows = keyed(docs, row_key("doc_id", "text"))
    known = langid.predict(rows.select("key", F.col("row.text").alias("text")), model, "key").where(F.col("score") >= least)
    known = known.where(F.col("lang_pred").isin(*languages)) if languages is not None else known
    return rows.join(known.select("key").distinct(), "key", "left_semi").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines; documents of which nothing is left go. n_chars follows the text.

    Null and empty texts stay; long texts are cut whole; of equal runs the one of the least id stays; repeated rows count as one document and are cut alike;
    a null id comes first; an empty table gives no rows; further columns are kept.
    """
    cut = line_dedup.drop_repeated_lines(docs)
    kept = cut.where((F.col("removed_lines") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    kept = kept.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near duplicates: the one of the least id, a null id last.

    Null, empty and wordless texts form classes of equal ones; long texts are compared whole; of repeated rows one stays; different texts that share an id
    are different documents; an empty table gives no rows; further columns are kept.
    """
    return near_dedup.first_of_classes(docs, near_dedup.near_duplicates(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the documents that hold a window of a benchmark item.

    Null and empty texts stay; long texts are scanned whole; repeated rows stay or go together; ids may be null or shared; an empty table gives no rows, and
    an empty benchmark removes none; further columns are kept.
    """
    return decontam.without_hits(docs, decontam.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into token sequences.

    Null and empty texts are an end token; long texts give many pieces; repeated rows are packed each; an empty table gives no rows; further columns are
    left out.
    """
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", benchmark), ("packing", sequences)]

#: Token ids, order MinHash and fitted models are not expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
