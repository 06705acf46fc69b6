import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sievelake.llm import langid, pii, secrets_scan, sharding

DATA = "/root/testdata/sf0.001"
NAMES = ("id", "key", "row", "node", "span", "spans", "kind", "start", "end", "shard", "slot", "size", "rank", "score", "features", "cell", "pairs", "lang_pred", "value", "pos")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_columns_of_clashing_names_change_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)  # a small fixture
    wide = docs.select("*", *(F.lit(7).alias(n) for n in NAMES if n not in docs.columns))
    stats = lambda df: sharding.slot_stats(df, "doc_id", "text", 64)
    for name, run in (
        ("op1", lambda df: secrets_scan.find_secrets(df)), ("op5", lambda df: pii.find_pii(df, pii.fit(df, "doc_id", "text"))), ("op8", lambda df: sharding.shard(df, sharding.first_map(stats(df), 4), n_slots=64)),
        ("op10", lambda df: langid.predict(df, langid.fit(df), "doc_id")),
    ):
        a, b = run(docs), run(wide)
        assert a.columns == b.columns, name
        told = [c for c in a.columns if name != "op10" or c != "score"]  # a fitted score may differ by rounding
        assert sorted(map(str, a.select(told).collect())) == sorted(map(str, b.select(told).collect())), name


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
