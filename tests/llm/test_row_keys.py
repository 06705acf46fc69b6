from sievelake.llm import decontam, near_dedup

ROWS = [(None, "red fox over the lazy dog at noon"), (None, "green bird under a busy bridge by night"), (7, "blue whale in the wide sea of the north"), (7, "grey wolf on a long road to the south"), (8, "green bird under a busy bridge by night"), (9, "plain words")]


def texts(df):
    return sorted((str(r["doc_id"]), r["text"]) for r in df.collect())


def test_null_and_shared_ids_keep_each_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    kept = near_dedup.first_of_classes(df, near_dedup.near_duplicates(df))
    assert texts(kept) == sorted((str(i), t) for i, t in ROWS if (i, t) != (None, ROWS[1][1]))


def test_only_rows_with_hits_go(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "red fox over the lazy dog"), (2, "grey wolf on a long road")], "item_id long, text string")
    kept = decontam.without_hits(df, decontam.find_contamination(df, bench))
    assert texts(kept) == sorted((str(i), t) for i, t in ROWS if t not in (ROWS[0][1], ROWS[3][1]))


def test_passes_agree_for_null_and_shared_ids(spark):
    rows = [*ROWS, ROWS[0], ROWS[2], ROWS[2], (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "fox over the lazy"), (2, "lazy dog"), (3, "lazy dog"), (4, "wolf on a long")], "item_id long, text string").coalesce(1)
    one, many = (sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["spans"], r["items"])) for r in decontam.find_contamination(df, bench, max_windows=m).collect()) for m in (100, 1))
    assert len(one) == len(rows) and one == many
