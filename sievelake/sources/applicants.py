"""Synthetic applicants, one for each customer, whose sizes follow the customer and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Statement that Spark and DuckDB both run; tables: customer, orders.
APPLICANTS_SQL = """
SELECT k AS doc_id, CONCAT('cand_', k, '.pdf') AS file_name, 1 AS seq, k % 6 AS jd_id, n AS n_orders, raw_text FROM applicant_texts
UNION ALL
SELECT k + 1000000, UPPER(CONCAT('cand_', k, '.pdf')), 2, k % 6, n, CONCAT(raw_text, CHR(10), '- Wrote tests with pytest') FROM applicant_texts WHERE k % 10 = 0
"""
TEXTS_SQL = """
SELECT k, n, CONCAT_WS(CHR(10),
    CONCAT('Asha K', TRANSLATE(CAST(k AS STRING), '0123456789', 'abcdefghij')),
    CONCAT_WS(' | ',
      CASE WHEN k % 7 <> 0 THEN CONCAT('user', k, '@mail.example.com') END,
      CASE WHEN k % 5 <> 0 THEN CONCAT('+1 555 ', 1000000 + k) END,
      CASE WHEN k % 3 = 0 THEN CONCAT('linkedin.com/in/user', k) END,
      CASE WHEN k % 2 = 0 THEN CONCAT('github.com/user', k) END),
    CASE WHEN k % 4 = 0 THEN 'Summary' END,
    CASE WHEN k % 4 = 0 THEN 'Engineer who ships services and measures them in production.' END,
    'Technical Skills',
    CASE k % 6 WHEN 0 THEN 'python, django, postgresql, redis, docker'
               WHEN 1 THEN 'java, spring boot, mysql, kafka'
               WHEN 2 THEN 'react, typescript, next.js, jest'
               WHEN 3 THEN 'aws, terraform, kubernetes, ci/cd, linux'
               WHEN 4 THEN 'pytorch, langchain, rag, qwen, milvus'
               ELSE 'sql, tableau' END,
    CASE WHEN k % 3 <> 1 THEN 'Experience' END,
    CASE WHEN k % 3 <> 1 AND k % 8 <> 0 THEN 'Intern, Acme (2022 - 2023)' END,
    CASE WHEN k % 3 <> 1 THEN CONCAT('- Engineered ', n, ' batch jobs with kafka and redis, cutting cost by ', n % 60, '%') END,
    CASE WHEN k % 4 = 1 THEN '- Responsible for testing of the reporting screens' END,
    CASE WHEN k % 5 <> 3 THEN 'Projects' END,
    CASE WHEN k % 5 <> 3 THEN 'Ledger Sync' END,
    CASE WHEN k % 5 <> 3 THEN CONCAT('- Built a ledger in python and docker used by ', 100 + n, ' users') END,
    CASE WHEN k % 5 < 2 THEN 'Route Finder' END,
    CASE WHEN k % 5 < 2 THEN '- Designed a route finder with redis caching in react' END,
    CASE WHEN k % 11 = 0 THEN '- Devlopment of the app was dep1oyed late' END,
    CASE WHEN k % 9 <> 0 THEN '- Measured latency, memory and throughput on every release and wrote down what changed and why it changed' END,
    CASE WHEN k % 9 <> 0 THEN '- Reviewed designs with peers each week and kept a short written record of the choices and the open points' END,
    CASE WHEN k % 9 <> 0 THEN '- Automated the nightly checks so that a failed load is found before the first reader opens the morning page' END,
    CASE WHEN k % 13 = 0 THEN CONCAT('- Manage a team of ', 2 + n % 7, ' people who work on the billing screens') END,
    CASE WHEN k % 13 = 0 THEN '- Lead the weekly review of open defects' END,
    CASE WHEN k % 17 = 0 THEN '- Acheived and acheived recieved awards for the managment of of the releases' END,
    CASE WHEN k % 5 = 0 THEN 'Education' END,
    CASE WHEN k % 5 = 0 THEN 'B.Tech, State College, 2024' END) AS raw_text
FROM applicant_sizes
"""
SIZES_SQL = """
SELECT c_custkey AS k, COALESCE(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey
"""
#: The same as common table expressions, for statements that go on from `applicants`.
APPLICANTS_CTE = f"applicant_sizes AS ({SIZES_SQL}), applicant_texts AS ({TEXTS_SQL}), applicants AS ({APPLICANTS_SQL})"


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, seq, jd_id, n_orders, raw_text), made by Spark from the given tables.

    Keys and sizes take few bytes, by which Spark would choose few partitions; the texts made of them are long, so that the sizes are dealt out first.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders")}
    sizes = spark.sql(SIZES_SQL.replace("FROM customer LEFT", "FROM {customer} LEFT").replace("FROM orders GROUP", "FROM {orders} GROUP"), **tables)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    statement = f"WITH applicant_texts AS ({TEXTS_SQL}), applicants AS ({APPLICANTS_SQL}) SELECT * FROM applicants"
    return spark.sql(statement.replace("FROM applicant_sizes", "FROM {sizes}"), sizes=sizes.repartition(parts, "k"))
