"""Queries of the text operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import word_key
from tidemark.llm import frequent, leaks, personal, tokenize
from tidemark.session import table


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "input_rows").select(word_key(F.col("word")).alias("word"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.most_frequent(_words(spark, d), "word", 20).select("word")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequent.most_frequent(_words(spark, d), "word", 20).select("word", "n")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"), "doc_id")


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many texts and ids each language has."""
    docs = table(spark, d, "documents").select(F.struct("doc_id", F.lower(F.btrim("lang")).alias("lang")).alias("doc"), "text")
    ids = tokenize.encode(docs, "doc")
    return ids.groupBy(F.col("doc.lang").alias("lang")).agg(F.count("*").alias("texts"), F.sum(F.size("ids")).alias("n_ids"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_reworded(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_reworded(table(spark, d, "documents"), table(spark, d, "eval_items")).withColumn("shared", F.round("shared", 4))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_personal_data(table(spark, d, "documents"), table(spark, d, "name_parts"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(table(spark, d, "documents"), table(spark, d, "name_parts"))


QUERIES = {f.__name__: f for f in (p6_found, p6_counts, p8_ids, p8_counts, p9_found, p9_reworded, p10_found, p10_redacted)}

_RUNS = """
    w AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word,
                 generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS n FROM {table}),
    {name} AS (SELECT {key}, string_agg(word, ' ') OVER (PARTITION BY {key} ORDER BY n ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS run,
                      count(*) OVER (PARTITION BY {key} ORDER BY n ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS size FROM w)
"""

_WORD = "nullif(lower(trim(word, E' \\t\\r\\n')), '')"

ORACLES = {
    "p6_found": f"SELECT word FROM (SELECT {_WORD} AS word, count(*) AS n FROM input_rows GROUP BY 1) WHERE word IS NOT NULL ORDER BY n DESC, word LIMIT 20",
    "p6_counts": f"SELECT word, n FROM (SELECT {_WORD} AS word, count(*) AS n FROM input_rows GROUP BY 1) WHERE word IS NOT NULL ORDER BY n DESC, word LIMIT 20",
    "p9_found": f"""
        WITH items AS (WITH {_RUNS.format(key='item_id', table='eval_items', name='r')} SELECT DISTINCT item_id, run FROM r WHERE size = 12),
        docs AS (WITH {_RUNS.format(key='doc_id', table='documents', name='r')} SELECT DISTINCT doc_id, run FROM r WHERE size = 12)
        SELECT DISTINCT doc_id, item_id FROM docs JOIN items USING (run)""",
}
