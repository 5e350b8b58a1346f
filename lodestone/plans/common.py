"""What the registered queries share: tables, views of them in the engine's terms, and SQL fragments with the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources: id, body, key, uri, version, status."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("body"), F.col("source").alias("uri"), F.col("doc_id").cast("string").alias("key"), "lang", "n_chars")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages as queries, with their tokens."""
    return read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"), tx.fields(F.col("text")).alias("tokens"))


def sql_fields(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({x}, '[0-9A-Za-z一-鿿]{{2,}}'), lambda r: CASE WHEN regexp_matches(r, '^[一-鿿]') THEN list_transform(range(1, length(r)), lambda i: lower(substr(r, i, 2))) ELSE [lower(r)] END))"


def sql_unigrams(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace({x}, '(是多少|是多大|是多小|是啥|是什么|怎么样|如何|怎么|为什么|吗|呢|了|啊|呀)+\\s*$', ''), '[一-鿿]|[0-9A-Za-z]+'), lambda w: lower(w))))"


def sql_hits(tokens: str, text: str) -> str:
    return f"len(list_filter({tokens}, lambda t: contains({text}, t)))"


def sql_keyword_score(tokens: str, text: str) -> str:
    d = f"({sql_hits(tokens, f'lower({text})')}::DOUBLE / len({tokens}))"
    return f"CASE WHEN len({tokens}) = 0 OR {sql_hits(tokens, f'lower({text})')} = 0 THEN 0.0 WHEN {d} >= 0.8 THEN 8 + 2 * {d} - 1.6 WHEN {d} >= 0.4 THEN 5 + 3 * ({d} - 0.4) / 0.4 ELSE 1 + 10 * {d} END"


def sql_coverage(tokens: str, text: str) -> str:
    return f"CASE WHEN len({tokens}) = 0 THEN 0.0 ELSE {sql_hits(tokens, f'lower({text})')}::DOUBLE / len({tokens}) END"


#: Common table expressions with which SQL queries begin.
ITEMS = f"items AS (SELECT item_id, text AS query, {sql_fields('text')} AS tokens FROM benchmark)"
POSTINGS = f"""toks AS (SELECT doc_id, unnest({sql_fields('text')}) AS term FROM documents),
    postings AS (SELECT term, doc_id, count(*) AS tf FROM toks GROUP BY 1, 2),
    lens AS (SELECT doc_id, count(*) AS dl FROM toks GROUP BY 1),
    stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM toks)::DOUBLE / (SELECT count(*) FROM documents) AS avg_dl),
    dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1)"""
QTERMS = "qterms AS (SELECT DISTINCT item_id, unnest(tokens) AS term FROM items)"
SCORES = """scores AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
        FROM qterms JOIN postings USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY 1, 2)"""
BM25 = f"{ITEMS}, {POSTINGS}, {QTERMS}, {SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk FROM scores)"
