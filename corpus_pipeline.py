"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import language, mixing, packing, quality, simhash
from lodestone.llm.common import scratch, tokenizer_file

#: A document whose best language has less than this many times an even share of all languages' hits is rejected, and any without letters.
LIFT = 1.15


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that keep all quality rules. Null and blank texts go; columns keep their values whatever their names."""
    return quality.passed(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language can be told, learned from the labelled ones among them; all, if none is labelled. Null texts and texts without letters go; an empty table stays empty."""
    return language.accepted(docs, 5, LIFT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies: five-word shingles, Jaccard 0.8 or more. Null and blank texts are one group; columns keep their values whatever their names and types."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mixture takes, in the order of training."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of at most 2048. A null text is its end id alone; doc_id is cast to long; no documents, no pieces."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, window=2048)


STAGES = [("quality rules", quality_rules), ("language id", language_id), ("simhash near-dedup", near_dedup), ("mixing sources", mix_sources), ("packing", pack_sequences)]

#: Tokens, trained filters and fingerprint components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
