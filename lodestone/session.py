"""A Spark session with the settings that the engine is tuned for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, shuffle_partitions: int | None = None, **options: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow transfer; on a cluster, spark.checkpoint.dir names the shared folder."""
    b = SparkSession.builder.appName("lodestone")
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (settings | options).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without that setting only a local session has one, its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/lodestone-shared"
    return root.rstrip("/")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: its lineage ends there, and lost executors bring none of it back."""
    path = f"{shared_folder(df.sparkSession)}/lodestone/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
