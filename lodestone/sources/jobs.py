"""Ingest that can be broken off anywhere and taken up again: batches of files, and a manifest that makes them count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files

_FILES = "path string, length long, modified long"


class Job:
    """Documents under a folder, ingested batch by batch into ``where`` (a shared folder).

    A file's fingerprint is its path, length and time of change. A batch first writes its rows, over what a broken run may
    have left in their place, and then its files' fingerprints; only batches with a manifest count, so each file's rows
    are there once, whenever the job was broken off. A file that changes is ingested anew, and its earlier rows no longer
    show. One job at a time may write to a folder.

    read(spark, paths) gives the rows of some files, with path among the columns; batch is the most files of one batch,
    whose names are all that comes to the driver.
    """

    def __init__(self, spark: SparkSession, where: str, read: Callable[[SparkSession, list[str]], DataFrame] = files.read_documents, batch: int = 10_000):
        self.spark, self.where, self.read, self.batch = spark, where.rstrip("/"), read, batch
        spark.createDataFrame([], _FILES).write.mode("ignore").parquet(f"{self.where}/manifest/batch=-1")

    def listed(self, source: str) -> DataFrame:
        """(path, length, modified) of the files under a folder, without reading them."""
        f = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
        return f.select("path", "length", F.unix_micros("modificationTime").alias("modified"))

    def manifest(self) -> DataFrame:
        """(path, length, modified, batch) of each ingested file, as it was last."""
        m = self.spark.read.schema(f"{_FILES}, batch int").parquet(f"{self.where}/manifest")
        return m.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("batch")))).where("_n = 1").drop("_n")

    def pending(self, source: str) -> DataFrame:
        """The listed files that are new or have changed."""
        return self.listed(source).join(self.manifest(), ["path", "length", "modified"], "left_anti")

    def gone(self, source: str) -> DataFrame:
        """(path) of ingested files that are no longer listed."""
        return self.manifest().join(self.listed(source), "path", "left_anti").select("path")

    def step(self, source: str) -> int:
        """Ingests the next batch, by path; the number of its files, 0 if nothing is pending."""
        todo = self.pending(source).orderBy("path").limit(self.batch).collect()
        if todo:
            number = self.spark.read.schema(f"{_FILES}, batch int").parquet(f"{self.where}/manifest").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] + 1
            self.read(self.spark, [r["path"] for r in todo]).write.mode("overwrite").parquet(f"{self.where}/rows/batch={number}")
            self.commit(number, todo)
        return len(todo)

    def commit(self, number: int, done: list) -> None:
        """From here on the batch counts."""
        self.spark.createDataFrame([tuple(r) for r in done], _FILES).coalesce(1).write.mode("overwrite").parquet(f"{self.where}/manifest/batch={number}")

    def run(self, source: str, most: int | None = None) -> int:
        """Steps until nothing is pending, or ``most`` of them; the number of files."""
        total = n = 0
        while (most is None or n < most) and (k := self.step(source)):
            total, n = total + k, n + 1
        return total

    def rows(self) -> DataFrame:
        """The rows of all ingested files, each file's latest alone."""
        last = self.manifest().select("path", "batch")
        return self.spark.read.option("basePath", f"{self.where}/rows").parquet(f"{self.where}/rows").join(last, ["path", "batch"]).drop("batch")
