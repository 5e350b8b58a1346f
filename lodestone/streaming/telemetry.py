"""Telemetry of searches: counts of values as mergeable state, and exact percentiles read from them.

A call has ts, mode, model, namespace, reused, failed, latency and tokens. A stream's state holds how often each latency
occurred in a window of event time; rows later than the watermark are dropped and counted by the engine. Percentiles of
any grouping come from the counts, so parts of a window, or windows, can be added up and still give the exact rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a snapshot is broken down by, each for itself.
SCOPES = ("all", "mode", "model", "namespace")


def counts(calls: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, mode, model, namespace, reused, failed, latency, n, tokens): how often each latency occurred in each window.

    late: how long a stream waits for rows of a window; a batch has all of them. A null mode, model or namespace is empty,
    null flags are no, null tokens 0; a null latency is a call without one. Null times are in no window.
    """
    c = calls.withWatermark("ts", late) if late else calls
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k)
    flag = lambda k: F.coalesce(F.col(k), F.lit(False)).alias(k)
    c = c.where(F.col("ts").isNotNull()).select("ts", text("mode"), text("model"), text("namespace"), flag("reused"), flag("failed"), F.col("latency").cast("long").alias("latency"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))
    g = c.groupBy(F.window("ts", size).alias("w"), "mode", "model", "namespace", "reused", "failed", "latency").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return g.select(F.col("w.start").alias("start"), "mode", "model", "namespace", "reused", "failed", "latency", "n", "tokens")


def at_rank(counted: DataFrame, keys: list[str], which: Column, numerator: int, denominator: int, name: str) -> DataFrame:
    """(keys, name): the latency at place n * numerator // denominator of the sorted ones, among the counted rows that ``which`` holds for; keys without any are left out."""
    c = counted.where(which & F.col("latency").isNotNull()).groupBy(*keys, "latency").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys)
    c = c.withColumns({"to": F.sum("n").over(w.orderBy("latency")), "whole": F.sum("n").over(w)})
    at = F.floor(F.col("whole") * numerator / denominator)
    return c.where((F.col("to") > at) & (F.col("to") - F.col("n") <= at)).select(*keys, F.col("latency").alias(name))


def snapshot(counted: DataFrame) -> DataFrame:
    """counts() as a row for each window, scope and name: queries, reused, failed, tokens, reuse_rate, warm_p50, cold_p50, p50, p90.

    warm are reused answers, cold those searched for that didn't fail; p50 and p90 are of all that didn't fail. A
    percentile without calls is null. The scope "all" has the empty name.
    """
    scopes = F.array(*[F.struct(F.lit(s).alias("scope"), (F.lit("") if s == "all" else F.col(s)).alias("name")) for s in SCOPES])
    rows = counted.withColumn("x", F.explode(scopes)).select("start", "x.scope", "x.name", "reused", "failed", "latency", "n", "tokens")
    keys = ["start", "scope", "name"]
    of = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    out = rows.groupBy(*keys).agg(F.sum("n").alias("queries"), of(F.col("reused")).alias("reused"), of(F.col("failed")).alias("failed"), F.sum("tokens").alias("tokens"))
    out = out.withColumn("reuse_rate", F.round(F.col("reused") / F.col("queries"), 6))
    warm, well = F.col("reused"), ~F.col("failed")
    for name, which, a, b in (("warm_p50", warm, 1, 2), ("cold_p50", ~warm & well, 1, 2), ("p50", well, 1, 2), ("p90", well, 9, 10)):
        out = out.join(at_rank(rows, keys, which, a, b, name), keys, "left")
    return out


def dropped_late(query) -> int:
    """How many rows a streaming query has dropped because they came later than its watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
