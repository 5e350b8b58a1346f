"""Telemetry as a stream and as a batch: the same windows, exact ranks, and late rows counted."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.streaming import telemetry as tm

SCHEMA = "ts timestamp, mode string, model string, namespace string, reused boolean, failed boolean, latency long, tokens long"
T0 = datetime(2024, 1, 1)


def calls(n, seed, hours):
    rng = random.Random(seed)
    return [(T0 + timedelta(seconds=rng.randrange(hours[0] * 3600, hours[1] * 3600)), rng.choice(["fast", "deep", None]), rng.choice("ab"), rng.choice("xyz"), rng.choice([True, False, None]), rng.random() < 0.2, rng.choice([None, *range(8)]), rng.randrange(50)) for _ in range(n)]


def plainly(rows):
    groups = defaultdict(list)
    for r in rows:
        start = r[0].replace(minute=0, second=0)
        for scope, name in (("all", ""), ("mode", r[1] or ""), ("model", r[2]), ("namespace", r[3])):
            groups[start, scope, name].append(r)
    rank = lambda x, a, b: sorted(x)[len(x) * a // b] if x else None
    out = {}
    for k, g in groups.items():
        lat = lambda ok: [r[6] for r in g if r[6] is not None and ok(r)]
        well = lat(lambda r: not r[5])
        reused = sum(bool(r[4]) for r in g)
        out[k] = (len(g), reused, sum(r[5] for r in g), sum(r[7] for r in g), round(reused / len(g), 6), rank(lat(lambda r: r[4]), 1, 2), rank(lat(lambda r: not r[4] and not r[5]), 1, 2), rank(well, 1, 2), rank(well, 9, 10))
    return out


def shown(df):
    names = ("queries", "reused", "failed", "tokens", "reuse_rate", "warm_p50", "cold_p50", "p50", "p90")
    return {(r["start"], r["scope"], r["name"]): tuple(r[n] for n in names) for r in df.collect()}


def test_batch_snapshot(spark):
    rows = calls(400, 1, (0, 4))
    assert shown(tm.snapshot(tm.counts(spark.createDataFrame(rows, SCHEMA)))) == plainly(rows)
    assert shown(tm.snapshot(tm.counts(spark.createDataFrame([], SCHEMA)))) == {}


def test_counts_of_parts_add_up(spark):
    rows = calls(200, 2, (0, 2))
    parts = tm.counts(spark.createDataFrame(rows[:90], SCHEMA)).unionByName(tm.counts(spark.createDataFrame(rows[90:], SCHEMA)))
    assert shown(tm.snapshot(parts)) == plainly(rows)


def test_stream_equals_batch_and_counts_late_rows(spark, tmp_path):
    """Three files in turn; in the third, rows of the first hours come after their windows have closed."""
    early, later, last = calls(120, 3, (0, 2)), calls(120, 4, (2, 6)), calls(50, 5, (9, 10))
    late = calls(30, 6, (0, 1))
    (tmp_path / "in").mkdir()
    got, dropped = [], 0
    for part in (early, later, [*late, *last], [(T0 + timedelta(hours=30), "fast", "a", "x", False, False, 1, 1)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = tm.counts(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "1 hour", "1 hour")
        q = stream.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += tm.dropped_late(q)
    counted = spark.createDataFrame(got, tm.counts(spark.createDataFrame([], SCHEMA)).schema)
    assert shown(tm.snapshot(counted)) == plainly([*early, *later, *last])
    assert dropped > 0 and counted.agg(F.sum("n")).first()[0] == 290
