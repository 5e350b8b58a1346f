"""Session stacks on a stream with timers against their batch form."""

import os
import random

import pandas as pd
from pyspark.sql import functions as F

from lodestone.streaming import windows

SCHEMA = "session long, ts timestamp, doc_id long, weight double"


def test_stream_of_stacks_is_the_batch_form_and_its_state_ends(spark, tmp_path):
    draw = random.Random(11)
    start, rows = pd.Timestamp("2024-01-01", tz="UTC"), []
    for session in range(12):
        t = start + pd.Timedelta(minutes=draw.randrange(5))
        for _ in range(draw.randrange(1, 25)):
            t += pd.Timedelta(seconds=draw.choice([1, 60, 300, 1800, 1801]))
            rows.append((session, t, draw.randrange(6), draw.choice([0.3, 0.6, 1.0])))
    rows.sort(key=lambda r: (r[1], r[0]))
    rows.append((99, rows[-1][1] + pd.Timedelta(hours=2), 1, 1.0))
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(0, len(rows), 30):
        path = str(folder / f"{k:04}.parquet")
        spark.createDataFrame([(s, t.to_pydatetime(), d, w) for s, t, d, w in rows[k : k + 30]], SCHEMA).coalesce(1).toPandas().to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))

    got = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = windows.session_stacks(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    q = q.foreachBatch(lambda df, n: got.extend((n, *r) for r in df.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None

    last = {}
    for n, s, at, doc, _ in got:
        if doc is not None:
            last[s] = max(last.get(s, (0, 0)), (at, n))
    stacks = {(s, doc, round(w, 6)) for n, s, at, doc, w in got if doc is not None and (at, n) == last[s]}
    want = windows.session_evidence(spark.read.schema(SCHEMA).parquet(str(folder)), F.col("doc_id"))
    assert stacks == {(r["session"], r["doc_id"], r["weight"]) for r in want.collect()}
    ended = {s for _, s, at, doc, _ in got if doc is None and at == last[s][0]}
    assert ended == set(range(12))  # all but the session whose touch moved the watermark on
