"""Table functions in SQL against the column functions, and JSON salvage."""

import pytest

from lodestone.functions import sql as sq
from lodestone.functions import text as tx
from lodestone.operators import ingest


def test_table_functions(spark):
    sq.register(spark)
    text = "pre 连接池x\n# One\nbody text\n--- page 2 ---\nend"
    df = spark.createDataFrame([(1, text)], "i int, t string")
    df.createOrReplaceTempView("texts")
    got = [r["term"] for r in spark.sql("SELECT term FROM texts, LATERAL fields(t)").collect()]
    assert got == df.select(tx.fields(df["t"]).alias("x")).first()["x"]
    spans = spark.sql("SELECT kind, label, start, `end` FROM texts, LATERAL structure_spans(t)").collect()
    assert sorted(map(tuple, spans)) == sorted((r["kind"], r["label"], r["start"], r["end"]) for r in ingest.structure_spans(df, "i", "t").collect())
    blocks = spark.sql("SELECT block_index, block_start, block_end, block FROM texts, LATERAL split_blocks(t, 20, 5)").collect()
    want = ingest.blocks(df, "i", "t", 20, 5).select("block_index", "block_start", "block_end", "block").collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, want))


@pytest.mark.parametrize("text,want", [("x {\"a\": 1} y", '{"a": 1}'), ("<think>{\"no\": 1}</think>{'a': [1,],}", '{"a": [1]}'), ("{broken {\"b\": \"}\"}", '{"b": "}"}'), ("none", None), (None, None)])
def test_salvage(text, want):
    assert sq.salvage(text) == want
