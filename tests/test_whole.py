"""Knowledge queries do the whole job, whatever the size."""

import random

import pytest

from lodestone.operators import knowledge as kn
from lodestone.plans import knowledge


def test_claims_read_the_whole_text(spark, tmp_path):
    rows = [(1, "a" * 3500 + " 12", "en", "s", 3503), (2, "b 34", "en", "s", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in knowledge.detect_conflicts(spark, str(tmp_path)).collect()] == [("s", 1, 2)]


def test_tidy_run_merges_all_close_pairs(spark):
    d = "/root/testdata/sf0.1"
    pairs = [(r["cosine"], r["a"], r["b"]) for r in knowledge._close_in_topic(spark, d).collect()]
    assert len(pairs) > 100
    assert [tuple(r) for r in knowledge.tidy_run(spark, d).collect()] == kn.greedy_merges(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_merges_of_random_pairs(spark, seed):
    draw = random.Random(seed)
    pairs = list({(a, b): (round(draw.random(), 1), a, b) for a, b in (sorted(draw.sample(range(25), 2)) for _ in range(120))}.values())
    got = kn.merged_greedily(spark.createDataFrame([(a, b, c) for c, a, b in pairs], "a long, b long, cosine double"))
    assert [tuple(r) for r in got.collect()] == kn.greedy_merges(pairs)
