"""The language model against plain versions: features, classes, normalisation and whole scores."""

import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import language_model as lm

TABLE = (np.arange(lm.KINDS) % lm.CLASSES).astype(np.uint16)


def test_features_reach_four_words_back():
    texts = [lm.tokens_of(b"the quick brown fox jumps over a lazy dog"), lm.tokens_of(b"one more")]
    line, keep = lm.line_of(texts)
    assert np.array_equal(line[keep], np.concatenate(texts))
    kind = TABLE[(line >> 5) & (lm.KINDS - 1)]
    own, _, rows = lm.features(line, TABLE, 4, len(line))
    assert len(rows) == len(lm.Weights.SHAPES) == 6
    at = np.arange(4, len(line))
    assert np.array_equal(rows[3], kind[at - 3] * lm.CLASSES + kind[at - 4])
    assert np.array_equal(rows[5], own * lm.CLASSES + kind[at - 2])


def test_both_tables_reach_the_scores():
    line, keep = lm.line_of([lm.tokens_of(b"a b c d e f g h " * 50)])
    w = lm.Weights.start(np.zeros(lm.CLASSES * lm.PLACES))
    lm.train(w, TABLE, line, keep, [np.zeros_like(t) for t in w.tables])
    own, _, rows = lm.features(line, TABLE, 4, len(line))
    before = lm.logits(w, own, rows)
    for f, which in ((3, 0), (5, 1)):
        held, w.tables[f] = w.tables[f], np.zeros_like(w.tables[f])
        assert not np.array_equal(lm.logits(w, own, rows)[which], before[which])
        w.tables[f] = held


def test_kinds_with_like_neighbours_share_a_class():
    rnd = np.random.default_rng(2)
    near = rnd.poisson(1, (lm.KINDS, lm.NEAR)).astype(float)
    near[:2000, :32] += 60
    near[2000:, 32:] += 60
    got = lm.classes_of(near, np.ones(lm.KINDS, np.int64))
    assert not set(got[:2000]) & set(got[2000:])
    assert np.array_equal(got, lm.classes_of(near, np.ones(lm.KINDS, np.int64)))
    assert set(lm.classes_of(np.zeros((lm.KINDS, lm.NEAR)), np.zeros(lm.KINDS, np.int64))) <= set(range(lm.CLASSES))


def plain_score(text: bytes, m: lm.Model, counts: dict[int, int]) -> float:
    """One text's score word by word, with softmaxes written out."""
    pad, total = lm.number(b"\r"), 0.0
    line = [pad] * 4 + [lm.number(w) for w in text.lower().split()] + [lm.number(b"\n")]
    kind = [int(m.table[x >> 5 & lm.KINDS - 1]) for x in line]
    for i in range(4, len(line)):
        rows = (line[i - 1] >> 17 & lm.ROWS - 1, line[i - 2] >> 17 & lm.ROWS - 1, kind[i - 1] * 32 + kind[i - 2], kind[i - 3] * 32 + kind[i - 4])
        a = [float(m.weights.class_bias[c]) + sum(float(m.weights.tables[f][r][c]) for f, r in enumerate(rows)) for c in range(lm.CLASSES)]
        k, place = kind[i], line[i] & lm.PLACES - 1
        b = [float(m.weights.place_bias[k][p]) + float(m.weights.tables[4][k * 32 + kind[i - 1]][p]) + float(m.weights.tables[5][k * 32 + kind[i - 2]][p]) for p in range(lm.PLACES)]
        for z, y in ((a, k), (b, place)):
            total += z[y] - math.log(sum(map(math.exp, z)))
        slot = k * lm.PLACES + place
        total += math.log((counts.get(line[i], 0) + 1) / (m.slot_tokens[slot] + m.slot_words[slot] + 1))
    return total / math.log(10)


def test_scores_are_the_plain_models_and_shares_sum_to_one(spark):
    texts = [f"the {w} of a {w}er cat {k % 7} and nothing else" for k, w in enumerate("alpha beta gamma delta epsilon zeta eta theta".split() * 12)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(500, "never seen words here"), (501, None), (502, "")], "doc_id long, text string")
    rows = lm.numbered(docs.select("doc_id", (F.col("doc_id") >= 500).alias("held_out"), "text"))
    m = lm.fit(rows.where("not held_out"))
    counts = {r["id"]: r["n"] for r in m.vocabulary.collect()}
    assert sum(counts.values()) == m.tokens and len(counts) == m.words
    got = {r["doc_id"]: r["score"] for r in lm.score(rows, m).collect()}
    for k in (0, 5, 50, 500, 501, 502):
        text = (texts[k] if k < 500 else "never seen words here" if k == 500 else "").encode()
        assert math.isclose(got[k], plain_score(text, m, counts), rel_tol=1e-4), k
    # A slot's words and its share for unseen ones together have probability 1; so have places and classes, being softmaxes.
    slot = {x: int(m.table[x >> 5 & lm.KINDS - 1]) * lm.PLACES + (x & lm.PLACES - 1) for x in counts}
    for s in set(slot.values()):
        seen = sum(counts[x] + 1 for x in counts if slot[x] == s)
        assert seen + 1 == m.slot_tokens[s] + m.slot_words[s] + 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(2, "a b"), (3, None)], "doc_id long, text string")
    rows = lm.numbered(docs.select("doc_id", F.lit(True).alias("held_out"), "text"))
    got = lm.score(rows, lm.fit(rows.where("not held_out"))).collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)


def test_changes_are_summed_in_levels(spark):
    """A thousand trainers' slices add up to their sum, and no task of a level takes more than its fan-in of parts."""
    rows = spark.range(2000).select((F.col("id") / 2).cast("long").alias("part"), (F.col("id") % 2).cast("int").alias("slice"), (F.col("id") + 1).alias("n"))
    x = spark.createDataFrame([(r["part"], r["slice"], r["n"], np.full(3, float(r["part"] + r["slice"])).tobytes()) for r in rows.collect()], "part long, slice int, n long, moved binary")
    got = {r["slice"]: (r["part"], r["n"], np.frombuffer(r["moved"]).tolist()) for r in lm.summed_in_levels(x, 1000, 10).collect()}
    whole = sum(range(1000))
    assert got == {0: (0, sum(range(1, 2000, 2)), [whole] * 3), 1: (0, sum(range(2, 2001, 2)), [whole + 1000.0] * 3)}
    assert str(lm.summed_in_levels(x, 1000, 10)._jdf.queryExecution().analyzed()).count("FlatMapGroupsInArrow") == 3  # 1000, 100, 10, 1
    assert lm.summed_in_levels(x.limit(0), 1, 10).collect() == []
