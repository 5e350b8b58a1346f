"""Near copies by Jaccard against all pairs."""

import random

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from lodestone.llm import shingles


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """The ids left of (doc_id, text) when every pair of Jaccard 0.8 or more is linked."""
    own = {d: sets_of(t) for d, t in docs}
    ids = sorted(own)
    top = {d: d for d in ids}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    pairs = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = own[a], own[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) * 1.0 >= 0.8 * len(x | y):
                pairs.append((a, b))
                u, v = root(a), root(b)
                top[max(u, v)] = min(u, v)
    return sorted({root(d) for d in ids}), pairs


def test_near_dedup_stage_is_all_pairs(spark):
    draw = random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    base = [(d, t.split()) for d, t in docs if t and len(t.split()) >= 60][:30]
    for k, (_, words) in enumerate(base):
        for j in range(4):  # copies with one to three words changed, above and below the bound, and chains of copies
            words = list(words)
            for _ in range(1 + j % 3):
                words[draw.randrange(len(words))] = f"changed{draw.random()}"
            docs.append((1_000_000 + 10 * k + j, " ".join(words)))
    docs += [(2_000_000, None), (2_000_001, ""), (2_000_002, "a b"), (2_000_003, "A  b")]
    want, pairs = brute(docs)
    assert len(want) < len(docs) and len(pairs) > 60
    got = corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_lists_compare_what_the_root_leaves(spark):
    """Pairs of a list whose least member is far from both are found too."""
    words = [f"w{k}" for k in range(400)]
    docs = [(0, " ".join(words))]
    for k in range(12):
        docs.append((1 + k, " ".join(words[30 * (k % 3) :] + [f"x{j}" for j in range(30 * (k % 3))] + [f"end{k}"])))
    want, _ = brute(docs)
    got = shingles.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_sketches_tell_near_sets_from_far_ones():
    """Sets of Jaccard 0.8 lie within far(0.8) bits, whatever their size; sets of 0.4 seldom do."""
    draw = np.random.default_rng(5)

    def differing(k, own):
        """Bits between the sketches of two sets with a union of 10 k, of which each has own * k for itself."""
        x = draw.integers(0, 1 << 64, 10 * k, np.uint64)
        a, b = (shingles.sketch(shingles.minima(np.unique(s))) for s in (x[: (10 - own) * k], x[own * k :]))
        return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())

    assert shingles.far(0.8) == 45 and shingles.far(1.0) == 0
    for k in (1, 10, 100):
        assert max(differing(k, 1) for _ in range(400)) <= 45
    assert sum(differing(20, 3) <= 45 for _ in range(300)) < 30


def test_parities_are_no_further_apart_than_sets():
    """Parities never differ in more bins than the sets in shingles, and tell most pairs of Jaccard 2/3 from those at 0.8."""
    draw = np.random.default_rng(7)
    for n in (1, 30, 300, 1500):
        for own in (0, n // 9, n // 5):  # at most n // 9 of n for itself: Jaccard 0.8 or more
            x = draw.integers(0, 1 << 64, n + own, np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[own:])
            d = int(np.bitwise_count((shingles.parities(a) ^ shingles.parities(b)).view(np.uint64)).sum())
            assert d <= 2 * own and (own <= n // 9 or d > 2 / 9 * n)
    assert not shingles.parities(np.empty(0, np.uint64)).any()


def test_a_shared_passage_makes_few_pairs(spark, monkeypatch):
    """Of documents that share a long passage, only near pairs leave the lists, not the square of their number."""
    draw = random.Random(11)
    passage = [f"p{k}" for k in range(200)]
    docs = [(k, " ".join(passage + [f"own{k}x{j}" for j in range(50)])) for k in range(60)]
    docs += [(1000 + k, docs[7 * k][1] + f" end{draw.random()}") for k in range(8)]
    sent, near = [], shingles._near

    def counted(pairs, sets, least):
        pairs = shingles.staged(pairs, "counted")
        sent.append(pairs.count())
        return near(pairs, sets, least)

    monkeypatch.setattr(shingles, "_near", counted)
    got = shingles.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == brute(docs)[0] == list(range(60))
    assert len(sent) == 2 and sent[1] <= 8  # sketches alone leave over a thousand
