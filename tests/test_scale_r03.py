"""Plans and results behind the findings of round 3: what grows with the tables must not cross the network whole."""

import random

from lodestone.operators import index as ix

DOCS = [(1, "the owl and the toad", "a"), (2, "an owl, an owl", "b"), (3, "toadstool", "c"), (4, None, "d")]
ASKED = [(7, ["owl", "toad", "an"]), (8, ["stool", "zz"])]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cascade_adds_up_where_a_document_lies(spark):
    """a row for each query, document and word must not be shuffled before it is added up."""
    docs = spark.createDataFrame([(k + 4 * i, *rest) for i in range(200) for k, *rest in DOCS], "doc_id long, body string, uri string")
    scores = ix.cascade(spark.createDataFrame(ASKED, "item_id long, tokens array<string>"), docs)
    assert "hashpartitioning(item_id" not in plan_of(scores)
    import math

    w = lambda df, tf: (1 + math.log2(4 / df)) * (1 + math.log2(tf + 1))
    want = {(7, 1): w(2, 1) + w(2, 1) + w(2, 1), (7, 2): w(2, 2) + w(2, 2), (7, 3): w(2, 1), (8, 3): w(1, 1)}
    assert {(r["item_id"], r["doc_id"]): r["score"] for r in scores.where("doc_id <= 4").collect()} == {k: round(v, 6) for k, v in want.items()}


def vectors(spark, n=300):
    import random

    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], None if k % 11 == 0 else k % 3) for k in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_threshold_counts_leave_the_pairs_where_they_are(spark):
    """one row for each threshold and pair of blocks; small blocks and tiles give the same counts as all pairs."""
    import numpy as np

    rows, v = vectors(spark)
    e, l = np.array([r[1] for r in rows], "float32").astype("float64"), [r[2] for r in rows]
    u = e / np.linalg.norm(e, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    pairs = [(s[a, b], l[a] is not None and l[a] == l[b]) for a in range(300) for b in range(a + 1, 300) if s[a, b] >= 0]
    for block in (40, 1024):
        got = {r["theta"]: (r["kept"], r["hits"], r["relevant"]) for r in ix.close_counts(v, [0.1, 0.5], block).collect()}
        assert got == {t: (sum(x >= t for x, _ in pairs), sum(x >= t and y for x, y in pairs), sum(y for _, y in pairs)) for t in (0.1, 0.5)}


def test_blocks_grow_with_the_vectors(spark, monkeypatch):
    """Beyond BLOCKS blocks the blocks grow instead of their number, and floats travel as floats."""
    rows, v = vectors(spark)
    whole = sorted(map(tuple, ix.close_pairs(v, 0.6).collect()))
    monkeypatch.setattr(ix, "BLOCKS", 4)
    monkeypatch.setattr(ix, "TILE", 16)
    assert ix._blocks(ix._plain(v), "i", 10, "n", 4)[1].first()[0] == 4
    assert sorted(map(tuple, ix.close_pairs(v, 0.6, block=10).collect())) == whole and len(whole) > 100
    assert ix._plain(v).schema["e"].dataType.simpleString() == "array<float>"


def test_term_counts_without_an_index(spark):
    """the counts of all terms equal those of the index, in one shuffle of texts and one of terms."""
    docs = spark.createDataFrame(DOCS + [(2, "an ox", "b")], "doc_id long, body string, uri string")
    from pyspark.sql import functions as F

    want = ix.Index(docs.where("uri <> 'b' or body = 'an ox'")).tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    assert sorted(map(tuple, ix.term_counts(docs.where("uri <> 'b' or body = 'an ox'")).collect())) == sorted(map(tuple, want.collect()))
    assert {r["term"]: (r["df"], r["cf"]) for r in ix.term_counts(docs).collect()}["an"] == (1, 3)


def test_runs_are_not_broadcast(spark):
    """texts' runs are many times their files' size, so the driver must not be given them to broadcast."""
    docs = spark.createDataFrame(DOCS, "doc_id long, body string, uri string")
    plan = plan_of(ix.substring_counts(docs, spark.createDataFrame([("owl",), ("toad",)], "term string")))
    assert any("SortMergeJoin" in line and "[run#" in line for line in plan.splitlines())


def test_vocabulary_is_counted_from_the_top(spark, monkeypatch):
    """only grams of frequent parts are counted where those suffice, with the rows of counting all."""
    import random

    from lodestone.operators import lexicon

    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, None if k % 37 == 5 else " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randrange(0, 60)))) for k in range(300)], "doc_id long, body string")
    asked, real = [], lexicon._frequent_grams
    monkeypatch.setattr(lexicon, "_frequent_grams", lambda w, sizes, least: asked.append(least) or real(w, sizes, least))
    got = [tuple(r) for r in lexicon.mine_vocabulary(docs, "doc_id", "body", (2, 3, 4), "[0-9a-z]+", 2, 30).collect()]
    assert min(asked) > 1
    grams, seen = {}, {}
    for k, body in docs.collect():
        w = (body or "").split()
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                grams[g] = grams.get(g, 0) + 1
                seen.setdefault(g, set()).add(k)
    live = {g: f for g, f in grams.items() if len(seen[g]) >= 2}
    most = {}
    for g, f in live.items():
        for part in (g[:-1], g[1:]):
            most[part] = max(most.get(part, 0), f)
    want = sorted(((" ".join(g), len(seen[g]), f) for g, f in live.items() if g not in most or most[g] < 8 * f // 10), key=lambda r: (-r[1], -r[2], r[0]))
    assert got == want[:30]
    everything = [tuple(r) for r in lexicon.mine_vocabulary(docs, "doc_id", "body", (2, 3, 4), "[0-9a-z]+", 2, 10**6).collect()]
    assert everything == want and min(asked) == 1


def test_budget_does_not_depend_on_the_order_of_rows(spark):
    """F8: windows that differ in their end alone are taken in one order, however the rows come."""
    from lodestone.operators import evidence
    from lodestone.plans.evidence import budget_order
    from pyspark.sql import functions as F

    rows = [(1, 5, "lex", 0, end, 8.4, "x" * end) for end in (300, 480, 420)] + [(1, 6, "lex", 40, 520, 8.0, "x" * 480)]
    schema = "item_id long, doc_id long, arm string, start int, end int, score double, content string"
    kept = lambda r: [x["end"] for x in evidence.within_budget(spark.createDataFrame(r, schema).coalesce(1), ["item_id"], budget_order(), F.octet_length("content"), 700).orderBy("end").collect()]
    assert kept(rows) == kept(rows[::-1]) == kept(rows[1:] + rows[:1]) == [300, 420]


def test_a_scan_ranks_as_the_index(spark, monkeypatch):
    """Only the asked terms are counted, nothing is sorted by term, and rows are the index's."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    words = [f"w{k}" for k in range(50)]
    docs = [(k, None if k % 40 == 7 else "" if k % 40 == 8 else " ".join(rng.choices(words, [1 / (i + 1) for i in range(50)], k=rng.randrange(1, 40)))) for k in range(300)]
    docs = spark.createDataFrame(docs, "doc_id long, body string")
    q = spark.createDataFrame([(k, rng.choices(words, k=rng.randrange(0, 6)) + ["nowhere"]) for k in range(20)], "item_id long, tokens array<string>")
    monkeypatch.setattr(ix, "SCORED", 16)
    index, scan = ix.Index(docs), ix.Scan(docs, q)
    assert scan.parts > 8 and tuple(scan.sizes.first()) == tuple(index.sizes.first())
    asked = {t for r in q.collect() for t in r["tokens"]}
    assert {r["term"] for r in scan.tf.select("term").distinct().collect()} == asked - {"nowhere"}
    for k in (1, 5):
        part = q.withColumn("tokens", F.slice("tokens", 1, k))
        assert sorted(map(tuple, scan.rank(part, k).select("item_id", "doc_id", "score", "rnk").collect())) == sorted(map(tuple, ix.top(index.scores(part), "item_id", [F.desc("score"), F.col("doc_id")], k).select("item_id", "doc_id", "score", "rnk").collect()))
    assert sorted(map(tuple, scan.gaps(q).collect())) == sorted(map(tuple, index.gaps(q).collect()))
    assert plan_of(scan.scores(q)).count("Exchange hashpartitioning") == 1  # by document, before the scores are added up


def test_ranking_queries_write_no_index(spark, monkeypatch):
    """A ranking that is asked once must not write and sort all postings."""
    from lodestone.plans import registry

    def no(*a, **k):
        raise AssertionError("an index of all terms was built")

    monkeypatch.setattr(ix.Index, "__init__", no)
    monkeypatch.setattr(ix, "stored", no)
    for name in ("vocab_gap", "narrow_semi", "mixed_affinity", "recall_at_k", "rerank_cosine", "admit_exclude_anti"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_pairs_of_members_by_blocks_and_by_joins(spark, monkeypatch):
    """large groups' pairs are counted where blocks meet, small groups' in as many tasks as they are many; rows are those of all pairs."""
    import random
    from collections import Counter
    from itertools import combinations

    from lodestone.operators import knowledge as kn

    rng = random.Random(6)
    rows = [(rng.randrange(12), rng.randrange(90)) for _ in range(900)] + [(None, 1), (2, None), (2, 5), (2, 5), (99, 7)]
    groups = {}
    for g, m in rows:
        if g is not None and m is not None:
            groups.setdefault(g, set()).add(m)
    want = Counter(p for g in groups.values() for p in combinations(sorted(g), 2))
    df = spark.createDataFrame(rows, "g long, m long")
    met, real = [], kn._pairs_by_blocks
    monkeypatch.setattr(kn, "_pairs_by_blocks", lambda r: met.append(1) or real(r))
    for blocks, counted in ((5, 7), (5, 1 << 22), (1, 50), (10**6, 1)):
        monkeypatch.setattr(kn, "BLOCKS", blocks)
        monkeypatch.setattr(kn, "COUNTED", counted)
        met.clear()
        got = {(r["a"], r["b"]): r["hits"] for r in kn.pair_edges(df, "g", "m").collect()}
        assert got == want and bool(met) == (blocks < 10**6)
    monkeypatch.setattr(kn, "ROWS", 16)
    assert kn.pair_edges(df, "g", "m").rdd.getNumPartitions() > 100  # as many tasks as there are pairs for
    assert kn.pair_edges(df.where("false"), "g", "m").collect() == []


def test_conflicts_of_a_large_group_are_dealt_out(spark, monkeypatch):
    """a group's pairs are made by several tasks, and each once."""
    from lodestone.operators import knowledge as kn

    rows = [(k, "g" if k % 5 else "h", str(k % 23) if k % 7 else "") for k in range(120)] + [(500, None, "3"), (501, None, "4"), (3, "h", "9"), (4, "h", "8")]
    monkeypatch.setattr(kn, "ROWS", 10)
    df = spark.createDataFrame(rows, "id long, grp string, claim string")
    least = {}
    for i, g, c in rows:
        if g is not None and c:
            least[g, c] = min(i, least.get((g, c), i))
    want = {(g, a, b) for (g, p), a in least.items() for (h, q), b in least.items() if g == h and a < b and p != q}
    got = kn.conflicts(df, "grp")
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.rdd.getNumPartitions() > 20
    both = [(r["a"], r["b"]) for r in kn.barriers(df, "grp").collect()]
    assert len(both) == len(set(both)) and set(both) == {p for _, a, b in want for p in ((a, b), (b, a))}
    assert kn.barriers(df.where("false"), "grp").collect() == []


def test_sequences_among_wanted_nodes(spark):
    """edges that no walk can take are left out before they are counted; the others keep their hits."""
    from lodestone.operators import knowledge as kn

    rows = [(o, k, (o * 7 + k * k) % 11) for o in range(60) for k in range(6)]
    df = spark.createDataFrame(rows, "o long, k long, node long")
    wanted = spark.createDataFrame([(k,) for k in (1, 2, 4, 7, 9)], "node long")
    every = {tuple(r) for r in kn.sequence_edges(df, "o", ["k"], "node").collect()}
    got = {tuple(r) for r in kn.sequence_edges(df, "o", ["k"], "node", wanted).collect()}
    assert got == {r for r in every if {r[0], r[1]} <= {1, 2, 4, 7, 9}} and 0 < len(got) < len(every)


def test_labels_are_compared_where_blocks_meet(spark):
    """Pairs are not shuffled to fetch their labels."""
    rows, v = vectors(spark)
    label = {r[0]: r[2] for r in rows}
    every = set(map(tuple, ix.close_pairs(v, 0.3).collect()))
    for kind in ("same", "other"):
        got = ix.close_pairs(v, 0.3, block=40, labels=kind)
        want = {r for r in every if None not in (label[r[0]], label[r[1]]) and (label[r[0]] == label[r[1]]) == (kind == "same")}
        assert set(map(tuple, got.collect())) == want and len(want) > 100


def test_merging_pairs_are_found_without_joining_all_pairs(spark, monkeypatch):
    """A round finds what merges among each loser's first pair; the pairs themselves stay three numbers."""
    from lodestone.operators import knowledge as kn

    rng = random.Random(3)
    pairs = [(rng.randrange(1, 100) / 100, *sorted(rng.sample(range(40), 2))) for _ in range(200)]
    pairs = sorted({(a, b): c for c, a, b in pairs}.items())
    seen, kept = [], kn.kept_table
    monkeypatch.setattr(kn, "kept_table", lambda df, name: seen.append((name, df.columns, df.inputFiles())) or kept(df, name))
    got = kn.merged_greedily(spark.createDataFrame([(a, b, c) for (a, b), c in pairs], "a long, b long, cosine double"))
    order = sorted(((c, a, b) for (a, b), c in pairs), key=lambda p: (-p[0], p[1], p[2]))
    assert [tuple(r) for r in got.collect()] == kn.greedy_merges(order)
    assert all(c == ["winner", "loser", "cosine"] for n, c, _ in seen if n == "merge-pairs")
    found = [f for n, _, f in seen if n == "merge-now"]
    assert found and not any("merge-pairs" in p for f in found for p in f)
