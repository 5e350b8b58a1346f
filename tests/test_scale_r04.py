"""Results and plans behind the findings of round 4."""

import random


def test_vocabulary_is_counted_whole(spark, monkeypatch):
    """one count of all grams, none left out by how often it occurs, with the rows of brute force."""
    from lodestone.operators import lexicon

    def cut(*_):
        raise AssertionError("counts frequent grams alone")

    monkeypatch.setattr(lexicon, "_frequent_grams", cut)
    monkeypatch.setattr(lexicon, "WORDS", 500)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = [(k % 280 if k % 50 else None, None if k % 37 == 5 else " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randrange(0, 60)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, body string").repartition(5)
    grams, seen = {}, {}
    for k, body in rows:
        w = (body or "").split()
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                grams[g] = grams.get(g, 0) + 1
                seen.setdefault(g, set()).update([] if k is None else [k])
    live = {g: f for g, f in grams.items() if len(seen[g]) >= 2}
    most = {}
    for g, f in live.items():
        for part in (g[:-1], g[1:]):
            most[part] = max(most.get(part, 0), f)
    want = sorted(((" ".join(g), len(seen[g]), f) for g, f in live.items() if g not in most or most[g] < 8 * f // 10), key=lambda r: (-r[1], -r[2], r[0]))
    for limit in (30, 10**6):
        assert [tuple(r) for r in lexicon.whole_vocabulary(docs, "doc_id", "body", (2, 3, 4), "[0-9a-z]+", 2, limit).collect()] == want[:limit]
    assert lexicon.whole_vocabulary(docs.limit(0), "doc_id", "body", (2, 3, 4), "[0-9a-z]+", 2, 30).isEmpty()


def test_the_query_counts_the_whole_vocabulary(spark, monkeypatch):
    """the query goes by the whole count."""
    from lodestone.operators import lexicon
    from lodestone.plans import registry

    def cut(*_, **__):
        raise AssertionError("stops at the first frequent grams")

    monkeypatch.setattr(lexicon, "mine_vocabulary", cut)
    assert registry.queries()["vocab_mine"](spark, "/root/testdata/sf0.001").count() == 200


def test_cascade_keeps_scores_in_their_tasks(spark, monkeypatch):
    """texts' runs are looked up where they are read, and only leading rows leave the blocks, with the rows of the plain sums."""
    import math

    from pyspark.sql import functions as F

    from lodestone.operators import index as ix

    def shuffled(*_):
        raise AssertionError("deals all runs of the texts")

    monkeypatch.setattr(ix, "substring_counts", shuffled)
    monkeypatch.setattr(ix, "CELLS", 64)
    monkeypatch.setattr(ix, "ASKED", 2)
    rng = random.Random(8)
    words = ["owl", "Toad", "toadstool", "an", "ananan", "中文", "é中文字", "stool.", "x"]
    rows = [(k % 90, None if k == 7 else " ".join(rng.choices(words, k=rng.randrange(6))), f"src{k % 90 % 3} owl") for k in range(100)]
    asked = [(1, ["owl", "toad", "an", "an"]), (2, ["stool", "zz"]), (3, ["中文"]), (4, []), (5, ["nan", "src1", "owl"])]
    c = ix.Cascade(spark.createDataFrame(asked, "item_id long, tokens array<string>"), spark.createDataFrame(rows, "doc_id long, body string, uri string"), F.col("uri"))
    terms = {t for _, ts in asked for t in ts}
    tf = [(k, t, (b or "").lower().count(t)) for k, b, _ in rows for t in terms if t in (b or "").lower()]
    df = {t: sum(x == t for _, x, _ in tf) for t in terms}
    want = {}
    for item, ts in asked:
        for k, t, n in tf:
            if t in ts:
                want[item, k] = want.get((item, k), 0.0) + (1 + math.log2(100 / df[t])) * (1 + math.log2(n + 1))
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in c.scores().collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    extra = {k: k % 7 / 10 for k in range(90)}
    lead = {(r["item_id"], r["doc_id"]) for r in c.leading(3, 0.4, named=0.2, extra=spark.createDataFrame(list(extra.items()), "doc_id long, extra double")).collect()}
    name = {k: f"src{k % 3} owl" for k in range(90)}
    for item, ts in asked:
        value = {k: 0.4 * s + extra[k] + 0.2 * sum(t in name[k] for t in ts) / len(ts) for (i, k), s in want.items() if i == item}
        assert {(item, k) for k in sorted(value, key=value.get)[-3:] if value[k] > sorted(value.values())[-4:][0] + 1e-5} <= lead
    best = {r["item_id"]: r["best"] for r in c.best().collect()}
    assert all(abs(best[i] - max(v for (j, _), v in want.items() if j == i)) < 2e-6 for i in best) and best.keys() == {i for i, _ in want}


def test_members_cross_the_network_for_few_blocks(spark, monkeypatch):
    """few members meet in few blocks, more in more, with the same pairs."""
    from lodestone.operators import knowledge as kn

    rows = spark.range(400).selectExpr("id % 2 as grp", "id div 2 as member")
    counted = {}
    for each in (1 << 20, 28):
        monkeypatch.setattr(kn, "BLOCK_MEMBERS", each)
        e = kn.pair_edges(rows, "grp", "member")
        counted[each] = e.rdd.getNumPartitions(), sorted(map(tuple, e.select("a", "b", "hits").collect()))
    want = [(a, b, 2) for a in range(200) for b in range(a + 1, 200)]
    assert counted[1 << 20] == (12 * 13 // 2, want) and counted[28] == (15 * 16 // 2, want)
