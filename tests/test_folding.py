"""Folding and saving against plain loops, and literal cases of each rule."""

import json
import random

import numpy as np
import pytest

from lodestone.operators import folding, saving

CLUSTER = "id long, created long, topic string, aliases array<string>, name string, content string, queries array<string>, level_keys array<struct<level: string, key: string>>, evidence array<struct<source: string, start: int, end: int, content: string>>, confidence double, hotness double, lifecycle string, flags array<string>, version int"


def cluster(id_, topic="t", content="", queries=(), keys=(), evidence=(), created=None, name="", aliases=(), conf=0.5, hot=0.5, life="emerging", flags=()):
    return (id_, id_ if created is None else created, topic, list(aliases), name, content, list(queries), [("scenario", k) for k in keys], list(evidence), conf, hot, life, list(flags), 1)


def verdicts(spark, clusters, pairs, k=3):
    got = folding.accepted(spark.createDataFrame(pairs, "winner long, loser long"), spark.createDataFrame(clusters, CLUSTER), k).collect()
    assert all(r["accepted"] == (r["reason"] == "") for r in got)
    return {(r["winner"], r["loser"]): r["reason"] for r in got}


def test_each_reason(spark):
    c = [
        cluster(1, "a", "the limit is 128", ["limit"]), cluster(2, "b", "the limit is 256", ["limit"]), cluster(3, "a", "the limit is 256", ["limit"]),
        cluster(11, "w", "only red here", ["red"]), cluster(12, "l", "", ["red fox"]), *(cluster(k, "o", "a red fox", []) for k in (13, 14, 15)),
        cluster(21, "w2", "", ["blue owl", "green"]), cluster(22, "l2", "", ["blue green"]), cluster(23, "o2", "", ["blue green"]),
        cluster(31, "x", "", []), cluster(32, "y", "", []),
    ]
    got = verdicts(spark, c, [(1, 2), (1, 3), (11, 12), (21, 22), (31, 32), (23, 22)])
    assert got == {(1, 2): "claims", (1, 3): "", (11, 12): "specificity", (21, 22): "separation", (31, 32): "", (23, 22): ""}


def plain_verdict(c, w, l, k):
    import re

    field = lambda t: re.findall(r"[0-9a-z]{2,}", t.lower())
    rel = lambda key, text: sum(t in text.lower() for t in field(key)) / len(field(key)) if field(key) else 0.0
    claim = lambda x: next((m[0] for m in (re.search("[0-9]+", t) for t in [*(e[3] for e in x[8]), x[5]]) if m), "")
    keys = lambda x: [t for t in dict.fromkeys([*x[6], *(y[1] for y in x[7])]) if t]
    surface = lambda x: " ".join([x[5], x[4], " ".join(x[6]), x[2], " ".join(x[3]), *(y[1] for y in x[7])])
    if c[w][2] != c[l][2] and claim(c[w]) and claim(c[l]) and claim(c[w]) != claim(c[l]):
        return "claims"
    others = [x for i, x in c.items() if i not in (w, l)]
    for key in keys(c[l]):
        own = rel(key, surface(c[w]))
        if sum(rel(key, surface(x)) > own or rel(key, surface(x)) == own and x[0] < w for x in others) >= k:
            return "specificity"
        best = max((rel(key, t) for t in [c[w][2], *c[w][3], *keys(c[w])]), default=0)
        if any(rel(key, t) > best for x in others for t in [x[2], *x[3], *keys(x)]):
            return "separation"
    return ""


def test_verdicts_of_random_clusters(spark):
    rng = random.Random(3)
    word = lambda n: " ".join(rng.choices(["red", "fox", "hen", "owl", "blue", "sea", "redfox", "77", "78", "a"], k=n))
    c = [cluster(k, rng.choice("tuv") * 3, word(9), [word(rng.randrange(0, 4)) for _ in range(2)], [word(2)], [("s", 0, 1, word(2))], aliases=[word(1)]) for k in range(9)]
    by = {x[0]: x for x in c}
    pairs = [(a, b) for a in range(9) for b in range(9) if a != b]
    for k in (1, 3):
        got = verdicts(spark, c, pairs, k)
        assert got == {p: plain_verdict(by, *p, k) for p in pairs}
    assert len(set(got.values())) == 4


def test_fold_of_everything(spark):
    w = cluster(1, "ta", "mine [1]", ["q1", "q2", "q3"], ["k1"], [("d1", 0, 5, "aaaaa")], conf=0.8, hot=0.6, aliases=["x"], flags=["f"])
    l = cluster(2, "tb", "theirs [1], [2] and [7]", ["q3", "q4", "q5", "q6"], ["k1", "k2"], [("d2", 1, 3, "bb"), ("d1", 0, 5, "aaaaa")], conf=0.4, hot=0.9, aliases=["x", "y", "ta"], flags=["g"])
    rest = cluster(3)
    got = {r["id"]: r for r in folding.fold(spark.createDataFrame([w, l, rest], CLUSTER), spark.createDataFrame([(1, 2)], "winner long, loser long")).collect()}
    assert set(got) == {1, 3} and tuple(got[3])[:3] == (3, 3, "t")
    r = got[1]
    assert (round(r["confidence"], 9), r["hotness"], r["version"], r["topic"], r["aliases"]) == (0.6, 0.9, 2, "ta", ["x", "tb", "y"])
    assert r["queries"] == ["q2", "q3", "q4", "q5", "q6"] and [k["key"] for k in r["level_keys"]] == ["k1", "k2"]
    assert [tuple(e) for e in r["evidence"]] == [("d1", 0, 5, "aaaaa"), ("d2", 1, 3, "bb")]
    assert r["content"] == "mine [1]\n---\ntheirs [2], [1] and [7]" and sorted(r["flags"]) == ["f", "g"]


def tidied_plainly(clusters, vector, theta, together, most=None):
    """One pair after the other, the best first; a winner's vector is the mean of its last five queries' vectors."""
    cos = lambda x, y: round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6)
    live = {c[0]: (c[1], list(c[6])) for c in clusters if c[11] not in ("contested", "deprecated")}
    vec = {i: np.mean([vector[q] for q in live[i][1]], axis=0) for i in live}
    out = []
    while most is None or len(out) < most:
        best = None
        for a in live:
            for b in live:
                if (live[a][0], a) < (live[b][0], b) and (s := cos(vec[a], vec[b])) >= theta:
                    rank = (-round(s + 0.05 * together.get(frozenset((a, b)), 0), 9), -s, a, b)
                    best = min(best or rank, rank)
        if best is None:
            return out
        _, s, w, l = best
        out.append((w, l, -s))
        live[w] = (live[w][0], [*live[w][1], *(q for q in live[l][1] if q not in live[w][1])][-5:])
        vec[w] = np.mean([vector[q] for q in live[w][1]], axis=0)
        del live[l]
    return out


@pytest.mark.parametrize("seed", [4])
def test_tidy_is_one_fold_after_the_other(spark, seed):
    rng = np.random.default_rng(seed)
    n = 24
    vector = {f"q{k}": rng.normal(size=4) for k in range(n)}
    c = [cluster(k, queries=[f"q{k}"], created=int(rng.integers(5)), life="contested" if k == 3 else "deprecated" if k == 7 else "stable") for k in range(n)]
    together = {frozenset((a, b)): 1.0 for a, b in rng.integers(0, n, (20, 2)).tolist() if a != b}
    rows = spark.createDataFrame([(*x, vector[x[6][0]].tolist()) for x in c], CLUSTER + ", vector array<double>")
    known = spark.createDataFrame([(q, v.tolist()) for q, v in vector.items()], "text string, vector array<double>")
    t = spark.createDataFrame([(*sorted(p), w) for p, w in together.items()], "a long, b long, weight double")
    want = tidied_plainly(c, vector, 0.8, together)
    assert len(want) > 5
    after, decided = folding.tidy(rows, lambda texts: texts.join(known, "text"), 0.8, together=t, check=False)
    got = decided.collect()
    assert sorted((r["winner"], r["loser"], round(r["sim"], 5)) for r in got) == sorted((w, l, round(s, 5)) for w, l, s in want)
    assert {r["id"] for r in after.collect()} == set(range(n)) - {l for _, l, _ in want}
    assert max(r["round"] for r in got) < len(want)


def test_tidy_folds_groups_side_by_side(spark, monkeypatch):
    """As one at a time, also where a fold's vector comes close to another group; the tables written don't grow with the rounds of best pairs."""
    rng = np.random.default_rng(5)
    n = 60
    vector = {f"q{k}": rng.normal(size=8) for k in range(n)}
    c = [cluster(k, queries=[f"q{k}"], created=int(rng.integers(5))) for k in range(n)]
    rows = spark.createDataFrame([(*x, vector[x[6][0]].tolist()) for x in c], CLUSTER + ", vector array<double>")
    known = spark.createDataFrame([(q, v.tolist()) for q, v in vector.items()], "text string, vector array<double>")
    want = tidied_plainly(c, vector, 0.7, {})
    names, kept = [], folding.kept_table
    monkeypatch.setattr(folding, "kept_table", lambda df, name: names.append(name) or kept(df, name))
    after, decided = folding.tidy(rows, lambda texts: texts.join(known, "text"), 0.7, check=False)
    got = decided.collect()
    assert sorted((r["winner"], r["loser"], round(r["sim"], 5)) for r in got) == sorted((w, l, round(s, 5)) for w, l, s in want)
    left = {r["id"]: r for r in after.collect()}
    assert set(left) == set(range(n)) - {l for _, l, _ in want}
    for r in left.values():
        assert np.allclose(r["vector"], np.mean([vector[q] for q in r["queries"]], axis=0)) and r["version"] == 1 + sum(w == r["id"] for w, _, _ in want)
    assert names.count("tidy-made") >= 2 and "tidy-batch" not in names  # groups met; no rounds over all pairs


def test_tidy_refuses_and_stops(spark):
    """A refused pair stays apart for good; most bounds the folds."""
    v = [1.0, 0.0]
    c = [cluster(1, "a", "the limit is 128", ["limit one"]), cluster(2, "b", "the limit is 256", ["limit two"]), cluster(3, "a", "the limit is 128", ["limit three"])]
    rows = spark.createDataFrame([(*x, v) for x in c], CLUSTER + ", vector array<double>")
    after, decided = folding.tidy(rows, None, 0.9)
    got = {(r["winner"], r["loser"]): r["reason"] for r in decided.collect()}
    assert got[1, 2] == "claims" and got[1, 3] == "" and {r["id"] for r in after.collect()} == {1, 2}
    _, decided = folding.tidy(rows, None, 0.9, most=1, check=False)
    assert [(r["winner"], r["loser"]) for r in decided.collect()] == [(1, 2)]


ANSWER = "answer_id string, at long, query string, summary string, source string, confidence double, refused boolean, replace boolean, evidence array<struct<source: string, start: int, end: int, content: string>>"
DOCS = [("d1", "the red fox and the red hen"), ("d2", "a red fox again")]
ANSWERS = [
    ("a1", 1, "red fox", "one [1]", "d1", 0.8, False, False, [("d1", 4, 11, "red fox")]),
    ("a2", 2, "fox red", "two [1] and [2]", "d2", 0.4, None, None, [("full", 2, 9, "red fox"), ("d1", 4, 11, "red fox")]),
    ("a3", 3, "red fox", "three", "d1", 0.9, False, False, [("d1", 0, 7, "old red fox")]),
    ("a4", 4, "red fox", "four", "d1", 0.7, False, False, [("d1", 4, 11, "red fox")]),
    ("a5", 5, "red fox", "five", "d1", 0.1, False, True, [("d1", 4, 11, "red fox")]),
    ("a6", 6, "red fox", "no", "d1", 0.1, True, False, []),
    ("a7", 7, "red fox", "nothing of it", "d1", 0.1, False, False, [("d1", 0, 3, "the")]),
    ("a8", 8, "red fox", "red fox", None, 0.1, False, False, None),
    ("b1", 1, "red owl", "red owl", "d9", 0.5, False, False, [("d9", 0, 7, "red owl")]),
    ("c1", 1, None, None, "d1", None, False, False, []),
]
ROUTES = {"a1": ("new", 1, 0.8, 1), "a2": ("merge", 2, 0.6, 2), "a3": ("merge", 3, 0.75, 3), "a4": ("replace", 4, 0.7, 1), "a5": ("replace", 5, 0.1, 1), "a6": ("refuse", 5, 0.1, 1), "a7": ("refuse", 5, 0.1, 1), "a8": ("refuse", 5, 0.1, 1), "b1": ("new", 1, 0.5, 1), "c1": ("refuse", 0, 0.0, 0)}


def routes(rows):
    return {r["answer_id"]: (r["route"], r["version"], round(r["confidence"], 9), r["n_evidence"]) for r in rows if r["kind"] == "answer"}


def test_saving_in_a_batch_and_in_a_stream(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "source string, body string")
    ready = saving.admitted(spark.createDataFrame(ANSWERS, ANSWER), docs)
    got = saving.saved(ready).collect()
    assert routes(got) == ROUTES
    clusters = {r["queries"][0]: r for r in got if r["kind"] == "cluster"}
    assert set(clusters) == {"red fox", "red owl"} and clusters["red fox"]["content"] == "five" and clusters["red fox"]["queries"] == ["red fox", "fox red"]
    assert saving.saved(saving.admitted(spark.createDataFrame([], ANSWER), docs)).collect() == []

    for k, part in enumerate((ANSWERS[:2] + ANSWERS[8:], ANSWERS[2:5], ANSWERS[5:8])):  # three batches
        saving.admitted(spark.createDataFrame(part, ANSWER), docs).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    (tmp_path / "now").mkdir()
    out = []
    for k in range(3):
        stream = spark.readStream.schema(ready.schema).parquet(f"{tmp_path}/now")
        spark.read.parquet(f"{tmp_path}/in/{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/now")
        q = saving.saved_stream(stream).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/at").foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("append").start()
        q.awaitTermination()
    assert routes(out) == ROUTES


def test_merged_content_renumbers_citations():
    c = saving.fresh()
    a = {"query": "q one", "stripped": "q one", "tokens": ["one"], "summary": "x [1]", "confidence": 0.5, "refused": False, "replace": False, "windows": json.dumps([{"source": "d", "start": 0, "end": 1, "content": "one", "pinned": True}])}
    assert saving.save(c, a) == "new"
    b = {**a, "query": "two one", "stripped": "two one", "summary": "y [2] and [1] and [9]", "windows": json.dumps([{"source": "e", "start": 0, "end": 1, "content": "b", "pinned": True}, {"source": "d", "start": 0, "end": 1, "content": "one", "pinned": True}])}
    assert saving.save(c, b) == "merge" and c["content"] == "x [1]\n---\ny [1] and [2] and [9]" and c["confidence"] == 0.5
    far = {**a, "query": "else", "stripped": "else", "tokens": ["else", "where"]}
    assert saving.save(c, far) == "evolve" and c["queries"] == ["q one", "two one", "else"] and c["version"] == 3
