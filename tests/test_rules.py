"""Rules of text and evidence by literal cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evidence as ev
from lodestone.operators import index as ix
from lodestone.operators import ingest, lexicon


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("query,parts", [
    ("甲甲和乙和丙丙", ["甲甲", "乙和丙丙"]),
    ("甲和乙乙和丙丙", ["甲和乙乙和丙丙"]),
    ("试用期多久以及工资多少", ["试用期多久", "工资多少"]),
    ("参与违法怎么办", ["参与违法怎么办"]),
    ("cats and dogs OR birds; fish vs ants", ["cats", "dogs", "birds", "fish"]),
    (" and ", [" and "]),
    ("；;；", ["；;；"]),
    ("a;b", ["a", "b"]),
    ("", [""]),
])
def test_decompose(spark, query, parts):
    assert one(spark, query, ev.decompose) == parts


@pytest.mark.parametrize("raw,text", [("a　　b", "a b"), (" a\x00 \t b\r\nc\r d \n", "a b\nc\n d"), ("x\n \ny", "x\n \ny"), ("　", "")])
def test_normalize(spark, raw, text):
    assert one(spark, raw, tx.normalize) == text


@pytest.mark.parametrize("html,text", [
    ("<p>it&#x27;s</p><blockquote>a</blockquote>b<table><tr><td>c</td></tr></table>d", "it's\na\nbc\n\nd"),
    ("<script src='x'>1</script >2<style>3</style\n>4", "2 4"),
    ("a&mdash;b &amp;lt; c", "a&mdash;b &lt; c"),
    ("<!-- x\n -->　y<br/>z", "y\nz"),
])
def test_extract_html(spark, html, text):
    assert one(spark, html, tx.extract_html) == text


def answers(spark, body, query):
    docs = spark.createDataFrame([(1, body), (2, "other words of no use")], "doc_id long, body string")
    q = spark.createDataFrame([(7, query)], "item_id long, query string").withColumn("tokens", tx.fields(F.col("query")))
    return [r for r in ev.fast_answer(q, docs, ix.Index(docs)).collect() if r["doc_id"] == 1]


def test_an_answer_behind_the_budget_is_found(spark):
    body = "filler text " * 1334 + "the capital harbour quota equals ninety" + " more filler" * 2000
    (r,) = answers(spark, body, "capital harbour quota equals ninety")
    assert r["end"] - r["start"] == 15_000 and r["start"] <= 16_008 < r["end"] and r["coverage"] == 1.0


def test_texts_beyond_the_whole_file_bound_are_sampled(spark):
    body = "filler text " * 9000 + "capital harbour quota equals ninety" + " more filler" * 400
    assert len(body) > ev.WHOLE
    found = answers(spark, body, "capital harbour quota equals ninety")
    assert found and found == answers(spark, body, "capital harbour quota equals ninety")
    assert any(r["start"] <= 108_000 < r["end"] and r["coverage"] == 1.0 for r in found) and all(r["end"] - r["start"] <= ev.WINDOW for r in found)
    assert len({r["start"] for r in found}) == len(found)


def _struct(spark, column):
    return tuple(spark.range(1).select(column.alias("x")).first()["x"])


def _arms(lex, local, rest):
    return F.struct(F.lit(lex).alias("lex"), F.lit(local).alias("local"), F.lit(rest).alias("global"))


def test_arms_slots_follow_their_weights(spark):
    budget = lambda w, *a: _struct(spark, ev.arm_budget(_arms(*w), *a))
    assert budget((0.2, 0.3, 0.5)) == (1, 2, 2)
    assert budget((1 / 3, 1 / 3, 1 / 3)) == (2, 2, 1)  # ties: lex, local, global
    assert budget((0.2, 0.3, 0.5), 2) == (1, 1, 1)  # never under one each
    assert budget((0.2, 0.3, 0.5), 4) == (1, 1, 2)
    assert budget((0.5, 0.4, 0.1), 5, 1.5) == (1, 2, 2)  # half of what can move, from the fuller arm
    assert budget((0.5, 0.4, 0.1), 5, 2.0) == (1, 1, 3)
    assert budget((0.5, 0.1, 0.4), 5, 9.0) == (1, 1, 3)


def test_arms_learn_from_what_they_find(spark):
    learned = lambda w, g: tuple(round(x, 6) for x in _struct(spark, ev.arm_learned(_arms(*w), _arms(*g))))
    even = (1 / 3, 1 / 3, 1 / 3)
    assert learned(even, (0, 0, 0)) == (0.333333, 0.333333, 0.333333)
    assert learned(even, (0, 0, 2)) == (0.166667, 0.166667, 0.666667)
    assert learned((0.2, 0.3, 0.5), (1, 3, 0)) == (0.225, 0.525, 0.25)


def test_substring_counts(spark):
    docs = spark.createDataFrame([(1, "The thEthe cat. aaaa 中文中文字"), (2, ""), (3, "scatter cat's")], "doc_id long, body string")
    terms = spark.createDataFrame([(t,) for t in ("the", "cat", "aa", "中文", "scatter", "none")], "term string")
    got = {(r["doc_id"], r["term"]): r["tf"] for r in ix.substring_counts(docs, terms).collect()}
    assert got == {(1, "the"): 3, (1, "cat"): 1, (1, "aa"): 2, (1, "中文"): 2, (3, "cat"): 2, (3, "scatter"): 1}


def test_overlay_numbers_every_row(spark):
    rows = spark.createDataFrame([(k,) for k in range(500, 0, -1)], "doc_id long")
    ranks = spark.createDataFrame([(k, r) for r, k in enumerate((400, 3, 77, 77, 999))], "doc_id long, rank int")
    got = [r["doc_id"] for r in ingest.overlay(rows, ranks, "doc_id", ["doc_id"]).orderBy("place").collect()]
    assert got == [400, 3, 77] + [k for k in range(1, 501) if k not in (400, 3, 77)]


def test_dissimilar_is_the_plain_loop(spark):
    texts = ["a b c", "a b d", "x y", "", "x y z", "中文 字", "中文 子"]
    got = spark.createDataFrame([(texts,)], "t array<string>").select(lexicon.dissimilar(F.col("t")).alias("x")).first()["x"]
    assert got == lexicon.keep_dissimilar(texts, [])


def mined_plainly(texts, longest, least_df):
    import re
    from collections import Counter

    freq, df = Counter(), Counter()
    for t in texts:
        own = [r[a : a + n] for r in re.findall("[\u4e00-\u9fff]+", t or "") for a in range(len(r)) for n in range(2, longest + 1) if a + n <= len(r)]
        freq.update(own)
        df.update(set(own))
    best = Counter()
    for g, n in freq.items():
        if len(g) > 2:
            for part in (g[1:], g[:-1]):
                best[part] = max(best[part], n)
    return sorted(((g, d, freq[g]) for g, d in df.items() if d >= least_df and not (best[g] and best[g] >= 8 * freq[g] // 10)), key=lambda r: (-r[1], -r[2], r[0]))


def test_han_terms(spark):
    """Pieces of two to six characters; what nearly always stands inside a longer piece goes."""
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choices(["连接池", "连接", "最大", "大小", "池", "是", "abc ", "，"], k=rng.randrange(0, 25))) for _ in range(40)] + [None, "", "连接池最大大小", "a连b接c", "连接池连接池连接池连接池"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string")
    for longest, least in ((6, 2), (3, 1), (2, 3)):
        got = [tuple(r) for r in lexicon.mine_han(docs, "doc_id", "body", longest, least, 10_000).collect()]
        assert got == mined_plainly(texts, longest, least)
    assert lexicon.mine_han(docs, "doc_id", "body", limit=3).count() == 3
