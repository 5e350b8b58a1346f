"""terms are counted where texts are read, scores are added up in blocks, and texts are read again for picked documents alone."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import index as ix
from lodestone.operators import ingest, lexicon
from lodestone.plans import common, registry

TINY = "/root/testdata/sf0.001"
ODD = [None, "", "a", "Z9", "a b", "ab", "AB cd", "x", "yy", "yy中文字 zz", "中文", "中", "Ünïcode ab-CD_ef", "İstanbul Kelvin 12", "tail", "Tail", "\n\nend\n", "中a文b zz ZZ", "ab" * 900, "é" * 40 + "qq"]


def test_runs_of_a_lower_cased_text_are_its_tokens(spark):
    """Whatever character stands between letters, and at the ends."""
    points = "SELECT id FROM range(1, 55296) UNION ALL SELECT id FROM range(57344, 195104)"
    c = spark.sql(f"SELECT decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c FROM ({points})")
    rows = c.select(F.concat(F.lit("Ab"), "c", F.lit("X"), "c", "c", F.lit("9z Q"), "c").alias("x"))
    x = F.col("x")
    assert rows.where(~tx.fields(x).eqNullSafe(tx._fields_by_run(x))).limit(5).collect() == []
    assert spark.createDataFrame([(t,) for t in ODD], "x string").where(~tx.fields(x).eqNullSafe(tx._fields_by_run(x))).collect() == []


def _docs(spark, parts):
    rng = random.Random(3)
    words = ["ab", "CD", "ef", "gh1", "中文字", "zz", "x", "Tail"]
    texts = ODD + [rng.choice([" ", "-", "é", ""]).join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(120)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string").repartition(parts)


def _queries(spark):
    asked = [["ab", "zz", "tail"], ["中文", "文字", "gh1"], ["nowhere"], [], ["cd", "cd", "ef", "qq", "kelvin"]]
    return spark.createDataFrame(list(enumerate(asked)), "item_id long, tokens array<string>")


@pytest.mark.parametrize(("parts", "most"), [(1, "8"), (3, "10000")])
def test_counts_of_batches_are_the_index(spark, parts, most):
    """Batches that end anywhere, texts that begin where another's word ends, CJK beside ASCII, null and empty texts."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        docs, q = _docs(spark, parts), _queries(spark)
        index, scan, words = ix.Index(docs), ix.Scan(docs, q), ix.Vocabulary(docs, q)
        asked = [t for r in q.collect() for t in r["tokens"]]
        rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
        assert rows(scan.tf, "term", "doc_id", "tf", "dl") == rows(index.tf.where(F.col("term").isin(asked)), "term", "doc_id", "tf", "dl")
        assert rows(words.df, "term", "df") == rows(scan.df, "term", "df") == rows(index.df.where(F.col("term").isin(asked)), "term", "df")
        assert tuple(words.sizes.first()) == tuple(scan.sizes.first()) == tuple(index.sizes.first())
        assert rows(words.gaps(q), "item_id", "gap") == rows(index.gaps(q), "item_id", "gap")
        none = docs.where("false")
        assert tuple(ix.Vocabulary(none, q).sizes.first()) == tuple(ix.Scan(none, q).sizes.first()) == (0, 0.0)
        assert ix.Scan(none, q).rank(q, 3).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("sizes", [(4096, 1 << 17, 256), (7, 1 << 17, 2), (4096, 20, 1)])
def test_rank_by_blocks_is_the_best_of_all_scores(spark, monkeypatch, sizes):
    for name, n in zip(("SCORED", "POSTED", "ASKED"), sizes):
        monkeypatch.setattr(ix, name, n)
    docs, q = _docs(spark, 3), _queries(spark)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for d, places in ((docs, (4,)), (named, (1, 500))):
        scan = ix.Scan(d, q)
        for k in places:
            want = ix.top(ix.Index(d).scores(q), "item_id", [F.desc("score"), F.col("doc_id")], k)
            assert sorted(map(tuple, scan.rank(q, k).select("item_id", "doc_id", "score", "rnk").collect())) == sorted(map(tuple, want.select("item_id", "doc_id", "score", "rnk").collect()))
    assert "collect_list" in scan.rank(q, 1)._jdf.queryExecution().toString()  # postings meet in blocks, a row for each document and query isn't made


def test_vocab_gap_counts_no_document(spark, monkeypatch):
    """the share of unknown terms needs no counts by document."""

    def no(*a, **k):
        raise AssertionError("counts by document were made")

    monkeypatch.setattr(ix.Scan, "__init__", no)
    assert registry.queries()["vocab_gap"](spark, TINY).count()


def test_gold_by_counted_terms(spark, monkeypatch):
    """the texts are not taken apart a second time, and the documents are the same."""
    q, s = common.items(spark, TINY), common.sources(spark, TINY)
    extra = spark.createDataFrame([(9001, "in the"), (9002, "the"), (9003, ""), (9004, "no such words anywhere here")], "item_id int, query string").select("item_id", "query", tx.fields(F.col("query")).alias("tokens"))
    q = q.unionByName(extra)
    want = sorted(map(tuple, lexicon.gold_pairs(q, s).select("item_id", "doc_id").collect()))
    scan = ix.Scan(s, q)

    def no(*a, **k):
        raise AssertionError("texts were taken apart again")

    monkeypatch.setattr(tx, "fields", no)
    got = lexicon.gold_pairs(q, s, scan)
    assert sorted(map(tuple, got.select("item_id", "doc_id").collect())) == want and want
    assert set(got.columns) == set(q.columns) | set(s.columns)


def test_answer_summary_cuts_picked_documents_alone(spark, monkeypatch):
    """spans are made of the documents that are cited, not of all."""
    cut, real = [], ingest.structure_spans
    monkeypatch.setattr(ingest, "structure_spans", lambda docs, *a: cut.append(docs.count()) or real(docs, *a))
    n = registry.queries()["answer_summary"](spark, TINY).count()
    assert n and cut and cut[0] <= n < common.sources(spark, TINY).count()
