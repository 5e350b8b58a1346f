"""Cases that the tables don't hold: scripts, entities, headings, charsets, histories, graphs, calibration, streams."""

import io
import zipfile
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evaluate, evidence, ingest, knowledge, lexicon
from lodestone.sources import files
from lodestone.streaming import windows


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def py_fields(text):
    import re

    out = []
    for r in re.findall("[0-9A-Za-z一-鿿]{2,}", text):
        out += [r[i : i + 2].lower() for i in range(len(r) - 1)] if "一" <= r[0] <= "鿿" else [r.lower()]
    return out


@pytest.mark.parametrize("text", ["连接池Max大小 is 128!", "A连接池", "Étion oui X a1 中 文字", ""])
def test_fields(spark, text):
    assert one(spark, text, tx.fields) == py_fields(text)
    assert py_fields("连接池Max大小 is 128!") == ["连接", "接池", "池m", "ma", "ax", "x大", "大小", "is", "128"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aB9é中文 ,-x", max_size=30), min_size=1, max_size=40))
def test_fields_random(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", tx.fields(F.col("x")).alias("y")).collect()
    assert {r["i"]: r["y"] for r in rows} == {i: py_fields(t) for i, t in enumerate(texts)}


def test_html_entities(spark):
    assert one(spark, "<p>a&amp;lt;b&nbsp;c</p><script>x</script><br/>d<!-- e -->", tx.extract_html) == "a&lt;b c\n \nd"


def test_unigrams_and_topics(spark):
    assert one(spark, "max 连接 is MAX 如何?", tx.unigrams) == sorted({"max", "连", "接", "is", "如", "何"})
    assert one(spark, "b a", tx.topic_key) == one(spark, "A  b", tx.topic_key)


def test_keyword_score_grows(spark):
    toks = F.array(*[F.lit(f"t{k}") for k in range(10)])
    got = [one(spark, " ".join(f"t{k}" for k in range(n)), lambda c: tx.keyword_score(toks, c)) for n in range(11)]
    assert got == sorted(got) and got[0] == 0 and got[-1] == pytest.approx(8.4)


@pytest.mark.parametrize("n", [0, 1, 8000, 8001, 15001, 16000])
def test_blocks_cover(spark, n):
    b = ingest.blocks(spark.createDataFrame([(1, "x" * n)], "i int, t string"), "i", "t").orderBy("block_index").collect()
    assert b[0]["block_start"] == 0 and b[-1]["block_end"] == n
    assert all(y["block_start"] == x["block_start"] + 7000 for x, y in zip(b, b[1:])) and len(b) == (1 if n <= 8000 else -(-(n - 8000) // 7000) + 1)


def test_spans_tile(spark):
    text = "pre\n# One\nbody\n--- page 2 ---\n## Two  \nend"
    s = ingest.structure_spans(spark.createDataFrame([(1, text), (2, "plain")], "i int, t string"), "i", "t").orderBy("i", "start").collect()
    own = [(r["kind"], r["label"], r["start"], r["end"]) for r in s if r["i"] == 1]
    assert [x[:2] for x in own] == [("preamble", ""), ("heading", "One"), ("page", "2"), ("heading", "Two")]
    assert own[0][2] == 0 and own[-1][3] == len(text) and all(a[3] == b[2] for a, b in zip(own, own[1:]))
    assert [(r["kind"], r["end"]) for r in s if r["i"] == 2] == [("doc", 5)]


def test_version_history(spark):
    rows = spark.createDataFrame([(1, t, g) for t, g in enumerate("AABA")], "k int, t int, g string")
    v = ingest.versions(rows, "k", ["t"], "g").orderBy("t").collect()
    assert [(r["g"], r["version"], r["status"]) for r in v] == [("A", 1, "stale"), ("B", 2, "stale"), ("A", 3, "active")]


@pytest.mark.parametrize("query,parts", [("a b and c d", ["a b", "c d"]), ("参与违法怎么办", ["参与违法怎么办"]), ("连接池和线程池", ["连接池", "线程池"]), ("a; b; c; d; e", ["a", "b", "c", "d"]), (";", [";"])])
def test_decompose(spark, query, parts):
    assert one(spark, query, evidence.decompose) == parts


@pytest.mark.parametrize("part,unit", [("《红楼》作者", True), ("《红楼", False), ('"右和', False), ("abc", False), ("(a)b(c)d", True), (")ab(", False)])
def test_units(spark, part, unit):
    assert one(spark, part, evidence.is_unit) is unit


def test_consolidate(spark):
    w = spark.createDataFrame([(1, 1, 0, 10, 1.0), (1, 1, 11, 20, 9.0), (1, 1, 5, 8, 2.0), (1, 1, 30, 40, 3.0)], "q int, d int, start int, end int, score double")
    assert sorted((r["start"], r["end"], r["score"]) for r in evidence.consolidate(w, ["q", "d"]).collect()) == [(0, 20, 9.0), (30, 40, 3.0)]


def test_failed_scores_are_not_zero(spark):
    r = evidence.all_failed(spark.createDataFrame([(1, None), (1, 8.0), (2, None)], "q int, score double"), "q").orderBy("q").collect()
    assert [(x["failed"], x["mean"]) for x in r] == [(False, 8.0), (True, None)]


def test_bands_keep_double_division(spark):
    rows = spark.createDataFrame([(0.05 * k, True) for k in range(21)], "conf double, correct boolean")
    got = {r["band"]: r["n"] for r in evaluate.bands(rows).collect()}
    want = {}
    for k in range(21):
        b = min(max(int(0.05 * k / 0.05), 0), 19)
        want[b] = want.get(b, 0) + 1
    assert got == want


def test_mcnemar(spark):
    from math import comb

    n, k = 30, 7
    a = spark.createDataFrame([(i, i < k) for i in range(n)], "id int, correct boolean")
    b = spark.createDataFrame([(i, i >= k) for i in range(n)], "id int, correct boolean")
    r = evaluate.mcnemar(a, b, "id").first()
    assert (r["b"], r["c"]) == (k, n - k) and r["p"] == pytest.approx(min(1, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n), abs=1e-6)


def test_exact_rank(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 3, 3, 9, 7, 2)], "k string, v int")
    assert evaluate.exact_rank(rows, ["k"], "v", 9, 10, "p").first()["p"] == sorted((5, 1, 3, 3, 9, 7, 2))[63 // 10]


def test_graph_barriers_and_cycles(spark):
    e = spark.createDataFrame([("s", "a", 0.6, "pathway"), ("a", "s", 0.6, "plain"), ("a", "b", 0.6, "plain"), ("s", "x", 0.6, "plain"), ("a", "low", 0.4, "plain")], "a string, b string, weight double, kind string")
    got = knowledge.expand(spark.createDataFrame([("s",)], "start string"), e, barriers=spark.createDataFrame([("s", "x")], "start string, node string")).collect()
    assert {(r["node"], r["depth"], r["score"]) for r in got} == {("a", 1, 0.9), ("b", 2, 1.5)}


def walked(edges, start, depth, least, direction, nodes=None, nearest=None, probe=None):
    """The expansion as a plain loop: (node, depth, score)."""
    import numpy as np

    turn = [(a, b, w, k) for a, b, w, k in edges if direction != "in"] + [(b, a, w, k) for a, b, w, k in edges if direction != "out"]
    bars = {b for a, b, _, k in edges if k == "barrier" and a == start} | ({a for a, b, _, k in edges if k == "barrier" and b == start} if direction != "out" else set())
    seen, front, out = {start}, {start: 0.0}, []
    for d in range(1, depth + 1):
        new = {}
        for n, score in front.items():
            best = {}
            for a, b, w, k in turn:
                if a == n and w >= least and k != "barrier" and b not in seen | bars and (nodes is None or b in nodes):
                    best[b] = max(best.get(b, 0), score + w * (1.5 if k == "pathway" else 1.0))
            if nearest is not None:
                cos = lambda b: round(float(np.dot(nodes[b], probe) / np.linalg.norm(nodes[b]) / np.linalg.norm(probe)), 9)
                best = {b: best[b] for b in sorted(best, key=lambda b: (-cos(b), b))[:nearest]}
            for b, x in best.items():
                new[b] = max(new.get(b, 0), x)
        seen |= set(new)
        front = new
        out += [(b, d, round(x, 6)) for b, x in new.items()]
    return sorted(out)


@pytest.mark.parametrize("direction", ["out", "in", "any"])
def test_graph_expansion_against_a_loop(spark, direction):
    """Random graphs with cycles, parallel edges and barriers; hops cut below and above the fan-out; four hops."""
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(14), rng.randrange(14), rng.choice([0.4, 0.6, 0.7, 0.9]), rng.choice(["plain", "plain", "plain", "pathway", "barrier"])) for _ in range(60)]
    nodes = {n: [rng.random() - 0.5 for _ in range(3)] for n in range(12)}  # 12 and 13 are no clusters
    e = spark.createDataFrame(edges + [(None, 1, 0.9, "plain"), (1, None, 0.9, "plain")], "a int, b int, weight double, kind string")
    v = spark.createDataFrame(list(nodes.items()), "node int, embedding array<double>")
    starts = spark.createDataFrame([(n, nodes[n]) for n in (0, 3, 7)], "start int, probe array<double>")
    for nearest in (None, 1, 2, 50):
        got = knowledge.expand(starts, e, 4, 0.5, 100, direction, v, nearest).collect()
        for s in (0, 3, 7):
            assert sorted((r["node"], r["depth"], r["score"]) for r in got if r["start"] == s) == walked(edges, s, 4, 0.5, direction, nodes, nearest, nodes[s]), (s, nearest)


def test_fit_nodes(spark):
    n = spark.createDataFrame([(1, 0.5, 0.5, "stable"), (2, 0.1, 0.9, "stable"), (3, 0.9, 0.1, "emerging"), (4, 1.0, 1.0, "deprecated"), (5, 0.5, 0.5, "contested")], "node int, hotness double, confidence double, lifecycle string")
    assert sorted(r["node"] for r in knowledge.fit_nodes(n, 0.2, 0.2).collect()) == [1, 5]


def test_greedy_merges():
    assert knowledge.greedy_merges([(0.9, 1, 2), (0.8, 2, 3), (0.7, 3, 4)]) == [(1, 2), (3, 4)]
    assert lexicon.keep_dissimilar(["a b c", "a b d", "x y"], ["a b"]) == ["x y"]


def test_charset_gate():
    assert files.decode(b"\xef\xbb\xbfabc") == "abc" and files.decode("中文".encode("gb18030")) == "中文"
    assert files.decode(b"\xff\xff\xff") is None and files.preview("é".encode()[:1] and "aé".encode()[:-1]) == "a"


def test_file_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes("中文 文本".encode("gb18030"))
    (tmp_path / "d/b.html").write_text("<p>hello</p>")
    (tmp_path / "d/bad.md").write_bytes(b"\xff\xff\xff")
    (tmp_path / "d/.hidden.md").write_text("no")
    with zipfile.ZipFile(tmp_path / "d/c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>one</w:t></w:p><w:p><w:t> two </w:t></w:p></w:document>')
    (tmp_path / "d/e.pdf").write_bytes(b"%PDF\nstream\n" + zlib.compress(b"BT (plain words) Tj ET") + b"\nendstream\n")
    got = {r["path"].rpartition("/")[2]: (r["body"], r["problem"]) for r in files.read_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {"a.txt": ("中文 文本", None), "b.html": ("hello", None), "bad.md": (None, "undecodable"), "c.docx": ("one\ntwo", None), "e.pdf": ("plain words", None)}
    (tmp_path / "r.csv").write_text('id, text\n1,"two\nlines"\n2\n3,=1+1,extra\n')
    assert [r["text"] for r in files.read_csv(spark, str(tmp_path / "r.csv")).collect()] == ["two\nlines", None, "=1+1"]
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_json_lines(spark, str(tmp_path / "r.jsonl"), "a long").collect() if r["a"] is not None) == [1, 2]
    assert files.kind_of("x", b"PAR1") == "parquet" and files.kind_of("x", b"\0\1") == "binary" and files.kind_of("x", b' {"a"') == "jsonl"
    assert io.BytesIO(b"").read() == b""


def test_safe_cells(spark):
    assert [one(spark, x, ingest.safe_cell) for x in ("=1+1", " @x", "plain", "-2")] == ["'=1+1", "' @x", "plain", "'-2"]


def test_stream_reconciles_once(spark, tmp_path):
    """A changelog on files, consumed twice: the second run finds nothing new and the result stands."""
    src = tmp_path / "changes"
    spark.createDataFrame([(1, "deleted"), (2, "active")], "doc_id long, status string").write.parquet(str(src))
    evidence_rows = spark.createDataFrame([(1, 7, "live"), (2, 8, "live")], "doc_id long, cluster long, status string")
    seen = []

    def apply(batch, _):
        e, review = windows.reconcile(batch, evidence_rows, evidence_rows.select("doc_id", "cluster"))
        seen.append((sorted((r["doc_id"], r["status"]) for r in e.collect()), [r["cluster"] for r in review.collect()]))

    for _ in range(2):
        stream = spark.readStream.schema("doc_id long, status string").parquet(str(src))
        windows.follow(stream, apply, f"file://{tmp_path}/at").awaitTermination()
    assert seen == [([(1, "invalid"), (2, "live")], [7])]


def test_session_stack():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    ts = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:01", "2024-01-01 02:00"])
    s, state = windows.SessionStack(), State()
    out = list(s((1,), [pd.DataFrame({"ts": ts[:2], "doc_id": [5, 6], "weight": [1.0, 0.6]})], state))[0]
    assert list(out["doc_id"]) == [5, 6] and list(out["weight"]) == [0.6, 0.6]
    out = list(s((1,), [pd.DataFrame({"ts": ts[2:], "doc_id": [9], "weight": [0.6]})], state))[0]
    assert list(out["doc_id"]) == [9]
