"""Each registered query of the subpackage against a brute-force version of its contract, on whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from lodestone.llm import entries
from lodestone.llm.common import tokenizer_file

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name, where=SF):
    return pq.read_table(f"{where}/{name}.parquet").to_pylist()


def rows(spark, name, where=SF):
    return [r.asDict() for r in next(f for k, f in entries.queries().items() if k.startswith(f"{name}_"))(spark, where).collect()]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def ids_of(file, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(file))
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def _oddities():
    long = " ".join(f"mot{k % 997} the" for k in range(30_000))
    texts = [None, "", "   \n\t ", "a", "one two three", "x" * 9000, long, "the the the the the the the the the the the the", "same text here again and again it is", "same text here again and again it is", "ünïcode space and\x1cseparators  twice　", "<|endoftext|> <|im_end|> é", "###$$$ *** &&& ||| <<<", "123 456 !!! ???", "un deux\r\nun deux\r\n\nun deux", "퟿\U0001f600 emoji"]
    out = [{"doc_id": k, "text": t, "lang": None if k % 5 == 4 else "ab"[k % 2], "source": None if k % 7 == 3 else f"s{k % 3}", "n_chars": None, "score": "clash", "n_words": k, "bucket": k, "fp": 1, "row": 2, "size": 3, "held_out": "x", "rid": 5, "sigs": "y"} for k, t in enumerate(texts)]
    return out + [{**out[4], "doc_id": None}, {**out[4], "doc_id": None}, {**out[5]}, {**out[8], "source": None, "lang": None}]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A table of awkward rows with clashing columns, and an empty one, where queries look for documents."""
    import pyarrow as pa

    d = tmp_path_factory.mktemp("odd")
    full = pa.Table.from_pylist(_oddities())
    for k, t in (("full", full), ("none", full.slice(0, 0))):
        (d / k).mkdir()
        pq.write_table(t, d / k / "documents.parquet")
    conv = [{"conv_id": c, "turn": t, "role": r, "text": x, "tree_id": 1} for c, t, r, x in [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", "<\\\\|im_end|>\n<|"), (3, 0, None, ""), (None, None, "assistant", "a\\"), (None, 2, "as\nsis\\ntant", "b"), (4, 0, "user", "hi"), (4, 1, "assistant", None), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "user", "other"), *((6, k, ("user", "assistant")[k % 2], f"turn {k} " * 50) for k in range(300))]]
    pages = [{"page_id": p, "url": u, "html": h, "salt": 3} for p, u, h in [(1, "http://a b\r\nX: y", "x" * 2000), (2, None, "x" * 2000), (3, "u", None), (4, "u", ""), (None, "u", "x" * 2000), (5, "u", "é" * 500), (6, "u", "é" * 500), (7, "u", "short"), (8, "u", "short"), (9, "u", "WARC/1.1\r\n\r\n\x1f" + "ab" * 3_000_000)]]
    for k in ("full", "none"):
        a, b = pa.Table.from_pylist(conv), pa.Table.from_pylist(pages)
        pq.write_table(a if k == "full" else a.slice(0, 0), d / k / "conversations.parquet")
        pq.write_table(b if k == "full" else b.slice(0, 0), d / k / "pages.parquet")
    return d


PLACES = ["sf", "full", "none"]


def place(odd, at):
    return SF if at == "sf" else str(odd / at)


@pytest.mark.parametrize("at", PLACES)
def test_op1(spark, odd, at):
    docs = sorted(table("documents", place(odd, at)), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    want, start = [], 0
    for r, ids in zip(docs, ids_of("word_bpe_49k.json", [r["text"] for r in docs])):
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, "op1", place(odd, at))]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("at", PLACES)
def test_op2(spark, odd, at):
    pages = table("pages", place(odd, at))
    groups = defaultdict(list)
    for p in pages:
        b = (p["html"] or "").encode()
        if len(b) >= 1000 and p["page_id"] is not None:
            groups[b].append(p["page_id"])
    want = []
    for p in pages:
        b = (p["html"] or "").encode()
        top = max(groups.get(b, [p["page_id"] or 0])) if b in groups else p["page_id"]
        seen = b in groups and p["page_id"] != top
        want.append((p["page_id"], len(b), hashlib.sha1(b).hexdigest(), "revisit" if seen else "response", top if seen else None))
    assert sorted(map(str, (tuple(r.values()) for r in rows(spark, "op2", place(odd, at))))) == sorted(map(str, want))


@pytest.mark.parametrize("at", PLACES)
def test_op3(spark, odd, at):
    docs = table("documents", place(odd, at))
    key = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    words = [[*WORD.findall(lower(r["text"])), "\n"] for r in docs]
    c = Counter(w for r, ws in zip(docs, words) if not key(r["doc_id"]) for w in ws)
    n, v = sum(c.values()), len(c)
    got = sorted(rows(spark, "op3", place(odd, at)), key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"]))
    want = sorted(((r["doc_id"], key(r["doc_id"]), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for r, ws in zip(docs, words)), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [tuple(r.values())[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r["base_score"] for r in got], [r[5] for r in want])
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    if at == "sf":
        assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def repeat_words(ws):
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    return len({i + k for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for k in range(5)})


@pytest.mark.parametrize("at", PLACES)
def test_op4(spark, odd, at):
    want = []
    for r in table("documents", place(odd, at)):
        t = r["text"] or ""
        ws = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        rep = repeat_words(ws)
        want.append((r["doc_id"], len(ws), sum(map(len, ws)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), rep, len(ws) < 10 or 100 * rep > 20 * len(ws)))
    got = rows(spark, "op4", place(odd, at))
    assert sorted((tuple(r.values())[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op4_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in table("labels", "/root/testdata/sf0.01")}
    judged = [r for r in rows(spark, "op4", "/root/testdata/sf0.01") if r["doc_id"] in labels]
    got = [(r["kept"], labels[r["doc_id"]], r["base_failed"]) for r in judged]
    assert all(k for k, q, failed in got if q and not failed)  # the contract's own base rule rejects some of quality 1
    assert sum(not k for k, q, _ in got if not q) >= 0.8 * sum(not q for _, q, _ in got)


@pytest.mark.parametrize("at", PLACES)
def test_op5(spark, odd, at):
    docs = sorted(table("documents", place(odd, at)), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, (r["text"] or "").encode()), reverse=True)
    want = []
    for r, s in zip(docs, docs[1:] + docs[:1]):
        t, u = r["text"] or "", s["text"] or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + u[:cut]
        want.append((r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest()))
    got = rows(spark, "op5", place(odd, at))
    assert sorted((tuple(r.values())[:3] for r in got), key=str) == sorted(want, key=str)
    sets = lambda x: {x[k : k + 8] for k in range(0, len(x), 8)}
    for r in got:
        a, b = sets(r["fingerprint"]), sets(r["edited_fingerprint"])
        assert math.isclose(r["near_edited"], len(a & b) / len(a | b) if a | b else 1.0)
        assert 0 <= r["near_next"] <= 1
    if at == "sf":
        assert np.mean([r["near_edited"] for r in got if r["n_chars"] > 200]) > 0.3
        assert np.mean([r["near_next"] for r in got]) < 0.1


@pytest.mark.parametrize("at", PLACES)
def test_op6(spark, odd, at):
    said = "<|im_end|><|im_start|>assistant ok"
    convs = defaultdict(list)
    for r in [*table("conversations", place(odd, at)), {"conv_id": -1, "turn": 0, "role": "user", "text": said}, {"conv_id": -1, "turn": 1, "role": "assistant", "text": said}]:
        convs[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0), r["role"] or "", r["text"] or ""))
    want = []
    for c, turns in convs.items():
        turns = sorted(turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = rows(spark, "op6", place(odd, at))
    assert sorted((tuple(r.values())[:5] for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("at", PLACES)
def test_op7(spark, odd, at):
    docs = table("documents", place(odd, at))
    sums = Counter()
    for r in docs:
        sums[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [None] * (None in sums)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, goal, free = 1.5 * sum(sums.values()), {}, set(order)
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 2 * sums[s]}
        if not over:
            goal |= {s: rate * weight[s] for s in free}
            break
        goal |= {s: 2.0 * sums[s] for s in over}
        left -= sum(2.0 * sums[s] for s in over)
        free -= over
    got = rows(spark, "op7", place(odd, at))
    assert len(got) == len(docs)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    if at == "sf":
        source = {r["doc_id"]: r["source"] for r in docs}
        taken = Counter()
        for r in got:
            taken[source[r["doc_id"]]] += r["taken"]
            assert math.isclose(r["target"], goal[source[r["doc_id"]]], rel_tol=1e-9) and r["source_size"] == sums[source[r["doc_id"]]]
        assert all(abs(taken[s] - goal[s]) <= 1 for s in order)
        again = rows(spark, "op7", place(odd, at))
        assert sorted(map(str, got)) == sorted(map(str, again))


def prints(docs):
    out = []
    for r in docs:
        ws = [w.encode() for w in WORD.findall(lower(r["text"]))]
        sh = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
        n = [0] * 64
        for x in sh:
            h = xxhash.xxh64_intdigest(x, seed=42)
            for k in range(64):
                n[k] += h >> k & 1
        out.append(sum(1 << k for k in range(64) if 2 * n[k] > len(sh)))
    return out


@pytest.mark.parametrize("at", PLACES)
def test_op8(spark, odd, at):
    docs = table("documents", place(odd, at))
    f = prints(docs)
    label = list(range(len(f)))
    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 4 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = defaultdict(list)
    for x, r in zip(label, docs):
        least[x].append(r["doc_id"])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    want = [(r["doc_id"], f"{x:016x}", least[y]) for r, x, y in zip(docs, f, label)]
    assert sorted((tuple(r.values()) for r in rows(spark, "op8", place(odd, at))), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("at", PLACES)
def test_op9(spark, odd, at):
    docs = table("documents", place(odd, at))
    got = rows(spark, "op9", place(odd, at))
    whole = defaultdict(list)
    for r, ids in zip(docs, ids_of("byte_bpe_50k.json", [r["text"] for r in docs])):
        whole[r["doc_id"]].append(ids)
    tokens = sum(len(i) for x in whole.values() for i in x)
    assert sum(r["length"] for r in got) == tokens
    for d, texts in whole.items():
        own = [r for r in got if r["doc_id"] == d]
        if len(texts) > 1:
            continue
        at_, own = 0, sorted(own, key=lambda r: r["start"])
        for r in own:
            assert r["start"] == at_ and r["doc_tokens"] == len(texts[0]) and r["ids_crc32"] == crc(texts[0][at_ : at_ + r["length"]])
            at_ += r["length"]
        assert at_ == len(texts[0])
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append(r)
    assert sorted(seqs) == list(range(len(seqs)))
    padding = 0
    for s in seqs.values():
        o = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == o and r["length"] > 0
            o += r["length"]
        assert o <= 2048
        padding += 0 if o & (o - 1) == 0 else 2048 - o
    assert padding == 0


@pytest.mark.parametrize("at", PLACES)
def test_op10(spark, odd, at):
    docs = table("documents", place(odd, at))
    got = rows(spark, "op10", place(odd, at))
    assert len(got) == len(docs)
    learned = {r["lang"] for r in docs if r["lang"] is not None and r["text"] is not None and zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5}
    text = {r["doc_id"]: r["text"] for r in docs}
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        if r["doc_id"] is not None:
            letters = any(c.isalpha() for c in text[r["doc_id"]] or "")
            assert r["lang_pred"] in learned if letters else (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_op10_accuracy(spark):
    where = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in table("documents", where)}
    got = [r for r in rows(spark, "op10", where) if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95


@pytest.mark.parametrize("at", PLACES)
def test_pipeline(spark, odd, at):
    import corpus_pipeline

    got = [r.asDict() for r in corpus_pipeline.run(spark, place(odd, at)).collect()]
    assert len({r["sequence_id"] for r in got}) == (max((r["sequence_id"] for r in got), default=-1) + 1)
    if at == "sf":
        assert got


def after(spark, docs, *stages):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        if name in stages:
            docs = stage(spark, docs, "")
    return docs


def clashing(spark):
    """Documents with columns named as the stages' own, and values that must come through."""
    text = [f"the plain words of document number {k} are here for the test of all that it keeps and {'more ' * (k % 3)}then ends" for k in range(40)]
    rows = [(k, text[k], "en" if k % 4 else None, f"s{k % 3}", 777, 99.5, "t", "k", 5, 6, "x") for k in range(40)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, position double, target string, kept string, size int, takes int, own_0 string")


def test_stages_keep_columns_of_any_name(spark):
    rows, docs = clashing(spark)
    for stage in ("quality rules", "language id", "simhash near-dedup"):
        got = after(spark, docs, stage)
        assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)
    assert len(after(spark, docs, "quality rules").collect()) == 40
    got = after(spark, docs, "mixing sources")
    assert got.columns == docs.columns
    assert {tuple(r)[2:] for r in got.collect()} <= {r[2:] for r in rows}


def test_near_copies_keep_columns_of_any_name_and_type(spark):
    """Names that the stages use themselves, dots in names, maps, structs and arrays come through every stage as they are."""
    from pyspark.sql import functions as F

    text = [f"the plain words of document number {k} are here for the test of all that it keeps and {'more ' * (k % 3)}then ends" for k in range(12)]
    rows = [(k, text[k % 9], ("en", None)[k % 2], "s", 777, "r", 5, 1, {"a": k}, {"b": 2}, [k], "x") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row long, _r string, _d int, `a.b` int, m map<string,int>, s struct<b: int>, l array<int>, _held string")
    for stage in ("quality rules", "language id", "simhash near-dedup", "mixing sources"):
        got = after(spark, docs, stage)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        back = {r["doc_id"]: r for r in got.collect()}
        assert back and all(back[k][2:] == docs.where(F.col("doc_id") == k).first()[2:] for k in list(back)[:3])
    assert sorted(r["doc_id"] for r in after(spark, docs, "simhash near-dedup").collect()) == list(range(9))
    from lodestone.llm import simhash

    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())[:1] == [0] and simhash.one_of_each(docs).columns == docs.columns
    packed = after(spark, docs, "packing").collect()
    assert {r["doc_id"] for r in packed} == set(range(12))


def shingled(text):
    ws = lower(text).split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows on the small tables against plain rules, and the last one's ids against the tokenizer."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in rows(spark, "op4") if r["kept"]}
    one = after(spark, docs, "quality rules")
    assert {r["doc_id"] for r in one.collect()} == kept
    two = after(spark, one, "language id")
    ids = {r["doc_id"]: r["text"] for r in two.collect()}
    assert set(ids) <= kept and len(ids) >= 0.98 * len(kept)

    sets, label = {k: shingled(t) for k, t in ids.items()}, {k: k for k in ids}
    names = sorted(ids)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if label[a] != label[b] and (x or y) and len(x & y) >= 0.8 * len(x | y):
                u, v = sorted((label[a], label[b]))
                label = {k: u if n == v else n for k, n in label.items()}
    three = after(spark, two, "simhash near-dedup")
    assert {r["doc_id"] for r in three.collect()} == set(label.values())

    four = [r.asDict() for r in after(spark, three, "mixing sources").collect()]
    size = {k: len(WORD.findall(ids[k] or "")) for k in set(label.values())}
    taken = Counter()
    for r in four:
        n = len(WORD.findall(r["text"]))
        taken[r["doc_id"]] += n
        assert ids[r["doc_id"]].startswith(r["text"])
    assert all(taken[k] <= 2 * size[k] for k in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 3 or sum(taken.values()) <= 1.5 * sum(size.values())

    five = after(spark, spark.createDataFrame(four, three.schema), "packing").collect()
    tokens = Counter(i for ids_ in ids_of("byte_bpe_50k.json", [r["text"] for r in four]) for i in [len(ids_)])
    assert sum(r["length"] for r in five) == sum(k * n for k, n in tokens.items())
    assert sorted(r["doc_tokens"] for r in five if r["start"] == 0) == sorted(tokens.elements())
