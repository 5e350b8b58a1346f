"""Parts of the operators: formats, splits, searches and models against plain versions."""

import io
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import chat, common, components, language, mixing, packing, quality, simhash, spotsigs, token_records, warc
from lodestone.llm.common import encoder, tokenizer_file

ALPHABET = "ab'sé ßΣςİÀJ̌!?\n\t\r\x0b\x1c\x85\xa0  12,.<|endoftext|>中 '"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_is_the_tokenizer(name, spaced, text):
    e = encoder(tokenizer_file(name), spaced)
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode(text.encode()), e.dtype).tolist() == want


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_on_each_letter_before_stops(name, spaced):
    """Every character of U+00A0-U+024F, and some beyond, at the end of a word with a stop behind it, within and at the end of lines."""
    e = encoder(tokenizer_file(name), spaced)
    for c in [*map(chr, range(0xA0, 0x250)), "\u0307", "\u0130\u0307", "\u1e9e", "\u2126", "\u212a", "\ufb01"]:
        for frame in ("GAZ{}. Sonra", "ev{}, ve bu", "{}.", "a {}.\n{}, b", "EVLER{}{}. Bu, {}x. y", "{}\n"):
            t = frame.replace("{}", c)
            assert np.frombuffer(e.encode(t.encode()), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, (hex(ord(c[0])), t)


def test_encoder_forgets_and_agrees():
    e = common.Encoder(tokenizer_file("byte_bpe_50k.json"), True, memory=5)
    for t in ("one two three four five six seven", "x" * 5000, "one two again, and again.\nThen"):
        assert np.frombuffer(e.encode(t.encode()), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_records_and_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 5)) for i in range(200, 0, -1)], "doc_id long, text string")
    m = token_records.write_records(docs, f"file://{tmp_path}/r", tokenizer_file("word_bpe_49k.json")).collect()
    rows = token_records.read_records(spark, f"file://{tmp_path}/r", with_ids=True).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(1, 201)) and [r["start"] for r in rows] == [0, *np.cumsum([len(r["ids"]) for r in rows])[:-1]]
    first = min(m, key=lambda r: r["shard"])
    order = [3, 0, 2]
    got = token_records.fetch(first["path"], order)
    assert [d for d, _ in got] == [k + 1 for k in order] and all(list(ids) == rows[d - 1]["ids"] for d, ids in got)


def test_damage_is_noticed():
    good = token_records.frame(b"payload one") + token_records.frame(b"two")
    assert list(token_records.unframe(io.BytesIO(good))) == [b"payload one", b"two"]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            list(token_records.unframe(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(token_records.unframe(io.BytesIO(good[:-1])))


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_warc_splits_own_each_record_once(split):
    import zlib

    rnd, data = random.Random(3), b""
    for k in range(60):
        payload = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 5, 3000]))) + (b"\x1f\x8b\x08" * 20 if k % 7 == 0 else b"")
        c = zlib.compressobj(0 if k % 3 == 0 else 6, zlib.DEFLATED, 31)
        data += c.compress(warc.record(k, f"http://h/{k}", payload, "d", None if k % 4 else 5)) + c.flush()
    seen = []
    for at in range(0, len(data), split):
        seen += [head["warc-record-id"] for head, _ in warc.records_of(io.BytesIO(data), at, at + split)]
    assert seen == [f"<urn:page:{k}>" for k in range(60)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<\\|a>\n", max_size=30), st.text(alphabet="<\\|n\na", max_size=12))
def test_template_is_reversible(text, role):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    other = ("x", "<|im_end|>\n<|im_start|>y\nz")
    assert chat.parse(chat.render(role, text)[0] + chat.render(*other)[0]) == [(role, text), other]


def test_trees_share_turns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if t < 3 else f"t{t} of {c % 2}") for c in range(6) for t in range(5)]
    trees = chat.trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    nodes = sum(len(t["nodes"]) for t in trees)
    assert len(trees) <= 2 and nodes <= 3 * len(trees) + 4
    for t in trees:
        assert chat.position_ids(t.asDict(recursive=True)).max() < max(sum(len(chat.render(r, x)[0]) for c, _, r, x in rows if c == k) for k in range(6))
        for n in t["nodes"]:
            assert sum(a["end"] - a["start"] for a in n["attends"]) == n["position"]


def test_trees_close_when_full(spark):
    rows = [(c, t, "user", "same" if t == 0 else f"{c}" * 50) for c in range(40) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.trees(df, tree_chars=500).count() >= 4
    assert chat.formatted(df, tree_chars=500).where("n_turns = 2").count() == 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=9))
def test_fill_is_best(lengths):
    counts = {x: lengths.count(x) for x in lengths}
    taken = packing.fill(dict(counts), 64)
    rest = list(lengths)
    rest.remove(max(lengths))
    sums = {max(lengths)}
    for x in rest:
        sums |= {s + x for s in sums if s + x <= 64}
    assert sum(x * k for x, k in taken.items()) == max(sums) and all(k <= counts[x] for x, k in taken.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 20), max_size=8))
def test_plan_places_everything(counts):
    patterns, aside = packing.plan(dict(counts), 64)
    used = {x: sum(t * p.get(x, 0) for t, p in patterns) + aside.get(x, 0) for x in counts}
    assert used == counts and all(sum(x * k for x, k in p.items()) == 64 for _, p in patterns)
    slots, stream, base, tail = packing.layout(patterns, aside)
    fill = {}
    for x, n in aside.items():
        for r in range(n):
            for _, size, q, o in packing.cuts(stream[x][1] + r * x, x, tail, 64):
                fill.setdefault(q, []).append((o, size))
    for parts in fill.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert at & (at - 1) == 0 and at <= 64


def test_packing_cuts_what_fills_nothing(spark):
    docs = spark.createDataFrame([(i, " a" * 40) for i in range(7)], "doc_id long, text string")
    rows = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), window=64).collect()
    sums = {}
    for r in rows:
        sums[r["sequence_id"]] = sums.get(r["sequence_id"], 0) + r["length"]
    assert sum(sums.values()) == 7 * 41 and all(n & (n - 1) == 0 for n in sums.values()) and all(r["ids_crc32"] is not None for r in rows)


@pytest.mark.parametrize("lean", [-0.5, 0.0, 0.5])
def test_positions_invert_demand(spark, lean):
    t = [k / 20 for k in range(21)]
    rows = spark.createDataFrame([(x + lean * (x - x * x), x) for x in t], "v double, t double").select(mixing.when_reached(F.col("v"), F.lit(lean)).alias("u"), "t").collect()
    assert all(math.isclose(r["u"], r["t"], abs_tol=1e-9) for r in rows)


def test_mixture_takes_what_the_plan_says(spark):
    docs = spark.createDataFrame([(i, f" w{i} " + "x y\n" * (i % 9), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = {}
    for r in mixing.mixture(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {k: v for k, v in plan.items() if v}


def test_components_are_unions(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(120)] + [(5000, 5000 + k) for k in range(1, 400)]
    label = {x: x for p in pairs for x in p}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in label)


def test_links_connect_what_is_near(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(6))) for b in base for _ in range(12)} | {0, 1, 2**64 - 1})
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    got = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")))
    label = {r["node"]: r["label"] for r in got.collect()}
    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and want[i] != want[j]:
                a, b = want[i], want[j]
                want = [b if x == a else x for x in want]
    groups = lambda names: {frozenset(i for i, y in enumerate(names) if y == x) for x in set(names)}
    assert groups([label.get(x, x) for x in signed]) == groups(want)


def test_dedup_keeps_one(spark):
    t = "some words that are long enough to have shingles here " * 3
    docs = spark.createDataFrame([(3, t), (1, t), (1, t), (2, "quite another text with different words in it"), (None, ""), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] for r in simhash.one_of_each(docs).collect()), key=str) == [1, 2, None]


def test_bloom_filters_hold_their_own():
    f = language.Filters([f"l{k:02d}" for k in range(70)])
    own = [language.grams(f"word{chr(97 + k % 26)}{k} test{k * 7}x " * 3 + chr(0x4E00 + k) * 5) for k in range(70)]
    for k, h in enumerate(own):
        f.add(k, h)
    hits = f.close().hits(own)
    assert all(hits[k].max() == pytest.approx(hits[k][k]) and hits[k][k] > 0.9 * len(own[k]) for k in range(70))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=30))
def test_repeated_words(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measures(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        win = [tuple(t[k : k + 5]) for k in range(len(t) - 4)]
        assert got[i] == len({k + j for k, w in enumerate(win) if win.count(w) > 1 for j in range(5)})


def py_signatures(text, anchors, chain):
    import re

    w = re.findall(r"[^\W_]+", text.lower())
    spots = [i for i, x in enumerate(w) if x in anchors]
    content = [x for x in w if x not in anchors]
    out = {(w[a], *content[a - k : a - k + chain]) for k, a in enumerate(spots) if a - k < len(content)} if len(spots) < len(w) else {(w[a], *()) for a in ()}
    return out or {tuple(w[i : i + 1 + chain]) for i in range(len(w))}


@pytest.mark.parametrize("text", ["", "the", "the cat and the dog sat on the mat", "no anchors here whatsoever", "the of and", "The cat. THE CAT!", "x " * 500])
def test_signature_chains(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(spotsigs.signatures(F.col("t")).alias("s")).first()["s"]
    want = py_signatures(text, set(quality.STOP_WORDS), spotsigs.CHAIN)
    hashed = [spark.range(1).select(F.hash(*map(F.lit, [*x, *[None] * (spotsigs.CHAIN + 1 - len(x))])).alias("h")).first()["h"] for x in sorted(want)[:20]]
    assert len(got) == len(want) and got == sorted(got) and set(hashed) <= set(got)


def test_near_classes_are_all_pairs(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [x for _ in range(rnd.randrange(5, 60)) for x in (rnd.choice(["the", "of", "and"]), word(), word())]
        texts.append(" ".join(base))
        for _ in range(4):
            own = list(base)
            for _ in range(rnd.randrange(1, 4)):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += ["", None, "the", "the", texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[1]), (0, texts[5])], "doc_id long, text string")
    rows = docs.withColumn("s", spotsigs.signatures(F.col("text"))).collect()
    sets, label = [set(r["s"]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and (not a | b or len(a & b) >= 0.8 * len(a | b)):
                x, y = label[i], label[j]
                label = [y if k == x else k for k in label]
    least = {}
    for r, k in zip(rows, label):
        least[k] = min((x for x in (least.get(k), r["doc_id"]) if x is not None), default=None)
    want = sorted(((r["doc_id"], least[k]) for r, k in zip(rows, label)), key=str)
    assert len({k for k in label}) < len(label) - 10
    assert sorted((tuple(r) for r in spotsigs.near_classes(docs).collect()), key=str) == want
    assert spotsigs.near_classes(docs.limit(0)).count() == 0


def test_next_document_over_parts(spark):
    rows = spark.createDataFrame([(i * 3, f"t{i}") for i in range(97)], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(rows, "doc_id", ("text",), 13).collect()}
    assert got == {i * 3: f"t{(i - 1) % 97}" for i in range(97)}


def test_first_words(spark):
    rows = spark.createDataFrame([(" a  b\nc d", n) for n in range(1, 5)], "t string, n long").select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()
    assert [r["x"] for r in rows] == [" a  ", " a  b\n", " a  b\nc ", " a  b\nc d"]
