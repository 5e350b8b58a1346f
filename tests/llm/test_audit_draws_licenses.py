"""The filter audit, the importance draw and the license scan against brute force, on small tables and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import audit, entries, licenses, resample

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLACES = ["sf", "full", "none"]


def oddities():
    mit = "Released under the MIT License. "
    texts = [None, "", " \n\t ", "a", "x" * 9000, " ".join(f"mot{k % 997} the" for k in range(30_000)), mit, mit * 3000, "SHOUTING ALL OF IT", "50% of # and $", "same text here again and again it is", "same text here again and again it is", "Licensed under CC BY-NC-SA 4.0 and the Apache License, Version 2.0; SPDX-License-Identifier: GPL-3.0-or-later", "under the mıt license under the MİT License", "K for Kelvin é ü ẞ License", "word " * 25, "other words " * 40, "\x00\x01control under\x00the MIT\x7flicense", "퟿\U0001f600 emoji"]
    rows = [{"doc_id": k, "text": t, "lang": None if k % 5 == 4 else ("en", "", "fr")[k % 3], "n_words": "clash", "score": k, "range": 1, "mask": 3, "part": "p", "detections": 5, "rank": 9, "no_id": 1, "salt": 2} for k, t in enumerate(texts)]
    return rows + [{**rows[10], "doc_id": None}, {**rows[15], "doc_id": None}, {**rows[15], "doc_id": None}, {**rows[10]}, {**rows[15], "lang": "fr"}]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    docs = pa.Table.from_pylist(oddities())
    labels = pa.Table.from_pylist([{"doc_id": k, "quality": q, "toxic": t} for k, q, t in [(0, 1, 0), (1, None, 1), (3, 0, 1), (3, 1, 0), (8, 1, 1), (11, 1, None), (None, 1, 1), (99, 1, 1)]])
    bench = pa.Table.from_pylist([{"item_id": 1, "text": "word License the"}, {"item_id": None, "text": None}])
    for k, n in (("full", None), ("none", 0)):
        (d / k).mkdir()
        for name, t in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            pq.write_table(t.slice(0, n), d / k / f"{name}.parquet")
    return d


def place(odd, at):
    return SF if at == "sf" else str(odd / at)


def table(odd, at, name):
    return pq.read_table(f"{place(odd, at)}/{name}.parquet").to_pylist()


def fails(docs):
    """The five filters' verdicts of each row."""
    first = {}
    for r in docs:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            first[t] = min(first.get(t, r["doc_id"]), r["doc_id"])
    out = []
    for r in docs:
        t = r["text"] or ""
        w = WORD.findall(t)
        out.append((len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), r["doc_id"] is not None and r["doc_id"] > first[t]))
    return out


@pytest.mark.parametrize("at", PLACES)
def test_op11(spark, odd, at):
    docs, labels = table(odd, at, "documents"), table(odd, at, "labels")
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    parts = defaultdict(list)
    for r, f in zip(docs, fails(docs)):
        parts[r["lang"] or ""].append((r["doc_id"], f))
    want = []
    for part, rows in parts.items():
        removed_in = Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = list(rows)
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                hit = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                removed_in[letter] += len(hit)
                failing = sum(x[1][k] for x in rows)
                lines.append((part, "".join(order), step, len(left), len(hit), failing - len(hit), sum(x[1][k] and sum(x[1]) == 1 for x in rows), sum(x[0] in good for x in hit), sum(x[0] in toxic for x in hit)))
        want += [(*x, removed_in[x[1][x[2] - 1]]) for x in lines]
    got = entries.op11_filter_audit(spark, place(odd, at))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_audit_sends_sums(spark):
    """A group of copies is summed before it is shuffled: the last shuffles carry a row for each text, part and mask."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text"), F.lit("en").alias("lang"))
    cells = {r["mask"]: (r["n"], r["n_good"], r["n_toxic"]) for r in audit.cells(docs, spark.createDataFrame([(5, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
    assert cells == {1: (1, 1, 0), 17: (1999, 1, 1)}


def drawn_plainly(docs, bench, buckets=10_000, share=10, least=20, width=1):
    def features(text):
        w = PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for r in x for f in features(r["text"])[1]) for x in (docs, bench))
    n_s, n_t = sum(s.values()), sum(t.values())
    rows = []
    for r in docs:
        words, own = features(r["text"])
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"2024:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        rows.append((r["doc_id"], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    take = len(able) * share // 100
    return [(*r[:4], k) for k, r in enumerate(able[:take], 1)] + [(*r[:4], None) for r in able[take:] + [r for r in rows if not r[4]]]


@pytest.mark.parametrize("at", PLACES)
def test_op12(spark, odd, at):
    got = entries.op12_resample(spark, place(odd, at))
    assert [c[1] for c in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(drawn_plainly(table(odd, at, "documents"), table(odd, at, "benchmark")), key=str)


def test_resample_pairs_and_shares(spark, odd):
    """Two-word features, another number of buckets, everything drawn and nothing drawn."""
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    for share in (0, 37, 100):
        want = drawn_plainly(table(odd, "sf", "documents"), table(odd, "sf", "benchmark"), 512, share, 5, 2)
        got = resample.resample(docs, bench, buckets=512, width=2, share=share, least_words=5)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_draw_over_many_runs_and_ties(spark, monkeypatch):
    """Small runs and ranges, scores that many rows share, null ids: ranks are those of one sort."""
    monkeypatch.setattr(resample, "RUN_ROWS", 50)
    monkeypatch.setattr(resample, "RANGE_ROWS", 40)
    rows = [(None if k % 50 == 7 else k, k % 5, k % 3, k * 7919 % 11 if k % 3 else 5) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(13)
    order = sorted((r for r in rows if r[1] > 0), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for draw in (1, 700, len(order)):
        got = resample.drawn(df, draw, F.col("n_features") > 0, len(order)).collect()
        assert len(got) == len(rows)
        ranked = sorted((r["rank"], r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got if r["rank"])
        assert [r[0] for r in ranked] == list(range(1, draw + 1))
        assert [r[1:] for r in ranked] == order[:draw]


def test_tournament():
    runs = [[3, 4, 9], [], [1, 4, 4], [2], [7, 8]]
    game = resample.Tournament([iter([(x,) for x in r]) for r in runs])
    first = [next(iter(game))[0] for _ in range(4)]
    assert first == [1, 2, 3, 4] and sorted(x[0] for x in game.rest()) == [4, 4, 7, 8, 9]
    assert list(resample.Tournament([])) == [] and [x[0] for x in resample.Tournament([iter([(x,) for x in r]) for r in runs])] == sorted(sum(runs, []))


def scanned_plainly(text, rules):
    w = PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = " " + " ".join(w) + " "
    starts, at = {}, 1
    for i, x in enumerate(w):
        starts[at] = i
        at += len(x) + 1
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?=({r.regex}) )", line):
            a = starts[m.start()]
            found.append((a, a + m[1].count(" "), r.priority, k, r.label, r.confidence))
    held = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[1] - e[0] > d[1] - d[0] or e[2:4] < d[2:4])
    near = defaultdict(list)
    for e in found:
        near[e[0] // 64].append(e)
    return len(w), [d for d in found if d[2] == 0 or not any(held(d, e) for c in (d[0] // 64 - 1, d[0] // 64) for e in near[c])]


@pytest.mark.parametrize("at", PLACES)
def test_op13(spark, odd, at):
    want = []
    for r in table(odd, at, "documents"):
        n, kept = scanned_plainly(r["text"], licenses.RULES)
        base = [d for d in kept if d[2] == 0]
        join = lambda x: ",".join(sorted({d[4] for d in x}))
        want.append((r["doc_id"], n, len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), join(base), join(kept), max((d[5] for d in kept), default=0.0)))
    got = entries.op13_licenses(spark, place(odd, at))
    assert [c[1] for c in got.dtypes] == ["bigint"] * 5 + ["string"] * 2 + ["double"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_license_labels(spark):
    """What the rules say of plain statements, and that the gate and the other columns change nothing."""
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2+",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc,cc-by-nc-4",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 or later": "lgpl-2-1+",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "Mozilla Public License Version 2.0 and the Creative Commons Attribution-ShareAlike 3.0": "cc-by-sa-3,mpl-2",
        "distributed under the Apache Licence v2.0": "apache-2",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "she sat on the mit table and read about apache people": "",
        "the license was lost": "",
    }
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(cases)], "doc_id long, text string, `a.b` int")
    rows = licenses.scanned(docs)
    assert rows.columns == ["doc_id", "text", "a.b", "n_words", "detections"]
    assert [r["labels"] for r in licenses.digest(rows).orderBy("doc_id").collect()] == list(cases.values())
    # without the gate each of the rules runs over each text
    some = [r for r in licenses.RULES if r.label in ("gpl-3", "gpl", "mit", "apache-2", "cc-by-nc", "cc-by-nc-4", "gpl-2+")]
    a, b = (sorted(map(str, licenses.scanned(docs, some, gated=g).select("doc_id", "detections").collect())) for g in (True, False))
    assert a == b


def test_every_rule_has_its_needed_words():
    """What a rule needs is in each of its matches, seen on one match built from the pattern."""
    assert len(licenses.RULES) > 300
    for r in licenses.RULES:
        text = r.regex.replace("licen[sc]e", "license")
        for _ in range(9):
            text = re.sub(r"\(\?:[^()]*\)(?:\?|\{0,3\}\??)", "", text)  # what may be absent is
            text = re.sub(r"\(\?:([^()|]*)\|[^()]*\)(?![?{])", r"(?:\1)", text)  # the first alternative
            text = re.sub(r"\(\?:([^()|]*)\)(?:\{1,12\})?(?![?{])", r"\1", text)
        text = re.sub(r".\?", "", text.replace("[^ ]+", "word").replace("[0-9]", "4").replace("[01]", "0"))
        assert re.fullmatch(r.regex, text), (r.regex, text)
        assert set(r.needs) <= set(text.split()), (r, text)
        assert set(r.needs) - licenses._COMMON, r
