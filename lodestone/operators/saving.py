"""Saving answers: what becomes of each answer, given the cluster that the answers before it left of its topic.

An answer has answer_id (string), at (its place in time, a long), query, summary, source, confidence, refused, replace and
evidence, windows (source, start, end, content). Answers of a topic are folded one after the other, in a batch or as they
come in a stream, by the same function; topics never wait for each other. Near clusters of other topics are folded by
folding.tidy.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .folding import QUERIES_KEPT
from .knowledge import GATE, MERGE

#: What a window's source says when it is a way of sampling instead of a document; fixed values.
METHODS = ("", "full", "stratified", "fuzz", "gaussian", "global")
_OUT = "kind string, topic string, answer_id string, route string, version int, confidence double, n_evidence int, queries array<string>, content string, evidence array<struct<source: string, start: int, end: int, content: string>>"
_READY = ("topic", "at", "answer_id", "query", "tokens", "stripped", "summary", "confidence", "refused", "replace", "windows")


def admitted(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """answers made ready for saving: topic, tokens of the query, whether they are refused, and their windows with pinned.

    Refused are those that say so, those without a source, and those whose query the evidence (the summary, if no window
    has a text) covers by less than GATE. pinned: docs (source, body) still reads so at the window. A null query or
    summary is empty, null evidence no window, a null confidence 0, null flags no.
    """
    blank = F.lit("")
    a = answers.select(
        "answer_id", F.col("at").cast("long").alias("at"), F.coalesce("query", blank).alias("query"), F.coalesce("summary", blank).alias("summary"), F.coalesce(F.col("source").cast("string"), blank).alias("source"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("refused", F.lit(False)).alias("refused"), F.coalesce("replace", F.lit(False)).alias("replace"), F.coalesce("evidence", F.array().cast(answers.schema["evidence"].dataType)).alias("evidence"),
    )
    own = F.transform("evidence", lambda e: F.struct(F.when(F.coalesce(e["source"].cast("string"), blank).isin(*METHODS), F.col("source")).otherwise(e["source"].cast("string")).alias("source"), e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), F.coalesce(e["content"], blank).alias("content")))
    a = a.withColumn("evidence", own)
    said = F.array_join(F.filter(F.transform("evidence", lambda e: e["content"]), lambda x: F.trim(x) != ""), "\n")
    surface = F.when(said != "", said).otherwise(F.col("summary"))
    a = a.withColumns({"topic": tx.topic_key(F.col("query")), "tokens": tx.fields(F.col("query")), "stripped": F.trim(F.regexp_replace("query", tx.ASKING, ""))})
    a = a.withColumn("refused", F.col("refused") | (F.col("source") == "") | (tx.coverage(F.col("tokens"), surface) < GATE))
    w = a.select("answer_id", F.posexplode("evidence").alias("pos", "w")).withColumn("from", F.col("w.source"))
    w = w.join(docs.select(F.col("source").cast("string").alias("from"), "body"), "from", "left")
    right = (F.col("w.start") >= 0) & (F.col("w.start") < F.col("w.end")) & (F.col("w.end") <= F.length("body")) & (F.substring(F.col("body"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")) == F.col("w.content"))
    w = w.select("answer_id", F.struct("pos", F.col("w.source").alias("source"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.content").alias("content"), F.coalesce(right, F.lit(False)).alias("pinned")).alias("w"))
    w = w.groupBy("answer_id").agg(F.array_sort(F.collect_list("w")).alias("windows"))  # an answer's windows
    a = a.join(w, "answer_id", "left").withColumn("windows", F.to_json(F.coalesce("windows", F.array().cast(w.schema["windows"].dataType))))
    return a.select(*_READY)


def fresh() -> dict[str, Any]:
    """A topic without a cluster."""
    return {"version": 0, "queries": [], "keys": [], "content": "", "evidence": [], "confidence": 0.0, "hotness": 0.5, "lifecycle": "emerging"}


def _key(w: dict) -> list:
    return [w["source"], w["start"], w["end"]]


def _evolve(c: dict[str, Any], a: dict[str, Any]) -> None:
    """The query joins the last five; its wordings stay as keys."""
    if a["query"] not in c["queries"]:
        c["queries"] = [*c["queries"], a["query"]][-QUERIES_KEPT:]
        for k in (a["query"].strip(), a["stripped"]):
            if k and k not in c["keys"]:
                c["keys"].append(k)
    c["hotness"] = min(1.0, c["hotness"] + 0.1)
    c["version"] += 1


def save(c: dict[str, Any], a: dict[str, Any]) -> str:
    """The cluster c of a topic after answer a; says what was done: refuse, new, merge, replace or evolve.

    replace: on demand, or because a window of the cluster no longer reads as it did; the answer's content, confidence
    and evidence take the place of the cluster's. merge: contents one after the other with citations renumbered, mean
    confidence, evidence united. evolve: the query is kept alone, because no key of the cluster covers it.
    """
    if a["refused"]:
        return "refuse"
    windows = json.loads(a["windows"])
    if not c["version"]:
        first = next((x.strip() for x in a["summary"].split("\n") if x.strip()), "")[:80]
        anchor = next((w["content"].strip()[:80] for w in windows if w["content"]), "")
        c["keys"] = [k for k in dict.fromkeys((a["query"].strip()[:80], a["stripped"][:80], anchor, first)) if k]
        c |= {"version": 1, "queries": [a["query"]], "content": a["summary"], "evidence": windows, "confidence": a["confidence"]}
        return "new"
    near = 0.0
    if n := len(a["tokens"]):
        near = max(sum(t in text.lower() for t in a["tokens"]) / n for text in [*c["keys"], *c["queries"]])
    if near < MERGE and not a["replace"]:
        _evolve(c, a)
        return "evolve"
    stale = any(not w["pinned"] for w in c["evidence"])
    _evolve(c, a)
    if a["replace"] or stale:
        c |= {"content": a["summary"], "confidence": a["confidence"], "evidence": windows}
        if stale:
            c["lifecycle"] = "emerging"
        return "replace"
    places = [_key(w) for w in c["evidence"]]
    landing = {}
    for i, w in enumerate(windows, 1):
        if _key(w) not in places:
            places.append(_key(w))
            c["evidence"].append(w)
        landing[i] = places.index(_key(w)) + 1
    c["content"] += "\n---\n" + re.sub(r"\[([0-9]+)\]", lambda m: f"[{landing.get(int(m[1]), m[1])}]", a["summary"])
    c["confidence"] = (c["confidence"] + a["confidence"]) / 2
    return "merge"


def _row(kind: str, topic: str, c: dict[str, Any], answer: str | None = None, route: str | None = None) -> tuple:
    whole = kind == "cluster"
    return kind, topic, answer, route, c["version"], c["confidence"], len(c["evidence"]), c["queries"] if whole else None, c["content"] if whole else None, [(w["source"], w["start"], w["end"], w["content"]) for w in c["evidence"]] if whole else None


def _frame(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["kind", "topic", "answer_id", "route", "version", "confidence", "n_evidence", "queries", "content", "evidence"])


def saved(ready: DataFrame) -> DataFrame:
    """The fold of admitted() answers: a row of kind answer for each, with its route and the cluster's version, confidence and number of windows after it, and a row of kind cluster for each topic's last state.

    Answers are folded by at, then answer_id; the rows of a partition come sorted, so a topic of any length is folded
    with one cluster in memory. No answers, no rows; a topic whose answers were all refused has no cluster.
    """

    def run(batches: Iterator) -> Iterator:
        topic, c = None, fresh()
        for pdf in batches:
            out = []
            for a in pdf.to_dict("records"):
                if a["topic"] != topic:
                    if c["version"]:
                        out.append(_row("cluster", topic, c))
                    topic, c = a["topic"], fresh()
                route = save(c, a)
                out.append(_row("answer", topic, c, a["answer_id"], route))
            yield _frame(out)
        if c["version"]:
            yield _frame([_row("cluster", topic, c)])

    return ready.repartition("topic").sortWithinPartitions("topic", "at", "answer_id").mapInPandas(run, _OUT)


def saved_stream(ready: DataFrame) -> DataFrame:
    """The same fold over a stream of admitted() answers, a topic's cluster kept as state between batches: rows of kind answer.

    Answers of a topic are expected in the order of at from batch to batch; within a batch they are sorted.
    """

    def run(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        c = json.loads(state.get[0]) if state.exists else fresh()
        rows = pd.concat(list(batches)).sort_values(["at", "answer_id"])  # a topic's answers of one batch
        out = [_row("answer", key[0], c, a["answer_id"], save(c, a)) for a in rows.to_dict("records")]
        state.update((json.dumps(c),))
        yield _frame(out)

    return ready.groupBy("topic").applyInPandasWithState(run, _OUT, "cluster string", "append", "NoTimeout")


def windows_of(source: Column, start: Column, content: Column) -> Column:
    """One window as evidence."""
    return F.array(F.struct(source.cast("string").alias("source"), start.cast("int").alias("start"), (start + F.length(content)).cast("int").alias("end"), content.alias("content")))
