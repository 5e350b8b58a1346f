"""The deep search: each query reads its ranked documents one after the other until a rule stops it, corrects itself and widens.

Documents are scored for all queries in one pass; the loop is a fold over each query's few scored documents, inside the
JVM. What self-correction asks in addition is known after the fold and is scored in a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import evidence as ev
from .evidence import KEEP, let

#: A window of this score ends the loop once all facts are covered; one of KEEP does when the budget is at risk.
STRONG, RISK = 8.0, 0.6
FILES, CORRECTIONS, WIDENINGS, TOKENS = 4, 2, 3, 27_000
#: Bytes of scored text that cost about a token.
BYTES_A_TOKEN = 4
_STATE = "struct<loops: int, best: double, best_doc: bigint, covered: array<boolean>, kept: int, total: double, hits: array<boolean>, spent: bigint, p: double, flat: int, reason: string, tried: array<bigint>, widened: int, corrected: int>"


def _read(asked: Column, tokens: Column, facts: Column, body: Column) -> Column:
    """What reading a text for the tokens ``asked`` gives: best score, windows of KEEP or more with their scores' sum, the facts and tokens they hold, the cost."""

    def of(windows: Column) -> Column:
        texts = F.transform(windows, lambda w: F.struct(w["score"].alias("score"), ev.slice_of(body, w["start"], w["end"]).alias("text")))

        def found(texts: Column) -> Column:
            good = F.filter(texts, lambda w: w["score"] >= KEEP)

            def parts(good: Column) -> Column:
                low = F.transform(good, lambda w: F.lower(w["text"]))
                covers = lambda f, w: (F.coalesce(F.try_divide(tx.hits(f["tokens"], F.lower(w["text"])).cast("double"), F.size(f["tokens"]).cast("double")), F.lit(0.0)) >= 0.5) & ev.core_present(f["fact"], w["text"])
                return F.struct(
                    F.coalesce(F.array_max(F.transform(texts, lambda w: w["score"])), F.lit(0.0)).alias("best"), F.size(good).alias("kept"), F.aggregate(good, F.lit(0.0), lambda s, w: s + w["score"]).alias("total"),
                    F.transform(facts, lambda f: F.exists(good, lambda w: covers(f, w))).alias("covered"), let(low, lambda low: F.transform(tokens, lambda t: F.exists(low, lambda x: F.contains(x, t)))).alias("hits"),
                    F.aggregate(texts, F.lit(0).cast("long"), lambda s, w: s + F.ceil(F.octet_length(w["text"]) / BYTES_A_TOKEN)).alias("cost"),
                )

            return let(good, parts)

        return let(texts, found)

    return let(ev.evidence_windows(asked, body), of)


def _joined(s: Column, x: Column, doc: Column, **more: Column) -> Column:
    """The state after reading x of a document."""
    best = x["best"] > s["best"]
    either = lambda a, b: F.zip_with(a, b, lambda p, q: p | q)
    own = {
        "loops": s["loops"] + 1, "best": F.greatest(s["best"], x["best"]), "best_doc": F.when(best, doc).otherwise(s["best_doc"]), "covered": either(s["covered"], x["covered"]), "kept": s["kept"] + x["kept"], "total": s["total"] + x["total"],
        "hits": either(s["hits"], x["hits"]), "spent": s["spent"] + x["cost"], "p": s["p"], "flat": s["flat"], "reason": s["reason"], "tried": F.array_union(s["tried"], F.array(doc)), "widened": s["widened"], "corrected": s["corrected"],
    } | more
    return F.struct(*[v.alias(k) for k, v in own.items()]).cast(_STATE)


def _with(s: Column, **changed: Column) -> Column:
    names = [x.split(":")[0].strip() for x in _STATE[7:-1].split(", ")]
    return F.struct(*[changed.get(n, s[n]).alias(n) for n in names]).cast(_STATE)


def _complete(s: Column) -> Column:
    return F.forall(s["covered"], lambda c: c)


def _confidence(s: Column) -> Column:
    mean = F.when(s["kept"] > 0, s["total"] / F.greatest(s["kept"], F.lit(1))).otherwise(0.0)
    cover = F.coalesce(F.try_divide(F.size(F.filter(s["hits"], lambda h: h)).cast("double"), F.size(s["hits"]).cast("double")), F.lit(0.0))
    return tx.confidence(mean, cover)


def deep_search(queries: DataFrame, docs: DataFrame, index, files: int = FILES, corrections: int = CORRECTIONS, widenings: int = WIDENINGS, tokens: int = TOKENS, early: float | None = None) -> DataFrame:
    """One row for each query (item_id, query, tokens) that finds a document: how its search went and why it stopped.

    The ranked documents are read in order. Before each: all facts covered and a window of STRONG, or of KEEP once RISK of
    the tokens is spent, stops (sufficient); so do ``files`` read, or the tokens spent (budget). With ``early``, the
    abstain head's probability of failure at or over it for two rounds in which it doesn't fall stops too (utility). An
    empty reason: the documents ran out. Unless utility stopped it, a search with facts left open asks for them, the
    first first, in ``corrections`` documents, unread ones before read ones; and while facts are open or no window reaches
    KEEP, up to ``widenings`` unread documents of the ranking are read. No more than one document is read beyond the tokens.
    A query without tokens or without a match has no row.

    Columns: item_id, loops, widened, corrected (documents asked again), stop, complete, missing (facts), best, best_doc,
    kept (windows), tokens (spent), confidence (at most 0.45 with facts open).
    """
    deep = files + corrections + widenings
    facts = F.transform(ev.decompose(F.col("query")), lambda f: F.struct(f.alias("fact"), tx.fields(f).alias("tokens")))
    asked = queries.select("item_id", "query", F.array_distinct("tokens").alias("tokens"), facts.alias("facts"))
    ranked = index.rank(queries, deep).select("item_id", "doc_id", "rnk")
    body = docs.select("doc_id", F.coalesce("body", F.lit("")).alias("body"))
    r = asked.join(ranked, "item_id").join(body, "doc_id")
    r = r.select("item_id", F.struct("rnk", F.col("doc_id").cast("long").alias("doc"), _read(F.col("tokens"), F.col("tokens"), F.col("facts"), F.col("body")).alias("x")).alias("file"))
    s = r.groupBy("item_id").agg(F.array_sort(F.collect_list("file")).alias("files")).join(asked, "item_id")  # ``deep`` documents at most
    no = lambda of: F.transform(of, lambda _: F.lit(False))
    start = {"loops": F.lit(0), "best": F.lit(-1.0), "best_doc": F.lit(None), "covered": no("facts"), "kept": F.lit(0), "total": F.lit(0.0), "hits": no("tokens"), "spent": F.lit(0), "p": F.lit(0.0), "flat": F.lit(0), "reason": F.lit(""), "tried": F.array().cast("array<bigint>"), "widened": F.lit(0), "corrected": F.lit(0)}
    begin = F.struct(*[v.alias(k) for k, v in start.items()]).cast(_STATE)
    missing = lambda s: F.size(F.filter(s["covered"], lambda c: ~c))

    def step(s: Column, f: Column) -> Column:
        stop = F.when(_complete(s) & ((s["best"] >= STRONG) | (s["best"] >= KEEP) & (s["spent"] >= RISK * tokens)), "sufficient").when((s["loops"] >= files) | (s["spent"] >= tokens), "budget").otherwise("")
        return F.when(s["reason"] != "", s).when(stop != "", _with(s, reason=stop)).otherwise(read(s, f))

    def read(s: Column, f: Column) -> Column:
        after = _joined(s, f["x"], f["doc"])
        if early is None:
            return after

        def judged(a: Column) -> Column:
            p, _ = ev.abstain(F.length("query"), F.size("files"), a["kept"], a["best"], missing(a), _confidence(a), a["kept"] == 0, F.lit(False))
            flat = F.when((p >= early) & (p >= a["p"]), a["flat"] + 1).otherwise(0)
            return F.when(a["loops"] < 2, a).otherwise(_with(a, p=p, flat=flat, reason=F.when(flat >= 2, "utility").otherwise(a["reason"])))

        return let(after, judged)

    s = s.withColumn("s", F.aggregate("files", begin, step))
    open_ = (F.col("s.reason") != "utility") & ~_complete(F.col("s")) & (F.col("s.spent") < tokens)
    every = F.transform("files", lambda f: f["doc"])
    order = F.concat(F.array_except(every, F.col("s.tried")), F.filter(every, lambda d: F.array_contains(F.col("s.tried"), d)))
    gaps = F.filter(F.transform("facts", lambda f, i: F.when(~F.get(F.col("s.covered"), i), f["tokens"])), lambda t: t.isNotNull())
    tries = F.slice(F.flatten(F.transform(gaps, lambda t: F.transform(order, lambda d: F.struct(t.alias("asked"), d.alias("doc"))))), 1, corrections)
    again = s.where(open_).select("item_id", "tokens", "facts", F.posexplode(tries).alias("turn", "try")).withColumn("doc", F.col("try.doc")).join(body.select(F.col("doc_id").cast("long").alias("doc"), "body"), "doc")
    again = again.select("item_id", F.struct("turn", "doc", _read(F.col("try.asked"), F.col("tokens"), F.col("facts"), F.col("body")).alias("x")).alias("file"))
    again = again.groupBy("item_id").agg(F.array_sort(F.collect_list("file")).alias("again"))  # ``corrections`` at most
    s = s.join(again, "item_id", "left").withColumn("again", F.coalesce("again", F.array().cast(again.schema["again"].dataType)))
    s = s.withColumn("s", F.aggregate("again", F.col("s"), lambda s, f: F.when(s["spent"] >= tokens, s).otherwise(_joined(s, f["x"], f["doc"], corrected=s["corrected"] + 1))))
    wide = (F.col("s.reason") != "utility") & (F.col("s.spent") < tokens) & (~_complete(F.col("s")) & (F.col("s.loops") < deep) | (F.col("s.best") < KEEP) & (F.col("s.spent") < RISK * tokens))
    unread = F.slice(F.filter("files", lambda f: ~F.array_contains(F.col("s.tried"), f["doc"])), 1, widenings)
    more = F.when(wide, unread).otherwise(F.slice("files", 1, 0))
    s = s.withColumn("s", F.aggregate(more, F.col("s"), lambda s, f: F.when(s["spent"] >= tokens, s).otherwise(_joined(s, f["x"], f["doc"], widened=s["widened"] + 1))))
    conf, done = _confidence(F.col("s")), _complete(F.col("s"))
    return s.select(
        "item_id", "s.loops", "s.widened", "s.corrected", F.col("s.reason").alias("stop"), done.alias("complete"), missing(F.col("s")).alias("missing"), F.round("s.best", 6).alias("best"), "s.best_doc", "s.kept", F.col("s.spent").alias("tokens"),
        F.when(done, conf).otherwise(F.least(conf, F.lit(0.45))).alias("confidence"),
    )
