"""Evaluation, calibration, guardrails, monitoring and the usage ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exact_rank(rows: DataFrame, keys: list[str], value: str, numerator: int, denominator: int, name: str) -> DataFrame:
    """(keys, name): the value at index n * numerator / denominator of the sorted values, 0-based, from counts of distinct values and a running sum over them."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys)
    c = c.withColumns({"_to": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    at = F.floor(F.col("_n") * numerator / denominator)
    return c.where((F.col("_to") > at) & (F.col("_to") - F.col("_c") <= at)).select(*keys, F.col(value).alias(name))


def is_correct(answer: Column, gold: Column) -> Column:
    """Equal but for case and blanks; a number must stand alone in the answer, any other text be contained."""
    a, g = F.lower(F.trim(answer)), F.lower(F.trim(gold))
    alone = F.concat(F.lit("(^|[^0-9])"), g, F.lit("([^0-9]|$)"))
    return (a == g) | F.when(g.rlike("^[0-9]+$"), F.regexp_like(a, alone)).otherwise((g != "") & F.contains(a, g))


def canonical(key: Column) -> Column:
    """A source key without src: and its last #version."""
    return F.regexp_replace(key, "^src:|#[^#]*$", "")


def taxonomy(correct: Column, evidence: Column, grounded: Column) -> Column:
    return F.when(correct & evidence, "correct").when(correct, "lucky").when(evidence, "misread").when(grounded, "wrong_source").otherwise("not_retrieved")


def summarize(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means of correct, ev_rec and grounded over rows that have them; null, not 0, where none has."""
    m = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), m("correct"), m("ev_rec"), m("grounded"), F.count("correct").alias("judged"))


def bands(rows: DataFrame, width: float = 0.05) -> DataFrame:
    """(band, n, correct) by confidence; plain double division, cut to the first and last band."""
    last = round(1 / width) - 1
    idx = F.least(F.greatest(F.floor(F.col("conf") / F.lit(width)), F.lit(0)), F.lit(last)).cast("int")
    return rows.groupBy(idx.alias("band")).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


def propose(bands_: DataFrame, least: int = 10, rate: float = 0.9, width: float = 0.05) -> DataFrame:
    """The highest suffix of bands with enough rows at the rate: (band, n, correct, line); no row if there is none."""
    w = W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, 0)  # at most 1 / width rows
    s = bands_.select("band", F.sum("n").over(w).alias("n"), F.sum("correct").over(w).alias("correct"))
    return s.where((F.col("n") >= least) & (F.col("correct") / F.col("n") >= rate)).orderBy(F.desc("band")).limit(1).withColumn("line", F.round(F.col("band") * width, 6))


def decide(base: DataFrame, trial: DataFrame, key: str, gain: int = 2, ratio: float = 1.05) -> DataFrame:
    """Paired runs (key, correct, tokens): gained, token ratio, accept."""
    p = base.select(key, F.col("correct").alias("c0"), F.col("tokens").alias("t0")).join(trial.select(key, F.col("correct").alias("c1"), F.col("tokens").alias("t1")), key)
    r = p.agg(F.count("*").alias("n"), (F.count_if("c1") - F.count_if("c0")).alias("gained"), F.round(F.try_divide(F.sum("t1"), F.sum("t0")), 6).alias("ratio"))
    return r.withColumn("accept", (F.col("gained") >= gain) & (F.col("ratio") <= ratio))


def mcnemar(base: DataFrame, trial: DataFrame, key: str) -> DataFrame:
    """(b, c, p): discordant pairs joined by key and the exact two-sided binomial p, at most 1."""
    p = base.select(key, F.col("correct").alias("x")).join(trial.select(key, F.col("correct").alias("y")), key)
    r = p.agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    # log-space terms: ln C(n, i) grows step by step
    steps = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.struct(F.lit(0.0).alias("ln"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a["ln"] + F.when(i == 0, 0.0).otherwise(F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double")))).alias("ln"), (a["s"] + F.exp(a["ln"] + F.when(i == 0, 0.0).otherwise(F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double"))) - n * F.log(F.lit(2.0)))).alias("s")))
    return r.withColumn("p", F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * steps["s"]), 6)))


def guardrail(base: DataFrame, now: DataFrame, rec: float = 0.85, tok: float = 1.15, lat: float = 1.30) -> DataFrame:
    """One row of metrics (n, ev_rec, tokens, p90) against another's: which limits hold."""
    b, c = (x.select(*[F.col(k).alias(f"{p}_{k}") for k in ("n", "ev_rec", "tokens", "p90")]) for x, p in ((base, "b"), (now, "c")))
    r = b.crossJoin(c)  # one row each
    ok_rec = F.when((F.col("b_n") > 0) & (F.col("b_ev_rec") > 0), F.col("c_ev_rec") / F.col("c_n") >= F.col("b_ev_rec") / F.col("b_n") * rec).otherwise(True)
    ok_tok = F.coalesce(F.try_divide(F.col("c_tokens"), F.col("b_tokens")), F.lit(1.0)) <= tok
    ok_lat = F.coalesce(F.try_divide(F.col("c_p90"), F.col("b_p90")), F.lit(1.0)) <= lat
    return r.select(ok_rec.alias("ev_rec_ok"), ok_tok.alias("tokens_ok"), ok_lat.alias("latency_ok"), ((F.col("c_n") > 0) & ok_rec & ok_tok & ok_lat).alias("pass"))


def compare_runs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each item of two runs: improved, regressed, same, added or removed."""
    x, y = a.select(F.col(key), F.col("correct").alias("x")), b.select(F.col(key), F.col("correct").alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("x") & F.col("y"), "improved").when(F.col("x") & ~F.col("y"), "regressed").otherwise("same")
    return x.join(y, key, "full").select(key, change.alias("change"))


def record(ledger: DataFrame, uses: DataFrame, top: int = 60) -> DataFrame:
    """The ledger (token, doc_id, score, hits, last) with uses added: sums, counts and latest; the best 60 documents of each token."""
    both = ledger.unionByName(uses).groupBy("token", "doc_id").agg(F.sum("score").alias("score"), F.sum("hits").alias("hits"), F.max("last").alias("last"))
    w = W.partitionBy("token").orderBy(F.desc("score"), "doc_id")
    return both.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= top).drop("rnk")


def ledger_weights(queries: DataFrame, ledger: DataFrame, now: Column, half_days: float = 21.0, most: int = 24) -> DataFrame:
    """(item_id, doc_id, weight): a query's first 24 distinct tokens' documents, decayed by age, relative to the token's best.

    Only the queries' tokens are taken from the ledger; a token's best is a sum-like maximum, so the commonest one isn't one task's.
    """
    q = queries.select("item_id", F.explode(F.slice(F.array_distinct("tokens"), 1, most)).alias("token"))
    ledger = ledger.join(q.select("token").distinct(), "token", "left_semi")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86_400_000_000
    d = ledger.withColumn("w", F.col("score") * F.pow(F.lit(2.0), -age / half_days))
    best = d.groupBy("token").agg(F.max("w").alias("best"))
    d = d.join(best, "token").withColumn("w", F.col("w") / F.col("best")).where(F.col("w").isNotNull())
    return q.join(d.select("token", "doc_id", "w"), "token").groupBy("item_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("weight"))


#: Fixed values of the intent rules.
GREETINGS = ["hello", "hi", "thanks"]
CJK_GREETINGS = "你好|您好|在吗|谢谢|再见|拜拜"
DOC_VERB = r"^(请|帮我|给我)?(总结|概括|通读|翻译)|^(please\s+)?(summarize|summarise|translate|recap)"
DOC_SCOPE = "全文|整篇|整份|这份|文档|一下|the whole|this (doc|document|file)|this"


def intent(query: Column) -> Column:
    """chat, doc_summary or search by the short query's shape."""
    q = F.trim(F.lower(query))
    words = F.split(q, r"[^\p{L}\p{N}]+")
    chat = (q != "") & (F.length(q) <= 8) & (F.exists(words, lambda w: w.isin(GREETINGS)) | q.rlike(CJK_GREETINGS))
    return F.when(chat, "chat").when((F.length(F.trim(query)) <= 16) & q.rlike(DOC_VERB) & q.rlike(DOC_SCOPE), "doc_summary").otherwise("search")


def validate(items: DataFrame, gold: DataFrame, sources: DataFrame, longest: int = 200) -> DataFrame:
    """(item_id, problem): empty fields, repeated ids, gold that names no source, passages that are too long to be questions."""
    empty = items.where((F.trim(F.coalesce("query", F.lit(""))) == "")).select("item_id", F.lit("empty").alias("problem"))
    twice = items.groupBy("item_id").count().where("count > 1").select("item_id", F.lit("duplicate").alias("problem"))
    lost = gold.join(sources, "doc_id", "left_anti").select("item_id", F.lit("unresolved").alias("problem")).distinct()
    long = items.where(F.length("query") > longest).select("item_id", F.lit("long").alias("problem"))
    return empty.unionByName(twice).unionByName(lost).unionByName(long)


def grid(pairs: DataFrame, score: str, relevant: str, thresholds: list[float]) -> DataFrame:
    """For each threshold: hits, kept, precision and recall of scored pairs."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("theta")
    r = pairs.select(t, F.col(score).alias("s"), F.col(relevant).alias("r")).groupBy("theta").agg(F.count_if(F.col("s") >= F.col("theta")).alias("kept"), F.count_if((F.col("s") >= F.col("theta")) & F.col("r")).alias("hits"), F.count_if("r").alias("relevant"))
    return rates(r)


def rates(counts: DataFrame) -> DataFrame:
    """counts (theta, kept, hits, relevant) with precision and recall."""
    return counts.select("theta", "kept", "hits", F.round(F.coalesce(F.try_divide("hits", "kept"), F.lit(0.0)), 3).alias("precision"), F.round(F.coalesce(F.try_divide("hits", "relevant"), F.lit(0.0)), 3).alias("recall"))


def reliability(scores: DataFrame, key: str, line: float) -> DataFrame:
    """Mean and spread of repeated scores, and whether all lie on one side of the line."""
    side = F.col("score") >= line
    return scores.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("spread"), (F.bool_and(side) | ~F.bool_or(side)).alias("stable"))
