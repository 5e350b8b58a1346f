"""Evidence: windows over texts, their scores, merging, facts, citations and the fast and deep answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import kept_table

WINDOW, WHOLE, LARGE, KEEP, BUDGET = 480, 100_000, 15_000, 4.0, 15_000

#: Where a compound question is cut, and what licenses or forbids a list of requirements.
CUTS = ["以及", "并且", "同时", "另外", "此外", "相比", "对比", "还是", "或者", "和", "与", "及", " and ", " and/or ", " or ", " vs ", " versus ", " compared ", "；", ";"]
SINGLE = ["和", "与", "及"]
COORDINATION = ["分别", "各自", "以及", "同时", "还有", "此外", "另外"]
ALTERNATIVE = ["或者", "或是", "还是", "或则"]
OPENING, CLOSING, AMBIGUOUS = "《〈（([【{“‘", "》〉）)]】}”’", "\"'"


def window_at(centre: Column, length: Column, half: int = WINDOW // 2) -> tuple[Column, Column]:
    """start and end of a window around a centre, clamped to the text."""
    c = F.greatest(F.lit(0), F.least(centre, length))
    return F.greatest(F.lit(0), c - half), F.least(length, c + half)


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def densest_start(tokens: Column, text: Column, size: int) -> Column:
    """Where the window of so many characters begins that holds the most distinct tokens, by quarters of a window (ties: the earliest); the text's case is kept."""
    own = F.array_distinct(tokens)
    found = lambda s: F.size(F.filter(own, lambda t: F.contains(F.substring(text, s + 1, F.lit(size)), t)))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - size, F.lit(0)), F.lit(size // 4))
    best = F.array_max(F.transform(starts, lambda s: F.struct(found(s).alias("hits"), (-s).alias("at"))))
    return -best["at"]


def whole_file(pairs: DataFrame, tokens: str, text: str) -> DataFrame:
    """pairs with start and end of the one window of texts up to 100,000 characters: all, or the densest 15,000. Longer texts are sampled()'s."""
    n, long = F.length(text), F.length(text) > LARGE
    start = F.when(long, densest_start(F.col(tokens), F.col(text), LARGE)).otherwise(0)
    return pairs.where(n <= WHOLE).withColumns({"start": start, "end": F.when(long, start + LARGE).otherwise(n)})


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


ARMS = ("lex", "local", "global")


def arm_budget(weights: Column, slots: int = 5, boost: float = 1.0) -> Column:
    """struct<lex,local,global>: a round's slots by the arms' weights (a struct of the same fields).

    Every arm has one; each of those left goes to one arm more, the heaviest first (ties in the order of ARMS). A boost
    over 1 moves that much more of what is above one to the global arm, from the arm with more slots first.
    """
    w = [weights[a] for a in ARMS]
    left = max(slots, len(ARMS)) - len(ARMS)
    ahead = lambda k: sum((w[j] >= w[k] if j < k else w[j] > w[k]).cast("int") for j in range(len(ARMS)) if j != k)
    lex, local, rest = (1 + (ahead(k) < left).cast("int") for k in range(len(ARMS)))
    movable = min(left, len(ARMS))
    extra = min(movable, int(movable * max(boost - 1, 0)))
    if extra:
        first = lex >= local
        one = F.least(F.lit(extra), F.greatest(lex, local) - 1)
        two = F.least(extra - one, F.least(lex, local) - 1)
        lex, local, rest = lex - F.when(first, one).otherwise(two), local - F.when(first, two).otherwise(one), rest + one + two
    return F.struct(lex.alias("lex"), local.alias("local"), rest.alias("global"))


def arm_learned(weights: Column, good: Column, old: float = 0.5) -> Column:
    """The arms' weights after a round: half the old one, half the arm's share of the round's windows that score 4 or more (good: counts by arm), made to sum to 1."""
    total = sum(good[a] for a in ARMS)
    raw = F.array(*[old * weights[a] + (1 - old) * F.coalesce(F.try_divide(good[a].cast("double"), total.cast("double")), F.lit(0.0)) for a in ARMS])
    return let(raw, lambda r: F.struct(*[(r[k] / (r[0] + r[1] + r[2])).alias(a) for k, a in enumerate(ARMS)]))


def sampled(tokens: Column, text: Column, rounds: int = 2, seeds: int = 3, seed: int = 42, spread: float = 180.0, slots: int = 5, boost: float = 1.0) -> Column:
    """array<struct<start,end,score>>: the scored windows of a long text, best first within the budget.

    A sweep of evenly spaced windows and of windows around the query's words, then rounds of three arms: windows around
    the query's words, around the best windows so far, and scattered ones, drawn from hashes, so that reruns agree. Each
    round's slots follow the weights that the arms' yields left (arm_budget, arm_learned). Of windows with one start, the
    first counts.
    """
    n, half = F.length(text), WINDOW // 2
    u = lambda *salt: (F.pmod(F.xxhash64(*map(F.lit, salt[:-1]), salt[-1], n), F.lit(1 << 30)) + 1) / float((1 << 30) + 2)

    def scored(centre: Column) -> Column:
        span = let(F.greatest(F.lit(0), F.least(centre.cast("int"), n)), lambda c: F.struct(F.greatest(F.lit(0), c - half).alias("start"), F.least(n, c + half).alias("end")))
        return let(span, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), let(F.lower(slice_of(text, w["start"], w["end"])), lambda x: F.round(tx.keyword_score(tokens, x), 6)).alias("score")))

    def ordered(windows: Column) -> Column:
        once = F.filter(windows, lambda w, i: ~F.array_contains(F.transform(F.slice(windows, F.lit(1), i), lambda x: x["start"]), w["start"]))
        best = F.array_sort(F.transform(once, lambda w: F.struct((-w["score"]).alias("low"), w["start"].alias("start"), w["end"].alias("end"))))
        return F.transform(best, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), (-w["low"]).alias("score")))

    def shifted(centre: Column, r: int, k: Column) -> Column:
        return centre + F.round(F.sqrt(-2 * F.log(u(seed, r, 1, centre + k))) * F.cos(u(seed, r, 2, centre + k) * 6.283185307179586) * spread)

    def around_words(k: Column) -> Column:
        return F.transform(F.slice(F.array_distinct(tokens), F.lit(1), k), lambda t: scored(F.when(F.instr(text, t) == 0, F.floor(n / 2)).otherwise(F.instr(text, t) - 1)))

    def around_best(found: Column, r: int, k: Column) -> Column:
        def near(i: Column) -> Column:
            w = F.get(found, F.pmod(i, F.least(F.lit(seeds), F.size(found))))
            return let(F.floor((w["start"] + w["end"]) / 2), lambda centre: scored(shifted(centre, r, i)))

        return F.transform(F.sequence(F.lit(0), k - 1), near)

    def next_round(state: Column, r: int) -> Column:
        def drawn(b: Column) -> Column:
            far = F.transform(F.sequence(F.lit(0), b["global"] - 1), lambda k: scored(F.floor(u(seed, r, 3, k) * n)))
            return F.struct(around_words(b["lex"]).alias("lex"), around_best(state["found"], r, b["local"]).alias("local"), far.alias("global"))

        def learned(batch: Column) -> Column:
            good = F.struct(*[F.size(F.filter(batch[a], lambda w: w["score"] >= KEEP)).alias(a) for a in ARMS])
            return F.struct(let(F.concat(state["found"], *[batch[a] for a in ARMS]), ordered).alias("found"), arm_learned(state["weights"], good).alias("weights"))

        return let(let(arm_budget(state["weights"], slots, boost), drawn), learned)

    def with_round(state: Column, r: int) -> Column:
        return let(state, lambda s: next_round(s, r))

    strata = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: scored(F.floor((2 * k + 1) * n / 10)))
    even = F.struct(*[F.lit(1 / len(ARMS)).alias(a) for a in ARMS])
    state = F.struct(let(F.concat(strata, around_words(F.lit(5))), ordered).alias("found"), even.alias("weights"))
    for r in range(rounds):
        state = with_round(state, r)
    found = state["found"]
    size = lambda w: F.octet_length(slice_of(text, w["start"], w["end"])).cast("long")
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<start:int,end:int,score:double>>").alias("w"))
    return F.aggregate(found, begin, lambda s, w: F.when(s["n"] >= BUDGET, s).otherwise(F.struct((s["n"] + size(w)).alias("n"), F.concat(s["w"], F.array(w)).alias("w"))), lambda s: s["w"])


def evidence_windows(tokens: Column, text: Column, boost: float = 1.0) -> Column:
    """array<struct<start,end,score>> of a text: one window up to 100,000 characters, else the sampled ones (boost: see arm_budget)."""
    n = F.length(text)
    start = F.when(n > LARGE, densest_start(tokens, text, LARGE)).otherwise(0)
    one = lambda s: F.struct(s.alias("start"), F.least(n, s + LARGE).alias("end"), let(F.lower(slice_of(text, s, F.least(n, s + LARGE))), lambda x: F.round(tx.keyword_score(tokens, x), 6)).alias("score"))
    whole = F.transform(F.array(start), one)
    return F.when(n <= WHOLE, whole).otherwise(sampled(tokens, text, boost=boost))


def stratified(rows: DataFrame, text: str, k: int = 5) -> DataFrame:
    """rows with k windows at evenly spaced centres."""
    n = F.length(text)
    r = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start, end = window_at(F.floor((2 * F.col("slot") + 1) * n / (2 * k)).cast("int"), n)
    return r.withColumns({"start": start, "end": end})


def lexical(pairs: DataFrame, tokens: str, text: str, k: int = 5) -> DataFrame:
    """pairs with a window around the first exact occurrence of each of the first k distinct tokens; the text's middle where there is none."""
    n = F.length(text)
    r = pairs.withColumn("anchor", F.explode(F.slice(F.array_distinct(tokens), 1, k)))
    at = F.instr(F.col(text), F.col("anchor"))
    start, end = window_at(F.when(at == 0, F.floor(n / 2).cast("int")).otherwise(at - 1), n)
    return r.withColumns({"start": start, "end": end})


def jittered(rows: DataFrame, text: str, centre: str, seed: int = 42, spread: float = 180.0) -> DataFrame:
    """rows with a window around a centre moved by a normal deviate drawn from a hash of the row: reruns agree."""
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(centre), F.length(text)), F.lit(1 << 30)) + 1) / float((1 << 30) + 2)
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(u(2) * 6.283185307179586)
    start, end = window_at((F.col(centre) + F.round(z * spread)).cast("int"), F.length(text))
    return rows.withColumns({"start": start, "end": end})


def scattered(rows: DataFrame, text: str, k: int, seed: int = 42) -> DataFrame:
    """rows with k windows at places drawn evenly from a hash of row and slot."""
    r = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    n = F.length(text)
    start, end = window_at(F.pmod(F.xxhash64(F.lit(seed), F.col("slot"), F.col(text)), F.greatest(n, F.lit(1)).cast("long")).cast("int"), n)
    return r.withColumns({"start": start, "end": end})


def arm_weights(scored: DataFrame, old: float = 0.5) -> DataFrame:
    """(item_id, arm, weight): half the even share, half the arm's share of windows that score 4 or more, made to sum to 1."""
    y = scored.groupBy("item_id", "arm").agg((F.count_if(F.col("score") >= KEEP) / F.count("*")).alias("gain"))
    w = W.partitionBy("item_id")
    y = y.withColumn("raw", old / F.count("*").over(w) + (1 - old) * F.col("gain"))
    return y.select("item_id", "arm", F.round(F.col("raw") / F.sum("raw").over(w), 6).alias("weight"))


def arm_slots(weights: DataFrame, slots: int) -> DataFrame:
    """One slot for each arm of a query, the rest to the heaviest (ties by name)."""
    w = W.partitionBy("item_id").orderBy(F.desc("weight"), "arm")
    n = F.count("*").over(W.partitionBy("item_id"))
    return weights.withColumn("slots", F.when(F.row_number().over(w) == 1, F.greatest(F.lit(1), slots - n + 1)).otherwise(1))


def within_budget(windows: DataFrame, keys: list[str], order: list, size: Column, budget: int = BUDGET) -> DataFrame:
    """The first windows in order, as long as those before hold less than the budget."""
    before = F.coalesce(F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return windows.withColumn("before", before).where(F.col("before") < budget).drop("before")


def all_failed(scored: DataFrame, key: str) -> DataFrame:
    """(key, failed, mean): a batch fails only if every score is null; failed ones never count as 0."""
    return scored.groupBy(key).agg(F.bool_and(F.col("score").isNull()).alias("failed"), F.round(F.avg("score"), 6).alias("mean"))


def decompose(query: Column, most: int = 4) -> Column:
    """A compound question's parts in order, trimmed, at most four; the question itself if nothing is left.

    The rest is cut at the first place of the mark that comes first (of marks at one place, the first of the list). A
    mark of one character only counts if its first place leaves two characters or more on both sides.
    """

    def place(rest: Column, mark: str, k: int) -> Column:
        at = F.instr(F.lower(rest), F.lit(mark))
        good = at > 0 if mark not in SINGLE else (at > 2) & (F.length(rest) - at >= 2)
        return F.when(good, F.struct(at.alias("at"), F.lit(k).alias("k"), F.lit(len(mark)).alias("n")))

    def step(state: Column) -> Column:
        first = F.array_min(F.array(*[place(state["rest"], m, k) for k, m in enumerate(CUTS)]))
        left = tx.trim(F.substring(state["rest"], F.lit(1), first["at"] - 1))
        cut = F.struct(F.substring(state["rest"], first["at"] + first["n"], F.length(state["rest"])).alias("rest"), F.when(left != "", F.concat(state["parts"], F.array(left))).otherwise(state["parts"]).alias("parts"))
        return F.when(first.isNull(), state).otherwise(cut)

    marks = F.size(F.split(F.lower(query), "|".join(CUTS)))
    begin = F.struct(query.alias("rest"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(F.sequence(F.lit(1), marks), begin, lambda s, _: step(s), lambda s: F.when(tx.trim(s["rest"]) != "", F.concat(s["parts"], F.array(tx.trim(s["rest"])))).otherwise(s["parts"]))
    return F.when(F.size(done) == 0, F.array(query)).otherwise(F.slice(done, 1, most))


def is_unit(part: Column) -> Column:
    """Four characters or more, brackets balanced, no straight quotes."""
    p = F.trim(part)
    chars = F.split(F.regexp_replace(p, r"[^《〈（(\[【{“‘》〉）)\]】}”’]", ""), "")
    depth = F.aggregate(F.filter(chars, lambda c: c != ""), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda s, c: F.struct((s["d"] + F.when(c.isin(*OPENING), 1).otherwise(-1)).alias("d"), (s["ok"] & (s["d"] + F.when(c.isin(*OPENING), 1).otherwise(-1) >= 0)).alias("ok")))
    return (F.length(p) >= 4) & ~p.rlike(f"[{AMBIGUOUS}]") & depth["ok"] & (depth["d"] == 0)


def is_list(query: Column) -> Column:
    """Whether a question states several requirements: by a marker, or by more than one question mark; an alternative never does."""
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(query, m))
    return ~has(ALTERNATIVE) & (has(COORDINATION) | (F.length(query) - F.length(F.translate(query, "？?", "")) > 1))


def core_present(fact: Column, content: Column) -> Column:
    """Any three characters of the fact in a row; facts under three always."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(fact) - 2, F.lit(1))), lambda i: F.substring(fact, i, F.lit(3)))
    return (F.length(fact) < 3) | F.exists(grams, lambda g: F.contains(F.lower(content), F.lower(g)))


def fact_coverage(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """Each fact (item_id, fact_id, fact) by its windows (item_id, window_id, content, score): covered, best score and near_miss.

    A window covers a fact if it scores 4 or more, holds at least half of its tokens and any three characters of it.
    """
    r = facts.withColumn("toks", tx.fields(F.col("fact"))).join(windows, "item_id")
    hit = F.coalesce(F.try_divide(tx.hits(F.col("toks"), F.lower("content")).cast("double"), F.size("toks").cast("double")), F.lit(0.0))
    r = r.withColumns({"hit": F.round(hit, 6), "near": F.col("score") >= KEEP})
    r = r.withColumn("ok", F.col("near") & (F.col("hit") >= 0.5) & core_present(F.col("fact"), F.col("content")))
    best = F.max(F.when(F.col("ok"), F.struct("hit", "score")))
    return r.groupBy("item_id", "fact_id").agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("covered"), F.round(F.coalesce(best["score"], F.lit(0.0)), 6).alias("score"), F.round(F.coalesce(F.max(F.when(F.col("near") & ~F.col("ok"), F.col("hit"))), F.lit(0.0)), 6).alias("near_miss"))


def report(coverage: DataFrame) -> DataFrame:
    """(item_id, k, complete, missing, weakest) of the facts of each query."""
    return coverage.groupBy("item_id").agg(F.count("*").alias("k"), F.bool_and("covered").alias("complete"), F.count_if(~F.col("covered")).alias("missing"), F.round(F.min(F.when(F.col("covered"), F.col("score") / 10).otherwise(0.0)), 6).alias("weakest"))


def consolidate(windows: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """Windows of a source that overlap or lie within a gap, as one: the largest score, the union's start and end."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    ends = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    r = windows.withColumn("_new", F.when(ends.isNull() | (F.col("start") > ends + gap), 1).otherwise(0))
    r = r.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.count("*").alias("merged")).drop("_island")


def expand(windows: DataFrame, length: str, by: int = 24) -> DataFrame:
    return windows.withColumns({"start": F.greatest(F.lit(0), F.col("start") - by), "end": F.least(F.col(length), F.col("end") + by)})


def around(tokens: Column, text: Column, n: int = 240) -> Column:
    """The n characters of a text that hold most of the tokens, repeats counted, by quarters of n (ties: the earliest), with marks where it is cut."""
    found = lambda s: F.size(F.filter(tokens, lambda t: F.contains(F.substring(text, s + 1, F.lit(n)), t)))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - n, F.lit(0)), F.lit(n // 4))
    best = lambda: F.array_max(F.transform(starts, lambda s: F.struct(found(s).alias("hits"), (-s).alias("at"))))["at"]
    cut = let(F.when(F.size(tokens) == 0, 0).otherwise(-best()), lambda s: F.concat(F.when(s > 0, "…").otherwise(""), F.substring(text, s + 1, F.lit(n)), F.when(s + n < F.length(text), "…").otherwise("")))
    return F.when(F.length(text) <= n, text).otherwise(cut)


def span_label(spans: Column, start: Column, end: Column) -> Column:
    """The label of the first span (label, start, end) that holds a window whole; [?] if none of them does, body without spans."""
    held = F.filter(spans, lambda s: (s["start"] <= start) & (end <= s["end"]))
    return F.when(F.size(spans) == 0, "body").otherwise(F.coalesce(F.get(held, 0)["label"], F.lit("[?]")))


def spans_of(spans: DataFrame, id_col: str) -> DataFrame:
    """(id, spans): structure_spans() gathered by document, in order."""
    return spans.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))


def summaries(windows: DataFrame) -> DataFrame:
    """(item_id, summary): the deterministic answer of a query (query, tokens) from the windows of its source (title, spans), in order of place.

    A window (place, method, start, end, content) is a line with its number, the label of its span, how it was found and
    where it lies. A null title is empty.
    """
    line = F.concat(F.lit("("), span_label(F.col("spans"), F.col("start"), F.col("end")), F.lit(" "), F.col("method"), F.lit(" ["), F.col("start"), F.lit(","), F.col("end"), F.lit(")) "), around(F.col("tokens"), F.col("content")), F.lit("\n"))
    g = windows.select("item_id", "query", F.coalesce("title", F.lit("")).alias("title"), F.struct("place", line.alias("line")).alias("line")).groupBy("item_id", "query", "title").agg(F.array_sort(F.collect_list("line")).alias("lines"))  # within the budget of evidence
    lines = F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x["line"])), "")
    return g.select("item_id", F.concat(F.lit("【摘要】"), F.col("query"), F.lit("\n【来源】"), F.col("title"), F.lit("\n"), lines).alias("summary"))


def top_keeps(windows: DataFrame, keys: list[str], length: str, n: int = 8) -> DataFrame:
    """Scored windows merged, widened, merged again, and the best n of each query (the first key)."""
    once = consolidate(windows.where("score is not null"), [*keys, length])
    twice = consolidate(expand(once.drop("merged"), length), [*keys, length])
    w = W.partitionBy(keys[0]).orderBy(F.desc("score"), *keys[1:], "start")
    return twice.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def echoes(query_tokens: Column, summary: Column, least: int = 2) -> Column:
    """Whether a summary has under two characters that are neither the query's nor scaffolding."""
    own = F.array_join(query_tokens, "")
    chars = F.split(F.regexp_replace(F.lower(summary), r"[\s\p{P}]", ""), "")
    return F.size(F.filter(chars, lambda c: (c != "") & ~F.contains(own, c))) < least


def stability(a: Column, b: Column) -> Column:
    """Jaccard of two sets of cited sources; 1 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / F.greatest(u, F.lit(1)), 6))


def escalation_threshold(facts: Column) -> Column:
    return 0.35 + 0.05 * F.greatest(F.lit(0), F.least(F.lit(3), facts - 1))


def needs_deep(conf: Column, threshold: Column, samples: Column, complete: Column, k: Column, reused: Column, skipped: Column, refused: Column, conflicts: Column, bridged: Column) -> Column:
    need = skipped | refused | (conf < threshold) | (samples == 0) | conflicts | (~complete & (~reused | (k > 1)))
    return need & ~bridged


#: The head's weights, fixed values: query length, candidates, kept, top score, missing facts, confidence, skipped, refused; and its bias.
HEAD, BIAS = (-0.15, -0.05, -0.40, -0.25, 0.55, -1.20, 1.80, 1.70), -0.20


def abstain(length: Column, candidates: Column, kept: Column, best: Column, missing: Column, conf: Column, skipped: Column, refused: Column) -> tuple[Column, Column]:
    """Probability of failure, and what to do: refuse from 0.80, deep from 0.35, else nothing."""
    clip = lambda x, most: F.greatest(F.lit(0.0), F.least(x.cast("double") / most, F.lit(1.0)))
    x = (clip(length, 64), clip(candidates, 64), clip(kept, 8), clip(best, 10), clip(missing, 4), clip(conf, 1), skipped.cast("double"), refused.cast("double"))
    z = sum((w * v for w, v in zip(HEAD, x)), F.lit(BIAS))
    p = F.round(1 / (1 + F.exp(-z)), 6)
    return p, F.when(p >= 0.80, "refuse").when(p >= 0.35, "deep").otherwise("")


def fast_answer(queries: DataFrame, docs: DataFrame, index, k: int = 5) -> DataFrame:
    """The best windows of the k best documents of each query (item_id, query, tokens): score, coverage, confidence, citation.

    A document of up to 100,000 characters is one window, its densest 15,000 where it is longer; longer ones are sampled.
    """
    ranked = kept_table(index.rank(queries, k).select("item_id", "doc_id", "rnk"), "ranked")  # its size decides how documents are joined
    pairs = queries.join(ranked, "item_id").join(docs.select("doc_id", "body"), "doc_id")
    w = pairs.withColumn("w", F.explode(evidence_windows(F.col("tokens"), F.col("body"))))
    w = w.select("item_id", "rnk", "doc_id", "tokens", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.score").alias("score"), slice_of(F.col("body"), F.col("w.start"), F.col("w.end")).alias("content"))
    kept = within_budget(w.where(F.col("score") >= KEEP), ["item_id"], [F.desc("score"), F.col("rnk"), F.col("start")], F.octet_length("content"))
    return kept.select("item_id", "rnk", "doc_id", "start", "end", "score", F.round(tx.coverage(F.col("tokens"), F.col("content")), 6).alias("coverage"), tx.confidence(F.col("score"), tx.coverage(F.col("tokens"), F.col("content"))).alias("confidence"))


def deep_answer(queries: DataFrame, docs: DataFrame, index, files: int = 4) -> DataFrame:
    """Documents of each query in rank order, read until the first prefix whose best score reaches 8 with full coverage.

    All candidates are scored in one pass; the early stop is a running maximum over the rank.
    """
    ranked = kept_table(index.rank(queries, files).select("item_id", "doc_id", "rnk"), "ranked")  # as above
    pairs = queries.join(ranked, "item_id").join(docs.select("doc_id", "body"), "doc_id")
    s = pairs.select("item_id", "doc_id", "rnk", F.round(tx.keyword_score(F.col("tokens"), F.col("body")), 6).alias("score"), F.round(tx.coverage(F.col("tokens"), F.col("body")), 6).alias("coverage"))
    w = W.partitionBy("item_id").orderBy("rnk").rowsBetween(W.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.when((F.col("score") >= 8) & (F.col("coverage") >= 1.0), 1).otherwise(0)).over(w), F.lit(0))
    read = s.withColumn("_done", done).where("_done = 0")
    out = read.groupBy("item_id").agg(F.count("*").alias("files"), F.max("score").alias("best"), F.max("coverage").alias("coverage"), F.round(F.avg("score"), 6).alias("mean"))
    conf = tx.confidence(F.col("mean"), F.col("coverage"))
    return out.withColumn("confidence", F.when(F.col("coverage") < 1.0, F.least(conf, F.lit(0.45))).otherwise(conf))
