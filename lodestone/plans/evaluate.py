"""Registered queries of evaluation, calibration and monitoring. Labels are outcomes, events the usage rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import evidence
from ..operators import index as ix
from ..operators import lexicon
from .common import BM25, ITEMS, items, read, sources


def _outcomes(spark, d):
    """Labelled documents as answered items: confidence and tokens come from their length."""
    l = read(spark, d, "labels").join(sources(spark, d).select("doc_id", "n_chars", "lang"), "doc_id")
    conf = F.col("n_chars") % 101 / 100
    return l.select(F.col("doc_id").alias("item_id"), "lang", (F.col("quality") == 1).alias("correct"), F.when(F.col("n_chars") % 7 != 0, F.col("toxic") == 0).alias("ev_rec"), (F.col("n_chars") % 3 != 0).alias("grounded"), conf.cast("double").alias("conf"), F.col("n_chars").alias("tokens"), (F.col("n_chars") % 977).alias("latency"))


_OUT = "o AS (SELECT l.doc_id AS item_id, lang, quality = 1 AS correct, CASE WHEN n_chars % 7 <> 0 THEN toxic = 0 END AS ev_rec, n_chars % 3 <> 0 AS grounded, (n_chars % 101)::DOUBLE / 100 AS conf, n_chars AS tokens, n_chars % 977 AS latency FROM labels l JOIN documents d USING (doc_id))"


def _trial(spark, d):
    o = _outcomes(spark, d)
    return o.withColumn("correct", F.col("correct") | (F.col("item_id") % 5 == 0)).withColumn("tokens", F.col("tokens") + 1)


def eval_aggregate(spark, d):
    o = _outcomes(spark, d).withColumn("kind", ev.taxonomy(F.col("correct"), F.coalesce("ev_rec", F.lit(False)), F.col("grounded")))
    return o.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("em"))


def eval_summarize(spark, d):
    return ev.summarize(_outcomes(spark, d), ["lang"])


def calib_bands(spark, d):
    return ev.bands(_outcomes(spark, d))


def calib_propose(spark, d):
    return ev.propose(ev.bands(_outcomes(spark, d)), 10, 0.8)


def calib_decide(spark, d):
    return ev.decide(_outcomes(spark, d), _trial(spark, d), "item_id")


def mcnemar(spark, d):
    return ev.mcnemar(_outcomes(spark, d), _trial(spark, d), "item_id")


def guardrail_metrics(spark, d):
    o = _outcomes(spark, d)
    a = o.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("ev_rec").alias("ev_rec"), F.sum("tokens").alias("tokens"))
    return a.join(ev.exact_rank(o, ["lang"], "latency", 9, 10, "p90"), "lang")


def guardrail_compare(spark, d):
    g = guardrail_metrics(spark, d)
    return ev.guardrail(g.where("lang = 'en'"), g.where("lang = 'fr'"))


_GUARD = f"{_OUT}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (ev_rec) AS ev_rec, sum(tokens)::BIGINT AS tokens, list_sort(list(latency))[(9 * count(*)) // 10 + 1] AS p90 FROM o GROUP BY 1)"


def _usage(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("mode"), "value", (F.col("user_id") % 10).alias("namespace"))


def monitor_snapshot(spark, d):
    u = _usage(spark, d)
    a = u.groupBy("mode").agg(F.count("*").alias("n"), F.countDistinct("namespace").alias("namespaces"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("reuse_rate"))
    return a.join(ev.exact_rank(u, ["mode"], "value", 1, 2, "p50"), "mode").withColumn("p50", F.round("p50", 6))


def mine_anomalies(spark, d):
    u = _usage(spark, d)
    n = u.agg(F.count("*").alias("n"), F.count_if(F.col("mode") == "error").alias("deep"), F.max("value").alias("most"), F.count_if((F.col("mode") == "view") & (F.col("value") < 5)).alias("wobble"), F.count_if(F.col("mode") == "view").alias("sampled"))
    p = ev.exact_rank(u.withColumn("one", F.lit(1)), ["one"], "value", 9, 10, "p90")
    x = n.crossJoin(p)  # one row each
    rows = F.array(F.struct(F.lit("deep-share").alias("name"), F.round(F.col("deep") / F.col("n"), 6).alias("score")), F.struct(F.lit("latency-tail").alias("name"), F.round(F.col("p90") / (F.col("most") + 1), 6).alias("score")), F.struct(F.lit("selfplay-wobble").alias("name"), F.round(F.try_divide("wobble", "sampled"), 6).alias("score")))
    return x.select(F.explode(rows).alias("r")).select("r.name", "r.score").orderBy(F.desc("score"), "name").limit(10)


def learned_counts(spark, d):
    t = [(n, read(spark, d, n)) for n in ("documents", "labels", "events", "conversations")]
    out = None
    for name, df in t:
        c = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def _ledger(spark, d):
    """Uses of documents by their words, a document's event being the time of use."""
    s = sources(spark, d).select("doc_id", F.explode(F.array_distinct(tx.fields(F.col("body")))).alias("token"))
    e = read(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("last"), F.col("value").alias("score"))
    return s.join(e, "doc_id").select("token", "doc_id", "score", F.lit(1).cast("long").alias("hits"), "last")


def affinity_record(spark, d):
    l = _ledger(spark, d)
    r = ev.record(l, l.where("doc_id % 2 = 0"), 60)
    return r.select("token", "doc_id", F.round("score", 5).alias("score"), "hits", "last")


def affinity_weights(spark, d):
    l = _ledger(spark, d)
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    w = ev.ledger_weights(items(spark, d), l, now)
    return ix.top(w, "item_id", [F.desc("weight"), F.col("doc_id")], 10).select("item_id", "doc_id", F.round("weight", 3).alias("weight"), "rnk")


_LEDGER = """sl AS (SELECT DISTINCT doc_id, unnest(t) AS token FROM (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '[0-9A-Za-z一-鿿]{2,}'), lambda r: CASE WHEN regexp_matches(r, '^[一-鿿]') THEN list_transform(range(1, length(r)), lambda i: lower(substr(r, i, 2))) ELSE [lower(r)] END)) AS t FROM documents)),
    led AS (SELECT token, doc_id, value AS score, 1 AS hits, ts AS last FROM sl JOIN events ON event_id = doc_id)"""


def intent_classify(spark, d):
    c = read(spark, d, "conversations")
    q = F.when(F.col("turn") == 0, "Hi there").when(F.col("turn") == 1, "summarize this").otherwise(F.col("text"))
    return c.select("conv_id", "turn", ev.intent(q).alias("intent"))


def escalation_gate(spark, d):
    o = _outcomes(spark, d)
    k = F.col("tokens") % 5 + 1
    t = F.round(evidence.escalation_threshold(k), 6)
    f = lambda n: F.col("tokens") % n == 0
    need = evidence.needs_deep(F.col("conf"), t, F.col("tokens") % 11, F.col("correct"), k, f(2), f(17), f(19), f(23), f(13))
    return o.select("item_id", t.alias("threshold"), need.alias("deep"))


def abstain_head(spark, d):
    o = _outcomes(spark, d)
    t = F.col("tokens")
    p, action = evidence.abstain(t % 90, t % 70, t % 9, (t % 110) / 10, t % 6, F.col("conf"), t % 5 == 0, t % 7 == 0)
    return o.select("item_id", p.alias("p"), action.alias("action"))


def eval_correct(spark, d):
    s = sources(spark, d)
    gold = F.when(F.col("doc_id") % 3 == 0, F.regexp_extract("body", "[0-9]+", 0)).when(F.col("doc_id") % 3 == 1, F.substring("body", 3, 12)).otherwise("zz9")
    return s.select("doc_id", ev.is_correct(F.col("body"), F.coalesce(F.nullif(gold, F.lit("")), F.lit("7"))).alias("correct"))


def eval_score(spark, d):
    """Evidence recall of each item: any canonical cited source among its gold."""
    gold = lexicon.gold_pairs(items(spark, d), sources(spark, d)).select("item_id", F.concat(F.lit("src:k"), "doc_id", F.lit("#3")).alias("key"))
    cited = ix.Scan(sources(spark, d), items(spark, d)).rank(items(spark, d), 5).select("item_id", F.concat(F.lit("k"), "doc_id").alias("key"))
    g = gold.groupBy("item_id").agg(F.collect_set(ev.canonical(F.col("key"))).alias("g"))
    c = cited.groupBy("item_id").agg(F.collect_set(ev.canonical(F.col("key"))).alias("c"))
    return c.join(g, "item_id", "left").select("item_id", F.coalesce(F.arrays_overlap("g", "c"), F.lit(False)).alias("ev_rec"))


def freeze_sha(spark, d):
    b = read(spark, d, "benchmark").select("item_id", F.sha2(F.concat_ws("\x1f", "item_id", "text"), 256).alias("h"))
    lines = F.array_sort(F.collect_list("h"))  # a frozen evaluation set is small by contract: at most 500 items
    return b.agg(F.count("*").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def validate_dataset(spark, d):
    i = read(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 9 == 0, "  ").otherwise(F.col("text")).alias("query"))
    i = i.unionByName(i.where("item_id % 8 = 0"))
    gold = i.select("item_id", (F.col("item_id") * 40).alias("doc_id"))
    return ev.validate(i, gold, sources(spark, d).select("doc_id"))


def compare_runs(spark, d):
    return ev.compare_runs(_outcomes(spark, d).where("item_id % 4 <> 0"), _trial(spark, d).where("item_id % 6 <> 0"), "item_id")


def nr_breakdown(spark, d):
    """Why items lack evidence: no gold text anywhere, gold not among the admitted, or admitted."""
    i = items(spark, d)
    gold = lexicon.gold_pairs(i, sources(spark, d)).select("item_id", "doc_id")
    r = ix.Scan(sources(spark, d), i).rank(i, 3).select("item_id", "doc_id", F.lit(1).alias("hit"))
    h = gold.join(r, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.count("hit").alias("hits"))
    x = i.select("item_id").join(h, "item_id", "left").select(F.when(F.col("hits").isNull(), "gold_missing").when(F.col("hits") == 0, "gold_not_admitted").otherwise("admitted").alias("reason"))
    return x.groupBy("reason").agg(F.count("*").alias("n"))


def prior_history(spark, d):
    """Tokens of the first 200 live, well-scored documents' beginnings: two bytes or more, distinct, the first 64 by token."""
    live = read(spark, d, "labels").where("quality = 1 and toxic = 0").orderBy("doc_id").limit(200).select("doc_id")
    t = sources(spark, d).join(live, "doc_id", "left_semi").select(F.explode(tx.fields(F.substring("body", 1, 120))).alias("token")).distinct()
    return t.orderBy("token").limit(64)


def theta_grid(spark, d):
    return ev.rates(ix.close_counts(read(spark, d, "embeddings"), [0.1, 0.2, 0.3, 0.4, 0.5, 0.55]))


_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)"


def score_stability(spark, d):
    u = _usage(spark, d).select("user_id", (F.col("value") / 10).alias("score"))
    r = ev.reliability(u, "user_id", 4.0)
    return r.select("user_id", "n", F.round("mean", 3).alias("mean"), F.round("spread", 3).alias("spread"), "stable")


def closed_book(spark, d):
    """Items whose passage alone, without documents, would be judged right for the passage's own number or start."""
    b = read(spark, d, "benchmark")
    return b.select("item_id", ev.is_correct(F.col("text"), F.substring("text", 5, 10)).alias("correct"))


QUERIES = {
    "eval_aggregate": (eval_aggregate, f"WITH {_OUT} SELECT CASE WHEN correct AND coalesce(ev_rec, false) THEN 'correct' WHEN correct THEN 'lucky' WHEN coalesce(ev_rec, false) THEN 'misread' WHEN grounded THEN 'wrong_source' ELSE 'not_retrieved' END AS kind, count(*) AS n, round(avg(correct::INT), 6) AS em FROM o GROUP BY 1"),
    "eval_summarize": (eval_summarize, f"WITH {_OUT} SELECT lang, count(*) AS n, round(avg(correct::INT), 6) AS correct, round(avg(ev_rec::INT), 6) AS ev_rec, round(avg(grounded::INT), 6) AS grounded, count(correct) AS judged FROM o GROUP BY 1"),
    "calib_bands": (calib_bands, f"WITH {_OUT} SELECT least(greatest(floor(conf / 0.05::DOUBLE), 0), 19)::INT AS band, count(*) AS n, count(*) FILTER (correct) AS correct FROM o GROUP BY 1"),
    "calib_propose": (calib_propose, f"WITH {_OUT}, b AS (SELECT least(greatest(floor(conf / 0.05::DOUBLE), 0), 19)::INT AS band, count(*) AS n, count(*) FILTER (correct) AS correct FROM o GROUP BY 1), s AS (SELECT band, (sum(n) OVER w)::BIGINT AS n, (sum(correct) OVER w)::BIGINT AS correct FROM b WINDOW w AS (ORDER BY band DESC ROWS UNBOUNDED PRECEDING)) SELECT *, round(band * 0.05::DOUBLE, 6) AS line FROM s WHERE n >= 10 AND correct::DOUBLE / n >= 0.8 ORDER BY band DESC LIMIT 1"),
    "calib_decide": (calib_decide, f"WITH {_OUT}, r AS (SELECT count(*) AS n, count(*) FILTER (correct OR item_id % 5 = 0) - count(*) FILTER (correct) AS gained, round(sum(tokens + 1)::DOUBLE / sum(tokens), 6) AS ratio FROM o) SELECT *, gained >= 2 AND ratio <= 1.05 AS accept FROM r"),
    "mcnemar": (mcnemar, f"WITH {_OUT} SELECT 0::BIGINT AS b, count(*) FILTER (NOT correct AND item_id % 5 = 0) AS c, CASE WHEN count(*) FILTER (NOT correct AND item_id % 5 = 0) = 0 THEN 1.0::DOUBLE ELSE round(least(1.0, 2 * pow(0.5, count(*) FILTER (NOT correct AND item_id % 5 = 0))), 6) END AS p FROM o"),
    "guardrail_metrics": (guardrail_metrics, f"WITH {_GUARD} SELECT lang, n, ev_rec, tokens, p90 FROM g"),
    "guardrail_compare": (guardrail_compare, f"WITH {_GUARD}, r AS (SELECT c.n > 0 AS has_rows, c.ev_rec::DOUBLE / c.n >= b.ev_rec::DOUBLE / b.n * 0.85 AS ev_rec_ok, c.tokens::DOUBLE / b.tokens <= 1.15 AS tokens_ok, c.p90::DOUBLE / b.p90 <= 1.30 AS latency_ok FROM g b, g c WHERE b.lang = 'en' AND c.lang = 'fr') SELECT ev_rec_ok, tokens_ok, latency_ok, has_rows AND ev_rec_ok AND tokens_ok AND latency_ok AS pass FROM r"),
    "monitor_snapshot": (monitor_snapshot, "SELECT event_type AS mode, count(*) AS n, count(DISTINCT user_id % 10) AS namespaces, round(avg((value > 50)::INT), 6) AS reuse_rate, round(list_sort(list(value) FILTER (value IS NOT NULL))[count(value) // 2 + 1], 6) AS p50 FROM events GROUP BY 1"),
    "mine_anomalies": (mine_anomalies, "WITH s AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS deep, max(value) AS most, count(*) FILTER (event_type = 'view' AND value < 5) AS wobble, count(*) FILTER (event_type = 'view') AS sampled, list_sort(list(value) FILTER (value IS NOT NULL))[(9 * count(value)) // 10 + 1] AS p90 FROM events) SELECT * FROM (SELECT 'deep-share' AS name, round(deep::DOUBLE / n, 6) AS score FROM s UNION ALL SELECT 'latency-tail', round(p90 / (most + 1), 6) FROM s UNION ALL SELECT 'selfplay-wobble', round(wobble::DOUBLE / sampled, 6) FROM s) ORDER BY score DESC, name LIMIT 10"),
    "learned_counts": (learned_counts, "SELECT 'documents' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations"),
    "affinity_record": (affinity_record, f"WITH {_LEDGER}, b AS (SELECT * FROM led UNION ALL SELECT * FROM led WHERE doc_id % 2 = 0), g AS (SELECT token, doc_id, sum(score) AS score, sum(hits)::BIGINT AS hits, max(last) AS last FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, doc_id) AS k FROM g) SELECT token, doc_id, round(score, 5) AS score, hits, last FROM r WHERE k <= 60"),
    "affinity_weights": (affinity_weights, f"WITH {ITEMS}, {_LEDGER}, q AS (SELECT item_id, unnest(list_filter(tokens, lambda t, i: list_position(tokens, t) = i)[1:24]) AS token FROM items), w AS (SELECT token, doc_id, score * pow(2.0, -((epoch_us(TIMESTAMP '2024-06-01') - epoch_us(last)) / 86400000000.0::DOUBLE) / 21.0) AS w FROM led), n AS (SELECT token, doc_id, w / nullif(max(w) OVER (PARTITION BY token), 0) AS w FROM w), s AS (SELECT item_id, doc_id, round(sum(w), 6) AS weight FROM q JOIN n USING (token) WHERE w IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, doc_id) AS rnk FROM s) SELECT item_id, doc_id, round(weight, 3) AS weight, rnk::INT AS rnk FROM r WHERE rnk <= 10"),
    "intent_classify": (intent_classify, "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'chat' WHEN turn = 1 THEN 'doc_summary' WHEN length(trim(text)) <= 8 AND len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w IN ('hi', 'hello', 'hey', 'thanks'))) > 0 THEN 'chat' ELSE 'search' END AS intent FROM conversations"),
    "escalation_gate": (escalation_gate, f"WITH {_OUT}, k AS (SELECT *, tokens % 5 + 1 AS k, round(0.35 + 0.05 * least(3, tokens % 5), 6) AS t FROM o) SELECT item_id, t::DOUBLE AS threshold, (tokens % 17 = 0 OR tokens % 19 = 0 OR conf < t OR tokens % 11 = 0 OR tokens % 23 = 0 OR (NOT correct AND (tokens % 2 <> 0 OR k > 1))) AND NOT tokens % 13 = 0 AS deep FROM k"),
    "abstain_head": (abstain_head, f"WITH {_OUT}, z AS (SELECT item_id, -0.20 - 0.15 * least((tokens % 90) / 64.0::DOUBLE, 1) - 0.05 * least((tokens % 70) / 64.0::DOUBLE, 1) - 0.40 * least((tokens % 9) / 8.0::DOUBLE, 1) - 0.25 * least((tokens % 110) / 10.0::DOUBLE / 10, 1) + 0.55 * least((tokens % 6) / 4.0::DOUBLE, 1) - 1.20 * least(conf, 1) + 1.80 * (tokens % 5 = 0)::INT + 1.70 * (tokens % 7 = 0)::INT AS z FROM o), p AS (SELECT item_id, round(1 / (1 + exp(-z)), 6) AS p FROM z) SELECT item_id, p, CASE WHEN p >= 0.80 THEN 'refuse' WHEN p >= 0.35 THEN 'deep' ELSE '' END AS action FROM p"),
    "eval_correct": (eval_correct, "WITH g AS (SELECT doc_id, lower(trim(text)) AS a, lower(trim(coalesce(nullif(CASE doc_id % 3 WHEN 0 THEN regexp_extract(text, '[0-9]+') WHEN 1 THEN substr(text, 3, 12) ELSE 'zz9' END, ''), '7'))) AS g FROM documents) SELECT doc_id, a = g OR CASE WHEN regexp_matches(g, '^[0-9]+$') THEN regexp_matches(a, '(^|[^0-9])' || g || '([^0-9]|$)') ELSE g <> '' AND contains(a, g) END AS correct FROM g"),
    "eval_score": (eval_score, f"WITH {BM25}, gold AS (SELECT i.item_id, d.doc_id FROM items i JOIN documents d ON contains(d.text, i.query)) SELECT r.item_id, bool_or(g.doc_id IS NOT NULL) AS ev_rec FROM ranked r LEFT JOIN gold g USING (item_id, doc_id) WHERE rnk <= 5 GROUP BY 1"),
    "freeze_sha": (freeze_sha, "SELECT count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS fingerprint FROM (SELECT sha256(item_id || chr(31) || text) AS h FROM benchmark)"),
    "validate_dataset": (validate_dataset, """WITH i AS (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN '  ' ELSE text END AS query FROM benchmark), j AS (SELECT * FROM i UNION ALL SELECT * FROM i WHERE item_id % 8 = 0)
        SELECT item_id, 'empty' AS problem FROM j WHERE trim(query) = '' UNION ALL SELECT item_id, 'duplicate' FROM j GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT item_id, 'unresolved' FROM j WHERE item_id * 40 NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT item_id, 'long' FROM j WHERE length(query) > 200"""),
    "compare_runs": (compare_runs, f"WITH {_OUT}, a AS (SELECT item_id, correct AS x FROM o WHERE item_id % 4 <> 0), b AS (SELECT item_id, correct OR item_id % 5 = 0 AS y FROM o WHERE item_id % 6 <> 0) SELECT item_id, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN NOT x AND y THEN 'improved' WHEN x AND NOT y THEN 'regressed' ELSE 'same' END AS change FROM a FULL JOIN b USING (item_id)"),
    "nr_breakdown": (nr_breakdown, f"WITH {BM25}, gold AS (SELECT i.item_id, d.doc_id FROM items i JOIN documents d ON contains(d.text, i.query)), h AS (SELECT item_id, count(r.doc_id) AS hits FROM gold LEFT JOIN (SELECT item_id, doc_id FROM ranked WHERE rnk <= 3) r USING (item_id, doc_id) GROUP BY 1) SELECT CASE WHEN hits IS NULL THEN 'gold_missing' WHEN hits = 0 THEN 'gold_not_admitted' ELSE 'admitted' END AS reason, count(*) AS n FROM items LEFT JOIN h USING (item_id) GROUP BY 1"),
    "prior_history": (prior_history, "WITH l AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 ORDER BY doc_id LIMIT 200) SELECT DISTINCT unnest(list_transform(regexp_extract_all(substr(text, 1, 120), '[0-9A-Za-z]{2,}'), lambda w: lower(w))) AS token FROM documents WHERE doc_id IN (SELECT doc_id FROM l) ORDER BY token LIMIT 64"),
    "theta_grid": (theta_grid, f"WITH p AS (SELECT {_COS} AS s, a.label = b.label AS r FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), q AS (SELECT * FROM p WHERE s >= 0), t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.55])::DOUBLE AS theta), g AS (SELECT theta, count(*) FILTER (s >= theta) AS kept, count(*) FILTER (s >= theta AND r) AS hits, count(*) FILTER (r) AS relevant FROM q, t GROUP BY 1) SELECT theta, kept, hits, round(coalesce(hits::DOUBLE / nullif(kept, 0), 0), 3) AS precision, round(coalesce(hits::DOUBLE / nullif(relevant, 0), 0), 3) AS recall FROM g"),
    "score_stability": (score_stability, "SELECT user_id, count(*) AS n, round(avg(value / 10), 3) AS mean, round(coalesce(stddev_samp(value / 10), 0), 3) AS spread, bool_and(value / 10 >= 4) OR NOT bool_or(value / 10 >= 4) AS stable FROM events GROUP BY 1"),
    "closed_book": (closed_book, "WITH g AS (SELECT item_id, lower(trim(text)) AS a, lower(trim(substr(text, 5, 10))) AS g FROM benchmark) SELECT item_id, a = g OR CASE WHEN regexp_matches(g, '^[0-9]+$') THEN regexp_matches(a, '(^|[^0-9])' || g || '([^0-9]|$)') ELSE g <> '' AND contains(a, g) END AS correct FROM g"),
}
