"""Registered queries of clusters and the graph. Topics are order priorities by customer segment; nodes are parts, events' types and documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import folding as fo
from ..operators import index as ix
from ..operators import knowledge as kn
from ..operators import lexicon
from ..operators import saving as sv
from ..session import kept_table
from .common import BM25, ITEMS, items, read, sources, sql_coverage, sql_fields, sql_unigrams


def level_keys(spark, d):
    b = read(spark, d, "benchmark")
    k = kn.level_keys(F.col("text"), F.substring("text", 1, 30), F.substring("text", 10, 40), F.col("text"))
    return b.select("item_id", F.explode(k).alias("k")).select("item_id", "k.level", "k.key")


def _uses(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("topic"), "o_orderdate", "o_orderkey", F.col("o_orderkey").cast("string").alias("query"))


def cluster_evolve(spark, d):
    e = kn.evolve(_uses(spark, d), "topic", ["o_orderdate", "o_orderkey"], "query")
    return e.select("topic", "version", "hotness", F.array_join("queries", ",").alias("queries"))


_EVOLVE = "r AS (SELECT o_custkey AS topic, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders), c AS (SELECT topic, count(*) AS version, round(least(1.0, 0.5 + 0.1 * (count(*) - 1)), 6)::DOUBLE AS hotness, string_agg(CASE WHEN k <= 5 THEN o_orderkey::VARCHAR END, ',' ORDER BY k DESC) AS queries FROM r GROUP BY 1)"


def cluster_stats(spark, d):
    e = kn.evolve(_uses(spark, d), "topic", ["o_orderdate", "o_orderkey"], "query")
    life = F.when(F.col("version") >= 12, "stable").when(F.col("version") >= 6, "emerging").otherwise("contested")
    return e.groupBy(life.alias("lifecycle")).agg(F.count("*").alias("n"), F.round(F.avg("hotness"), 3).alias("hotness"), F.sum(F.size("queries")).alias("queries"))


def reuse_score(spark, d):
    """Each query against the cluster of the query before it: vectors' cosine, and how much of its text the cluster's key covers."""
    i = items(spark, d)
    v = lexicon.hash_vectors(read(spark, d, "benchmark"), "item_id", "text")
    c = v.join(v.select((F.col("item_id") + 1).alias("item_id"), "bucket", F.col("x").alias("y")), ["item_id", "bucket"]).groupBy("item_id").agg(F.sum(F.col("x") * F.col("y")).alias("cos"))
    k = i.join(i.select((F.col("item_id") + 1).alias("item_id"), F.substring("query", 1, 80).alias("key")), "item_id").select("item_id", tx.coverage(F.col("tokens"), F.col("key")).alias("cover"))
    return k.join(c, "item_id", "left").select("item_id", F.round(kn.reuse_score(F.coalesce("cos", F.lit(0.0)), F.col("cover"), F.lit(0.0)), 6).alias("score"))


_VEC = """u AS (SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(text, '[一-鿿]|[0-9A-Za-z]+'), lambda w: lower(w))) AS term FROM benchmark), b AS (SELECT item_id, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS c FROM u GROUP BY 1, 2),
    v AS (SELECT item_id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY item_id)) AS x FROM b)"""


def relevance_gate(spark, d):
    g = lexicon.gold_pairs(items(spark, d), sources(spark, d))
    return g.select("item_id", "doc_id", (tx.coverage(F.col("tokens"), F.col("body")) >= 0.3).alias("relevant"))


def find_by_topic(spark, d):
    """Customers of a nation and segment as clusters of a topic: the first two by id."""
    c = read(spark, d, "customer").select(F.concat_ws(":", "c_nationkey", "c_mktsegment").alias("topic"), F.col("c_custkey").alias("cluster"))
    return c.withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy("cluster"))).where("place <= 2")


def _evidence(spark, d):
    """Windows kept from documents; those of every seventh document were cut from an older text."""
    s = sources(spark, d)
    return s.select((F.col("doc_id") % 50).alias("cluster"), "doc_id", F.lit(5).alias("start"), F.lit(25).alias("end"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.substring("body", 6, 19), F.lit("~"))).otherwise(F.substring("body", 6, 20)).alias("content"))


def prior_stale(spark, d):
    return kn.evidence_state(_evidence(spark, d), sources(spark, d), "cluster")


def try_reuse(spark, d):
    """Clusters that answer without a search: reusable by score and every window unchanged. Per document as its own cluster."""
    e = _evidence(spark, d).withColumn("cluster", F.col("doc_id"))
    s = kn.evidence_state(e, sources(spark, d), "cluster")
    l = read(spark, d, "labels").select(F.col("doc_id").alias("cluster"), (F.col("quality") * 0.9).alias("score"))
    return l.join(s, "cluster").where((F.col("score") >= kn.REUSE) & ~F.col("stale")).select("cluster")


def cluster_review(spark, d):
    e = _evidence(spark, d).withColumn("cluster", F.col("doc_id"))
    s = kn.evidence_state(e, sources(spark, d), "cluster")
    l = read(spark, d, "labels").select(F.col("doc_id").alias("cluster"), F.when(F.col("toxic") == 1, "contested").when(F.col("quality") == 1, "stable").otherwise("emerging").alias("before"))
    after = F.when(F.col("before").isin("emerging", "contested") & ~F.coalesce("stale", F.lit(False)), "stable").otherwise(F.col("before"))
    return l.join(s, "cluster", "left").select("cluster", "before", after.alias("after"))


_STALE = "e AS (SELECT doc_id, length(text) < 25 OR doc_id % 7 = 0 AS bad FROM documents)"


def cross_topic_near(spark, d):
    return ix.close_pairs(read(spark, d, "embeddings"), 0.35, labels="other")


_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)"
_PAIRS = f"p AS (SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE cosine >= 0.35)"


def _close_in_topic(spark, d):
    return ix.close_pairs(read(spark, d, "embeddings"), 0.35, labels="same")


def tidy_pairs(spark, d):
    """The hundred closest pairs of clusters of one topic, in the order in which they would merge."""
    return _close_in_topic(spark, d).select("a", "b", "cosine", F.row_number().over(W.orderBy(F.desc("cosine"), "a", "b")).alias("place")).orderBy("place").limit(100)


def tidy_run(spark, d):
    """The greedy merges over all close pairs."""
    return kn.merged_greedily(_close_in_topic(spark, d))


def fold_into(spark, d):
    e = kn.evolve(_uses(spark, d), "topic", ["o_orderdate", "o_orderkey"], "query").select(F.col("topic").alias("id"), (F.col("version") / 40).alias("conf"), "hotness", "queries")
    pairs = e.where("id % 10 = 1").select(F.col("id").alias("winner"), (F.col("id") + 1).alias("loser")).join(e.select(F.col("id").alias("loser")), "loser", "left_semi")
    f = kn.fold(e, pairs.select("winner", "loser"))
    return f.select("id", F.round("conf", 6).alias("conf"), "hotness", F.size("queries").alias("n_queries"))


def save_answers(spark, d):
    """Each passage asked of every document that holds it, saved in the order of the documents: what became of each answer.

    Answers from toxic documents are refused; windows from every seventh document were cut from an older text, so that
    the next answer replaces what they left.
    """
    g = lexicon.gold_pairs(items(spark, d), sources(spark, d)).select("item_id", "doc_id", "query", "body")
    toxic = read(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("refused")).distinct()
    at = (F.instr(F.col("body"), F.col("query")) - 1).cast("int")
    a = g.join(toxic, "doc_id", "left").select(
        F.concat_ws(":", "item_id", "doc_id").alias("answer_id"), F.col("doc_id").alias("at"), "query", F.concat(F.lit("see [1]: "), F.substring("query", 1, 40)).alias("summary"), F.col("doc_id").cast("string").alias("source"),
        F.round(F.length("query") / F.length("body"), 6).alias("confidence"), "refused", F.lit(False).alias("replace"), sv.windows_of(F.col("doc_id"), at, F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("~"), F.substring("query", 2, 1 << 20))).otherwise(F.col("query"))).alias("evidence"),
    )
    docs = sources(spark, d).select(F.col("doc_id").cast("string").alias("source"), "body")
    r = sv.saved(sv.admitted(a, docs)).where("kind = 'answer'")
    part = lambda k: F.split("answer_id", ":")[k].cast("long")
    return r.select(part(0).alias("item_id"), part(1).alias("doc_id"), "route", "version", F.round("confidence", 6).alias("confidence"), "n_evidence")


#: The answers of a topic one after the other: a cluster that holds an old window is replaced by the next answer.
_SAVE = f"""WITH RECURSIVE {ITEMS}, t AS (SELECT item_id, {sql_unigrams('query')} AS topic, query, tokens FROM items),
    g AS (SELECT t.*, doc_id, round(length(query)::DOUBLE / length(text), 6) AS conf, doc_id % 7 = 0 AS old, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR len(tokens) = 0 OR len(list_filter(tokens, lambda x: contains(lower(query), x))) < 0.15 * len(tokens) AS refused FROM t JOIN documents ON contains(text, query)),
    n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id, item_id || ':' || doc_id) AS k FROM g),
    s AS (SELECT topic, 0::BIGINT AS k, NULL::BIGINT AS item_id, NULL::BIGINT AS doc_id, '' AS route, 0 AS version, 0.0::DOUBLE AS conf, 0 AS n_evidence, false AS old FROM n GROUP BY 1
        UNION ALL SELECT n.topic, n.k, n.item_id, n.doc_id, CASE WHEN n.refused THEN 'refuse' WHEN s.version = 0 THEN 'new' WHEN s.old THEN 'replace' ELSE 'merge' END,
            s.version + CASE WHEN n.refused THEN 0 ELSE 1 END, CASE WHEN n.refused THEN s.conf WHEN s.version = 0 OR s.old THEN n.conf ELSE (s.conf + n.conf) / 2 END,
            CASE WHEN n.refused THEN s.n_evidence WHEN s.version = 0 OR s.old THEN 1 ELSE s.n_evidence + 1 END, CASE WHEN n.refused THEN s.old ELSE n.old END
        FROM s JOIN n ON n.topic = s.topic AND n.k = s.k + 1)
    SELECT item_id, doc_id, route, version, round(conf, 6) AS confidence, n_evidence FROM s WHERE k > 0"""


def persist_routing(spark, d):
    """What saving an answer would do: refuse, merge, evolve or begin a cluster, by confidence, staleness and nearness."""
    l = read(spark, d, "labels").join(sources(spark, d).select("doc_id", "n_chars"), "doc_id")
    near = F.col("n_chars") % 100 / 100
    route = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "refuse").when(near >= kn.REUSE, "evolve").when(near >= kn.MERGE, F.when(F.col("toxic") == 1, "new").otherwise("merge")).otherwise("new")
    return l.select("doc_id", route.alias("route"))


def conversation_clusters(spark, d):
    """Conversations as clusters: the last five user turns are the queries, what the assistant said is the content."""
    c = read(spark, d, "conversations").where("conv_id is not null")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = lambda role: F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: F.coalesce(t["text"], F.lit("")))
    c = c.groupBy(F.col("conv_id").alias("id")).agg(turns.alias("turns")).select("id", said("user").alias("q"), F.array_join(said("assistant"), "\n").alias("content")).where("size(q) > 0")
    name, none = F.col("q")[0], F.array().cast("array<string>")
    return c.select(
        "id", F.col("id").alias("created"), tx.topic_key(name).alias("topic"), none.alias("aliases"), name.alias("name"), "content", F.slice("q", F.greatest(F.lit(1), F.size("q") - 4), F.lit(5)).alias("queries"),
        kn.level_keys(name, name, F.lit(""), F.col("content")).alias("level_keys"), F.array().cast("array<struct<source: string, start: int, end: int, content: string>>").alias("evidence"),
        F.lit(0.5).alias("confidence"), F.lit(0.5).alias("hotness"), F.lit("emerging").alias("lifecycle"), none.alias("flags"), F.lit(1).alias("version"),
    )


def accept_fold(spark, d):
    """May each conversation's cluster be folded into the one before it, and if not, why."""
    c = conversation_clusters(spark, d)
    pairs = c.select(F.col("id").alias("loser"), (F.col("id") - 1).alias("winner")).join(c.select(F.col("id").alias("winner")), "winner", "left_semi")
    return fo.accepted(pairs, c, 3)


_ACCEPT = rf"""WITH u AS (SELECT conv_id AS id, list(coalesce(text, '') ORDER BY turn) FILTER (role = 'user') AS q, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS content FROM conversations GROUP BY 1),
    k AS (SELECT id, content, q[1] AS name, q[greatest(1, len(q) - 4):] AS queries, substr(sha256(array_to_string({sql_unigrams('q[1]')}, '|')), 1, 16) AS topic,
        [substr(trim(q[1], ' '), 1, 80), substr(trim(regexp_extract(content, '[^\n]*\S[^\n]*'), ' '), 1, 80)] AS levels FROM u WHERE q IS NOT NULL),
    c AS (SELECT id, topic, regexp_extract(content, '[0-9]+') AS claim, list_filter(queries || levels, lambda x: x <> '') AS keys, lower(concat_ws(' ', content, name, array_to_string(queries, ' '), topic, '', array_to_string(levels, ' '))) AS body FROM k),
    p AS (SELECT w.id AS winner, l.id AS loser, w.topic <> l.topic AND w.claim <> '' AND l.claim <> '' AND w.claim <> l.claim AS differ, list_distinct(l.keys) AS keys FROM c w JOIN c l ON l.id = w.id + 1),
    a AS (SELECT winner, loser, key, {sql_fields('key')} AS t FROM (SELECT winner, loser, unnest(keys) AS key FROM p WHERE NOT differ)),
    r AS (SELECT winner, loser, key, c.id, len(list_filter(t, lambda x: contains(body, x))) AS h, list_max(list_transform(c.keys || [topic], lambda o: len(list_filter(t, lambda x: contains(lower(o), x))))) AS m FROM a JOIN c ON c.id <> a.loser),
    f AS (SELECT r.winner, r.loser, r.key, count(*) FILTER (r.id <> r.winner AND (r.h > w.h OR r.h = w.h AND r.id < r.winner)) >= 3 AS vague, bool_or(r.id <> r.winner AND r.m > w.m) AS nearer
        FROM r JOIN r w ON w.winner = r.winner AND w.loser = r.loser AND w.key = r.key AND w.id = w.winner GROUP BY 1, 2, 3),
    o AS (SELECT p.winner, p.loser, p.differ, min(list_position(l.keys, f.key) * 2 + CASE WHEN vague THEN 0 ELSE 1 END) FILTER (vague OR nearer) AS fault FROM p JOIN c l ON l.id = p.loser LEFT JOIN f ON f.winner = p.winner AND f.loser = p.loser GROUP BY 1, 2, 3)
    SELECT winner, loser, NOT differ AND fault IS NULL AS accepted, CASE WHEN differ THEN 'claims' WHEN fault IS NULL THEN '' WHEN fault % 2 = 0 THEN 'specificity' ELSE 'separation' END AS reason FROM o"""


def tidy_fixpoint(spark, d):
    """The vectors as clusters, older by number, folded until no two are close; parts of one order are retrieved together.

    These vectors are nearly orthogonal, so the line is 0.45 instead of the usual 0.55; they have no texts to check.
    """
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    c = conversation_clusters(spark, d).limit(0)
    c = v.select("id", "vector", F.col("id").alias("created"), F.array(F.col("id").cast("string")).alias("queries"), F.lit("").alias("content"), F.lit("").alias("topic"), F.lit("").alias("name"), F.lit("emerging").alias("lifecycle"), F.lit(0.5).alias("confidence"), F.lit(0.5).alias("hotness"), F.lit(1).alias("version"), *[F.array().cast(c.schema[x].dataType).alias(x) for x in ("aliases", "level_keys", "evidence", "flags")])
    known = v.select(F.col("id").cast("string").alias("text"), "vector")
    _, decided = fo.tidy(c, lambda texts: texts.join(known, "text"), 0.45, together=cooccur_edges(spark, d), check=False)
    return decided.select("winner", "loser", F.round("sim", 6).alias("sim"), "round")


def _claims(spark, d):
    return sources(spark, d).select(F.col("doc_id").alias("id"), F.col("uri").alias("grp"), tx.numeric_claim(F.col("body"), F.lit("")).alias("claim"))


def detect_conflicts(spark, d):
    return kn.conflicts(_claims(spark, d), "grp")


_CONF = "c AS (SELECT source AS grp, regexp_extract(text, '[0-9]+') AS claim, min(doc_id) AS id FROM documents GROUP BY 1, 2), cf AS (SELECT x.grp, x.id AS a, y.id AS b FROM c x JOIN c y ON x.grp = y.grp AND x.id < y.id AND x.claim <> y.claim WHERE x.claim <> '' AND y.claim <> '')"


def conflicts_for(spark, d):
    c = kn.claim_classes(_claims(spark, d), "grp").where("others > 0")
    return c.groupBy(F.col("id").alias("cluster")).agg(F.sum("others").alias("n"))


def _together(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey")


_CO = "li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), co AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS hits, round(least(1.0, 0.7 + 0.1 * (count(*) - 1)), 6)::DOUBLE AS weight FROM li x JOIN li y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2)"


def cooccur_edges(spark, d):
    return kn.pair_edges(_together(spark, d), "l_orderkey", "l_partkey")


def cooccur_partners(spark, d):
    e = kn.both_ways(kn.pair_edges(_together(spark, d), "l_orderkey", "l_partkey"))
    return ix.top(e, "a", [F.desc("weight"), F.col("b")], 3, "place")


def query_seq_edges(spark, d):
    e = read(spark, d, "events")
    n = e.select("user_id", "ts", "event_id", F.concat_ws(":", "event_type", (F.col("event_id") % 20).cast("string")).alias("node"))
    return kn.sequence_edges(n, "user_id", ["ts", "event_id"], "node")


_SEQ = "n AS (SELECT user_id, event_type || ':' || (event_id % 20) AS a, lead(event_type || ':' || (event_id % 20)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), sq AS (SELECT a, b, count(*) AS hits, 0.6::DOUBLE AS weight, CASE WHEN count(*) >= 2 THEN 'pathway' ELSE 'plain' END AS kind FROM n WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)"


def embed_sim_edges(spark, d):
    return ix.close_pairs(read(spark, d, "embeddings"), 0.55).select("a", "b", F.col("cosine").alias("weight"))


def barrier_edges(spark, d):
    return kn.barriers(_claims(spark, d), "grp")


def graph_expand_2hop(spark, d):
    """From each event type's node 0, two hops over the query sequence."""
    e = query_seq_edges(spark, d)
    starts = e.where(F.col("a").endswith(":0")).select(F.col("a").alias("start")).distinct()
    return kn.expand(starts, e, 2, 0.5, 16)


def graph_expand_nearest(spark, d):
    """From the vectors divisible by 20, three hops either way over orders' next parts, to the six neighbours of each hop nearest to the start's vector.

    Nodes are vectors; a part's size is its hotness, its price its confidence. Parts of very different price that stand
    together are barriers, and a part without a vector is no cluster.
    """
    part = read(spark, d, "part")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("node"))
    vectors = kept_table(read(spark, d, "embeddings").select(F.col("vec_id").alias("node")).distinct(), "vector-ids")
    e = kn.sequence_edges(li, "l_orderkey", ["l_linenumber", "node"], "node", vectors)  # walks start at and reach vectors alone
    price = lambda c: part.select(F.col("p_partkey").alias(c), F.col("p_retailprice").alias(f"price_{c}"))
    e = e.join(price("a"), "a").join(price("b"), "b").withColumn("kind", F.when(F.abs(F.col("price_a") - F.col("price_b")) > 150, "barrier").otherwise(F.col("kind")))
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "embedding", "label")
    nodes = part.select(F.col("p_partkey").alias("node"), (F.col("p_size") / 50).alias("hotness"), (F.col("p_retailprice") / 1100).alias("confidence")).join(v, "node")
    nodes = kn.fit_nodes(nodes.withColumn("lifecycle", F.when(F.col("label") == 9, "deprecated").otherwise("stable")), hotness=0.1, confidence=0.82)
    starts = v.where("node % 20 = 0").select(F.col("node").alias("start"), F.col("embedding").alias("probe"))
    return kn.expand(starts, e, 3, 0.5, 40, direction="any", nodes=nodes, hop_nearest=6)


def _hops_sql(depth: int, nearest: int) -> str:
    """The hops of graph_expand_nearest one after the other: what is seen before a hop stays out of it."""
    out = "h0 AS (SELECT vec_id AS start, vec_id AS node, 0 AS depth, 0.0::DOUBLE AS score FROM embeddings WHERE vec_id % 20 = 0)"
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT start, node FROM h{i}" for i in range(k))
        out += f""", s{k} AS (SELECT h.start, e.a, e.b, h.score + e.w AS score, row_number() OVER (PARTITION BY h.start, e.a ORDER BY round(list_dot_product(n.embedding::DOUBLE[], p.embedding::DOUBLE[]) / sqrt(list_dot_product(n.embedding::DOUBLE[], n.embedding::DOUBLE[])) / sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])), 9) DESC, e.b) AS place
            FROM h{k - 1} h JOIN ways e ON e.a = h.node JOIN nodes n ON n.node = e.b JOIN embeddings p ON p.vec_id = h.start
            WHERE NOT EXISTS (SELECT 1 FROM ({before}) x WHERE x.start = h.start AND x.node = e.b) AND NOT EXISTS (SELECT 1 FROM bars r WHERE r.a = h.start AND r.b = e.b)),
            h{k} AS (SELECT start, b AS node, {k} AS depth, max(score) AS score FROM s{k} WHERE place <= {nearest} GROUP BY 1, 2)"""
    return out


def hop_freshness(spark, d):
    """Parts' partners whose last shipment lies within 60 days of the newest; unknown ones stay."""
    li = read(spark, d, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("at"))
    last = li.groupBy("l_partkey").agg(F.max("at").alias("last"))
    newest = li.agg(F.max("at").alias("newest"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"))
    r = p.join(last, "l_partkey", "left").crossJoin(F.broadcast(newest))  # one row
    return r.where(F.col("last").isNull() | (F.datediff("newest", "last") <= 60)).select("l_partkey", "last")


def cite_edges(spark, d):
    q = items(spark, d)
    r = kept_table(ix.Scan(sources(spark, d), q).rank(q, 5), "ranked")  # read twice
    rows = r.select(F.col("item_id").alias("cluster"), F.col("doc_id").alias("source"), "score").unionByName(r.select(F.col("item_id"), "doc_id", (F.col("score") - 1).alias("s")).toDF("cluster", "source", "score"))
    return rows.groupBy("cluster", "source").agg(F.max("score").alias("score"), F.count("*").alias("recorded"))


def shared_source_edges(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("member"))
    return kn.pair_edges(li, "grp", "member").select("a", "b", "hits")


QUERIES = {
    "level_keys": (level_keys, r"WITH k AS (SELECT item_id, unnest([{'level': 'scenario', 'key': trim(substr(trim(text), 1, 80), '')}, {'level': 'scenario', 'key': substr(trim(substr(text, 1, 30)), 1, 80)}, {'level': 'operation', 'key': substr(trim(text), 1, 80)}, {'level': 'anchor', 'key': substr(trim(substr(text, 10, 40)), 1, 80)}, {'level': 'principle', 'key': substr(trim(regexp_extract(text, '[^\n]*\S[^\n]*')), 1, 80)}]) AS k FROM benchmark) SELECT DISTINCT item_id, k.level AS level, k.key AS key FROM k WHERE k.key <> ''"),
    "cluster_evolve": (cluster_evolve, f"WITH {_EVOLVE} SELECT * FROM c"),
    "cluster_stats": (cluster_stats, f"WITH {_EVOLVE} SELECT CASE WHEN version >= 12 THEN 'stable' WHEN version >= 6 THEN 'emerging' ELSE 'contested' END AS lifecycle, count(*) AS n, round(avg(hotness), 3) AS hotness, sum(least(version, 5))::BIGINT AS queries FROM c GROUP BY 1"),
    "reuse_score": (reuse_score, f"WITH {ITEMS}, {_VEC}, c AS (SELECT x.item_id, sum(x.x * y.x) AS cos FROM v x JOIN v y ON y.item_id + 1 = x.item_id AND x.bucket = y.bucket GROUP BY 1), k AS (SELECT i.item_id, {sql_coverage('i.tokens', 'substr(j.query, 1, 80)')} AS cover FROM items i JOIN items j ON j.item_id + 1 = i.item_id) SELECT item_id, round(greatest(0, coalesce(cos, 0), cover), 6) AS score FROM k LEFT JOIN c USING (item_id)"),
    "relevance_gate": (relevance_gate, f"WITH {ITEMS} SELECT item_id, doc_id, {sql_coverage('tokens', 'text')} >= 0.3 AS relevant FROM items JOIN documents ON contains(text, query)"),
    "find_by_topic": (find_by_topic, "WITH r AS (SELECT c_nationkey || ':' || c_mktsegment AS topic, c_custkey AS cluster, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS place FROM customer) SELECT topic, cluster, place::INT AS place FROM r WHERE place <= 2"),
    "prior_stale": (prior_stale, f"WITH {_STALE} SELECT doc_id % 50 AS cluster, count(*) AS windows, bool_or(bad) AS stale FROM e GROUP BY 1"),
    "try_reuse": (try_reuse, f"WITH {_STALE} SELECT doc_id AS cluster FROM labels JOIN e USING (doc_id) WHERE quality = 1 AND NOT bad"),
    "cluster_review": (cluster_review, f"WITH {_STALE} SELECT doc_id AS cluster, b AS before, CASE WHEN b <> 'stable' AND NOT bad THEN 'stable' ELSE b END AS after FROM (SELECT doc_id, bad, CASE WHEN toxic = 1 THEN 'contested' WHEN quality = 1 THEN 'stable' ELSE 'emerging' END AS b FROM labels JOIN e USING (doc_id))"),
    "cross_topic_near": (cross_topic_near, f"WITH {_PAIRS} SELECT a, b, cosine FROM p WHERE la <> lb"),
    "tidy_pairs": (tidy_pairs, f"WITH {_PAIRS} SELECT a, b, cosine, row_number() OVER (ORDER BY cosine DESC, a, b)::INT AS place FROM p WHERE la = lb ORDER BY place LIMIT 100"),
    "tidy_run": (tidy_run, None),
    "fold_into": (fold_into, f"WITH {_EVOLVE}, e AS (SELECT topic AS id, version::DOUBLE / 40 AS conf, hotness, least(version, 5) AS n FROM c), p AS (SELECT a.id AS winner, b.id AS loser FROM e a JOIN e b ON a.id % 10 = 1 AND b.id = a.id + 1) SELECT id, round(conf, 6) AS conf, hotness, n::INT AS n_queries FROM e WHERE id NOT IN (SELECT winner FROM p) AND id NOT IN (SELECT loser FROM p) UNION ALL SELECT a.id, round((a.conf + b.conf) / 2, 6), greatest(a.hotness, b.hotness), least(a.n + b.n, 5)::INT FROM p JOIN e a ON a.id = winner JOIN e b ON b.id = loser"),
    "save_answers": (save_answers, _SAVE),
    "persist_routing": (persist_routing, "SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'refuse' WHEN n_chars % 100 >= 85 THEN 'evolve' WHEN n_chars % 100 >= 55 THEN CASE WHEN toxic = 1 THEN 'new' ELSE 'merge' END ELSE 'new' END AS route FROM labels JOIN documents USING (doc_id)"),
    "accept_fold": (accept_fold, _ACCEPT),
    "tidy_fixpoint": (tidy_fixpoint, None),
    "detect_conflicts": (detect_conflicts, f"WITH {_CONF} SELECT grp, a, b FROM cf"),
    "conflicts_for": (conflicts_for, f"WITH {_CONF} SELECT cluster, count(*) AS n FROM (SELECT a AS cluster FROM cf UNION ALL SELECT b FROM cf) GROUP BY 1"),
    "cooccur_edges": (cooccur_edges, f"WITH {_CO} SELECT * FROM co"),
    "cooccur_partners": (cooccur_partners, f"WITH {_CO}, w AS (SELECT a, b, weight FROM co UNION ALL SELECT b, a, weight FROM co), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS place FROM w) SELECT a, b, weight, place::INT AS place FROM r WHERE place <= 3"),
    "query_seq_edges": (query_seq_edges, f"WITH {_SEQ} SELECT * FROM sq"),
    "embed_sim_edges": (embed_sim_edges, f"SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS weight FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE weight >= 0.55"),
    "barrier_edges": (barrier_edges, f"WITH {_CONF} SELECT DISTINCT a, b, 1.0::DOUBLE AS weight FROM (SELECT a, b FROM cf UNION ALL SELECT b, a FROM cf)"),
    "graph_expand_2hop": (graph_expand_2hop, f"""WITH {_SEQ}, e AS (SELECT a, b, weight * CASE WHEN kind = 'pathway' THEN 1.5 ELSE 1.0 END AS w FROM sq), s AS (SELECT DISTINCT a AS start FROM e WHERE a LIKE '%:0'),
        d1 AS (SELECT start, b AS node, 1 AS depth, max(w) AS score FROM s JOIN e ON a = start WHERE b <> start GROUP BY 1, 2), d2 AS (SELECT d1.start, e.b AS node, 2 AS depth, max(score + w) AS score FROM d1 JOIN e ON e.a = d1.node WHERE e.b <> d1.start AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.start = d1.start AND x.node = e.b) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, score DESC, node) AS place FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2)) SELECT start, node, depth, round(score, 6)::DOUBLE AS score, place::INT AS place FROM r WHERE place <= 16"""),
    "graph_expand_nearest": (graph_expand_nearest, f"""WITH n AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
        g AS (SELECT n.a, n.b, CASE WHEN abs(x.p_retailprice - y.p_retailprice) > 150 THEN 'barrier' WHEN count(*) >= 2 THEN 'pathway' ELSE 'plain' END AS kind FROM n JOIN part x ON x.p_partkey = n.a JOIN part y ON y.p_partkey = n.b WHERE n.a <> n.b GROUP BY n.a, n.b, x.p_retailprice, y.p_retailprice),
        both_ways AS (SELECT a, b, kind FROM g UNION ALL SELECT b, a, kind FROM g), bars AS (SELECT DISTINCT a, b FROM both_ways WHERE kind = 'barrier'),
        ways AS (SELECT a, b, max(0.6::DOUBLE * CASE WHEN kind = 'pathway' THEN 1.5 ELSE 1.0 END) AS w FROM both_ways WHERE kind <> 'barrier' GROUP BY 1, 2),
        nodes AS (SELECT vec_id AS node, embedding FROM embeddings JOIN part ON p_partkey = vec_id WHERE label <> 9 AND p_size / 50.0 >= 0.1 AND p_retailprice / 1100 >= 0.82), {_hops_sql(3, 6)},
        r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, score DESC, node) AS place FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3))
        SELECT start, node, depth, round(score, 6)::DOUBLE AS score, place::INT AS place FROM r WHERE place <= 40"""),
    "hop_freshness": (hop_freshness, "WITH l AS (SELECT l_partkey, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1) SELECT p_partkey AS l_partkey, last FROM part LEFT JOIN l ON l_partkey = p_partkey WHERE last IS NULL OR (SELECT max(l_shipdate)::DATE FROM lineitem) - last <= 60"),
    "cite_edges": (cite_edges, f"WITH {BM25}, r AS (SELECT item_id AS cluster, doc_id AS source, score FROM ranked WHERE rnk <= 5), b AS (SELECT * FROM r UNION ALL SELECT cluster, source, score - 1 FROM r) SELECT cluster, source, max(score) AS score, count(*) AS recorded FROM b GROUP BY 1, 2"),
    "shared_source_edges": (shared_source_edges, "WITH li AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS m FROM lineitem) SELECT x.m AS a, y.m AS b, count(*) AS hits FROM li x JOIN li y ON x.g = y.g AND x.m < y.m GROUP BY 1, 2"),
}
