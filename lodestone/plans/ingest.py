"""Registered queries of ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ingest as ing
from .common import read, sources


def store_filter_project(spark, d):
    o = read(spark, d, "orders")
    f = o.where(F.col("o_orderstatus").isin("O", "F") & (F.col("o_totalprice") >= 100000) & (F.col("o_totalprice") < 300000))
    return f.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").offset(10).limit(500)


def _revisions(spark, d):
    """A history for sources: each page's revisions are its customers' orders by date."""
    o = read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("key"), "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("digest"))


_REV = "r AS (SELECT o_custkey AS key, o_orderdate, o_orderkey, o_orderpriority AS digest FROM orders)"
_CHAIN = f"""{_REV}, n AS (SELECT *, lag(digest) OVER (PARTITION BY key ORDER BY o_orderdate, o_orderkey) AS p FROM r),
    v AS (SELECT key, o_orderdate, o_orderkey, digest, row_number() OVER (PARTITION BY key ORDER BY o_orderdate, o_orderkey) AS version FROM n WHERE p IS NULL OR p <> digest),
    s AS (SELECT *, CASE WHEN lead(version) OVER (PARTITION BY key ORDER BY version) IS NULL THEN 'active' ELSE 'stale' END AS status FROM v)"""


def version_chain(spark, d):
    return ing.versions(_revisions(spark, d), "key", ["o_orderdate", "o_orderkey"], "digest").select("key", "o_orderkey", "version", "status")


def active_sources(spark, d):
    return ing.versions(_revisions(spark, d), "key", ["o_orderdate", "o_orderkey"], "digest").where("status = 'active'").select("key", "version", "digest")


def latest_revision(spark, d):
    return ing.latest(_revisions(spark, d), "key", ["o_orderdate", "o_orderkey"], ["o_orderkey", "digest"])


def asof_latest(spark, d):
    """The last revision of each key before 1997."""
    r = _revisions(spark, d).where(F.col("o_orderdate") < F.lit("1997-01-01").cast("date"))
    return ing.latest(r, "key", ["o_orderdate", "o_orderkey"], ["o_orderkey", "digest"])


def sources_by_ids(spark, d):
    ids = read(spark, d, "labels").where("quality = 1").select("doc_id")
    return sources(spark, d).join(ids, "doc_id", "left_semi").select("doc_id", "uri", "n_chars")


def _evidence(spark, d):
    """Evidence rows from line items: documents are parts, scores come from quantities."""
    li = read(spark, d, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), F.col("l_partkey").alias("doc_id"), (F.col("l_quantity") / 5).cast("double").alias("score"), F.when(F.col("l_returnflag") == "R", "invalid").otherwise("live").alias("status"))


_EV = "ev AS (SELECT l_orderkey || '-' || l_linenumber AS evidence_id, l_partkey AS doc_id, (l_quantity / 5)::DOUBLE AS score, CASE WHEN l_returnflag = 'R' THEN 'invalid' ELSE 'live' END AS status FROM lineitem)"


def active_evidence(spark, d):
    e = _evidence(spark, d).where("status = 'live' and score >= 7")
    return e.orderBy(F.desc("score"), "evidence_id").limit(200).select("evidence_id", F.round("score", 6).alias("score"))


def revision_id(spark, d):
    s = sources(spark, d)
    key = F.coalesce(F.nullif(F.col("uri"), F.lit("")), F.substring(tx.digest(F.col("body")), 1, 16))
    return s.select("doc_id", F.concat(F.lit("src:"), key, F.lit("#"), F.col("doc_id").cast("string")).alias("revision"))


def _marked(spark, d):
    """Documents with a heading put in front of every tenth line and a page mark at the end."""
    return sources(spark, d).select("doc_id", F.concat(F.lit("intro\n# Part one\n"), F.col("body"), F.lit("\n--- page 2 ---\ntail")).alias("body"))


def structure_spans(spark, d):
    return ing.structure_spans(_marked(spark, d), "doc_id", "body")


_SPANS = """s AS (SELECT doc_id, 'preamble' AS kind, '' AS label, 0 AS start, 6 AS "end" FROM documents
    UNION ALL SELECT doc_id, 'heading', 'Part one', 6, (17 + length(text) + 1)::INT FROM documents
    UNION ALL SELECT doc_id, 'page', '2', (17 + length(text) + 1)::INT, (17 + length(text) + 1 + 19)::INT FROM documents)"""


def locate_span(spark, d):
    """The span in which each document's middle lies."""
    m = _marked(spark, d)
    spans = ing.structure_spans(m, "doc_id", "body").alias("s")
    mid = m.select("doc_id", F.floor(F.length("body") / 2).cast("int").alias("at"))
    return mid.join(spans, "doc_id").where("start <= at and at < end").select("doc_id", "kind", "label")


def block_split(spark, d):
    b = ing.blocks(sources(spark, d), "doc_id", "body", 2000, 250)
    return b.select("doc_id", "block_index", "block_start", "block_end", F.sha2("block", 256).alias("digest"))


def _blocks_sql(size, over, where="true"):
    stride = size - over
    return f"""b0 AS (SELECT doc_id, source, text, length(text) AS n, CASE WHEN length(text) <= {size} THEN 0 ELSE ceil((length(text) - {size})::DOUBLE / {stride})::INT END AS k FROM documents WHERE {where}),
    b1 AS (SELECT *, unnest(range(0, k + 1))::INT AS block_index FROM b0),
    blk AS (SELECT doc_id, source, block_index, block_index * {stride} AS block_start, least(block_index * {stride} + {size}, n)::INT AS block_end, substr(text, block_index * {stride} + 1, {size}) AS block FROM b1)"""


def block_policy(spark, d):
    b = ing.by_policy(sources(spark, d), "doc_id", "body", 16000, 8000, 1000)
    return b.select("doc_id", "block_index", "block_start", "block_end", "is_block")


def block_keys(spark, d):
    b = ing.blocks(sources(spark, d), "doc_id", "body", 8000, 1000)
    return b.select("doc_id", "block_index", ing.block_key(F.concat(F.col("uri"), F.lit(" é/"), F.col("key")), F.col("block_index")).alias("block_key"))


def orphan_blocks(spark, d):
    """Blocks that a shorter revision leaves behind: live blocks were cut at 2000, the new count comes from half the text."""
    live = ing.blocks(sources(spark, d), "doc_id", "body", 2000, 0).select("doc_id", "block_index")
    n = sources(spark, d).select("doc_id", F.greatest(F.lit(1), F.ceil(F.floor(F.length("body") / 2) / 2000)).alias("now"))
    return live.join(n, "doc_id").where("block_index >= now").select("doc_id", "block_index")


def reclaim_plan(spark, d):
    """Parts of deleted documents: evidence whose part was returned somewhere, by status."""
    gone = _evidence(spark, d).where("status = 'invalid'").select("doc_id")
    return ing.invalidate(_evidence(spark, d), gone).groupBy("doc_id", "status").agg(F.count("*").alias("n"))


def mark_evidence(spark, d):
    marks = sources(spark, d).select("doc_id", F.lit(0).alias("start"), F.least(F.lit(480), F.length("body")).alias("end"))
    live = marks.where("doc_id % 3 = 0").select(F.concat_ws(":", F.lit("ev"), "doc_id", "start", "end").alias("evidence_id"))
    return ing.mark_evidence(live, marks, read(spark, d, "labels").select("doc_id")).select("evidence_id", "doc_id")


def adapt_fields(spark, d):
    p = read(spark, d, "pages").select(F.col("url").alias("id"), F.lit("").alias("title"), tx.extract_html(F.col("html")).alias("content"))
    a = ing.autodetect(p, ["text", "content"], ["title", "name"], ["key", "id"])
    return a.select("key", F.sha2("title", 256).alias("title_digest"), F.length("body").alias("n"))


def adapt_widest_text_col(spark, d):
    return ing.widest_column(read(spark, d, "documents").select("doc_id", "text", "lang", "source"), ["text", "lang", "source"], 200, ["doc_id"])


def flatten_conversations(spark, d):
    f = ing.flatten_chat(read(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return f.select("conv_id", "turns", F.sha2("body", 256).alias("digest"))


def map_template(spark, d):
    n = read(spark, d, "nation")
    return n.select("n_nationkey", ing.template("{{n_name}} of region {{ n_regionkey }}.", n.columns).alias("line"))


def ingest_counts(spark, d):
    r = _revisions(spark, d)
    v = ing.versions(r, "key", ["o_orderdate", "o_orderkey"], "digest").groupBy("key").agg(F.count("*").alias("written"))
    return r.groupBy("key").agg(F.count("*").alias("puts")).join(v, "key").select("key", "written", (F.col("puts") - F.col("written")).alias("unchanged"))


def stratified_sample(spark, d):
    return ing.stratified(sources(spark, d), "lang", ["doc_id"], 50).select("doc_id", "lang", "turn")


def rank_overlay(spark, d):
    ranks = read(spark, d, "labels").where("quality = 0").select("doc_id", F.col("doc_id").alias("rank"))
    return ing.overlay(sources(spark, d).select("doc_id", "n_chars"), ranks, "doc_id", ["doc_id"]).select("doc_id", "place")


def upsert_versions(spark, d):
    base = read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    ch = read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("name"))
    return ing.upsert(base, ch, "s_suppkey")


def safe_csv(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.col("c_acctbal").cast("decimal(12,2)").cast("string")).otherwise(F.concat(F.lit(" ="), F.col("c_name"))).alias("cell"))
    return c.select("c_custkey", ing.safe_cell(F.col("cell")).alias("cell"))


def parquet_probe(spark, d):
    t = read(spark, d, "documents")
    return t.agg(F.count("*").alias("n_rows"), *[F.count(F.col(c).cast("string")).alias(f"n_{c}") for c in ("doc_id", "text", "lang")])


def json_extract(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


QUERIES = {
    "store_filter_project": (store_filter_project, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 100000 AND o_totalprice < 300000 ORDER BY o_orderkey LIMIT 500 OFFSET 10"),
    "version_chain": (version_chain, f"WITH {_CHAIN} SELECT key, o_orderkey, version::INT AS version, status FROM s"),
    "active_sources": (active_sources, f"WITH {_CHAIN} SELECT key, version::INT AS version, digest FROM s WHERE status = 'active'"),
    "latest_revision": (latest_revision, f"WITH {_REV}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM r) SELECT key, o_orderkey, digest FROM k WHERE i = 1"),
    "asof_latest": (asof_latest, f"WITH {_REV}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM r WHERE o_orderdate < DATE '1997-01-01') SELECT key, o_orderkey, digest FROM k WHERE i = 1"),
    "sources_by_ids": (sources_by_ids, "SELECT doc_id, source AS uri, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "active_evidence": (active_evidence, f"WITH {_EV} SELECT evidence_id, round(score, 6) AS score FROM ev WHERE status = 'live' AND score >= 7 ORDER BY score DESC, evidence_id LIMIT 200"),
    "revision_id": (revision_id, "SELECT doc_id, 'src:' || coalesce(nullif(source, ''), substr(sha256(text), 1, 16)) || '#' || doc_id AS revision FROM documents"),
    "structure_spans": (structure_spans, f"WITH {_SPANS} SELECT * FROM s"),
    "locate_span": (locate_span, f"WITH {_SPANS}, m AS (SELECT doc_id, (17 + length(text) + 1 + 19) // 2 AS mid FROM documents) SELECT doc_id, kind, label FROM m JOIN s USING (doc_id) WHERE start <= mid AND mid < \"end\""),
    "block_split": (block_split, f"WITH {_blocks_sql(2000, 250)} SELECT doc_id, block_index, block_start, block_end, sha256(block) AS digest FROM blk"),
    "block_policy": (block_policy, f"WITH {_blocks_sql(8000, 1000, 'length(text) >= 16000')} SELECT doc_id, block_index, block_start, block_end, true AS is_block FROM blk UNION ALL SELECT doc_id, 0, 0, length(text)::INT, false FROM documents WHERE length(text) < 16000"),
    "block_keys": (block_keys, f"WITH {_blocks_sql(8000, 1000)} SELECT doc_id, block_index, 'blk/' || source || '%20%C3%A9%2F' || doc_id || '/' || lpad(block_index::VARCHAR, 6, '0') AS block_key FROM blk"),
    "orphan_blocks": (orphan_blocks, f"WITH {_blocks_sql(2000, 0)} SELECT b.doc_id, block_index FROM blk b JOIN documents d USING (doc_id) WHERE block_index >= greatest(1, ceil((length(d.text) // 2)::DOUBLE / 2000))"),
    "reclaim_plan": (reclaim_plan, f"WITH {_EV}, g AS (SELECT DISTINCT doc_id FROM ev WHERE status = 'invalid') SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM g) THEN 'invalid' ELSE status END AS status, count(*) AS n FROM ev GROUP BY 1, 2"),
    "mark_evidence": (mark_evidence, "SELECT 'ev:' || doc_id || ':0:' || least(480, length(text)) AS evidence_id, doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM labels)"),
    "adapt_fields": (adapt_fields, None),
    "adapt_widest_text_col": (adapt_widest_text_col, "WITH h AS (SELECT * FROM documents ORDER BY doc_id LIMIT 200) SELECT \"column\", chars::BIGINT AS chars FROM (SELECT 'text' AS \"column\", sum(length(text)) AS chars FROM h UNION ALL SELECT 'lang', sum(length(lang)) FROM h UNION ALL SELECT 'source', sum(length(source)) FROM h) ORDER BY chars DESC, \"column\" LIMIT 1"),
    "flatten_conversations": (flatten_conversations, "SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text)) AS digest FROM conversations GROUP BY 1"),
    "map_template": (map_template, "SELECT n_nationkey, n_name || ' of region ' || n_regionkey || '.' AS line FROM nation"),
    "ingest_counts": (ingest_counts, f"WITH {_CHAIN}, w AS (SELECT key, count(*) AS written FROM s GROUP BY 1) SELECT key, written, (SELECT count(*) FROM r WHERE r.key = w.key) - written AS unchanged FROM w"),
    "stratified_sample": (stratified_sample, "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, lang, turn::INT AS turn FROM r ORDER BY turn, lang LIMIT 50"),
    "rank_overlay": (rank_overlay, "SELECT d.doc_id, row_number() OVER (ORDER BY l.doc_id NULLS LAST, d.doc_id)::INT AS place FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON d.doc_id = l.doc_id"),
    "upsert_versions": (upsert_versions, "SELECT s_suppkey, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0"),
    "safe_csv": (safe_csv, "SELECT c_custkey, '''' || CASE WHEN c_acctbal < 0 THEN c_acctbal::DECIMAL(12, 2)::VARCHAR ELSE ' =' || c_name END AS cell FROM customer"),
    "parquet_probe": (parquet_probe, "SELECT count(*) AS n_rows, count(doc_id) AS n_doc_id, count(text) AS n_text, count(lang) AS n_lang FROM documents"),
    "json_extract": (json_extract, "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events"),
}
