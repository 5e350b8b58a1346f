"""Registered queries of event time and sessions, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import telemetry as tm
from ..streaming import windows as wn
from .common import read


def events_tumbling(spark, d):
    t = wn.tumbling(read(spark, d, "events"), "1 hour")
    return t.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def events_sliding(spark, d):
    return wn.sliding(read(spark, d, "events")).select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


def events_session(spark, d):
    s = wn.sessions(read(spark, d, "events"))
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


def _touches(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_id") % 7).alias("doc_id"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.6).alias("weight"))


def session_evidence(spark, d):
    return wn.session_evidence(_touches(spark, d), F.col("event_id"), gap_seconds=36_000)


def session_context(spark, d):
    c = wn.session_context(read(spark, d, "conversations"))
    return c.select("conv_id", "turn", F.length("context").alias("n"), F.sha2("context", 256).alias("digest"))


def reconcile(spark, d):
    """Documents that orders' statuses change: evidence of parts, anchored at suppliers."""
    ch = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") > 40, "deleted").otherwise("active").alias("status"))
    li = read(spark, d, "lineitem")
    ev = li.select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("cluster"), F.lit("live").alias("status"))
    e, review = wn.reconcile(ch, ev, ev.select("doc_id", "cluster"))
    n = e.groupBy("cluster").agg(F.count_if(F.col("status") == "invalid").alias("invalid"), F.count("*").alias("n"))
    return n.join(review.withColumn("emerging", F.lit(True)), "cluster", "left").select("cluster", "invalid", "n", F.coalesce("emerging", F.lit(False)).alias("emerging"))


def telemetry_windows(spark, d):
    """Events as calls: type as mode, the number in props as model and tokens, users in ten namespaces; by day."""
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    calls = e.select("ts", F.col("event_type").alias("mode"), F.concat(F.lit("m"), k % 3).alias("model"), (F.col("user_id") % 10).alias("namespace"), (F.col("value") > 50).alias("reused"), (F.col("event_type") == "error").alias("failed"), F.floor(F.col("value") * 1000).alias("latency"), k.alias("tokens"))
    s = tm.snapshot(tm.counts(calls, "1 day"))
    return s.withColumn("start_us", F.unix_micros(F.col("start").cast("timestamp"))).drop("start")


_TELEMETRY = """WITH c AS (SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type AS mode, 'm' || (json_extract_string(props, '$.k')::BIGINT % 3) AS model, (user_id % 10)::VARCHAR AS ns, coalesce(value > 50, false) AS warm, event_type = 'error' AS bad, floor(value * 1000)::BIGINT AS lat, json_extract_string(props, '$.k')::BIGINT AS tokens FROM events),
    x AS (SELECT c.*, unnest([{'scope': 'all', 'name': ''}, {'scope': 'mode', 'name': coalesce(mode, '')}, {'scope': 'model', 'name': coalesce(model, '')}, {'scope': 'namespace', 'name': coalesce(ns, '')}]) AS s FROM c),
    g AS (SELECT start_us, s.scope AS scope, s.name AS name, count(*) AS queries, count(*) FILTER (warm) AS reused, count(*) FILTER (bad) AS failed, sum(coalesce(tokens, 0))::BIGINT AS tokens,
        list_sort(list(lat) FILTER (warm AND lat IS NOT NULL)) AS w, list_sort(list(lat) FILTER (NOT warm AND NOT bad AND lat IS NOT NULL)) AS c, list_sort(list(lat) FILTER (NOT bad AND lat IS NOT NULL)) AS a FROM x GROUP BY 1, 2, 3)
    SELECT start_us, scope, name, queries, reused, failed, tokens, round(reused::DOUBLE / queries, 6) AS reuse_rate, w[len(w) // 2 + 1] AS warm_p50, c[len(c) // 2 + 1] AS cold_p50, a[len(a) // 2 + 1] AS p50, a[len(a) * 9 // 10 + 1] AS p90 FROM g"""

QUERIES = {
    "telemetry_windows": (telemetry_windows, _TELEMETRY),
    "events_tumbling": (events_tumbling, "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "events_sliding": (events_sliding, "SELECT s AS start_us, count(*) AS n FROM (SELECT unnest([epoch_us(date_trunc('hour', ts)), epoch_us(date_trunc('hour', ts)) - 3600000000]) AS s FROM events) GROUP BY 1"),
    "events_session": (events_session, "WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k"),
    "session_evidence": (session_evidence, """WITH t AS (SELECT user_id AS session, event_id % 7 AS doc_id, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.6 END AS weight, row_number() OVER w AS turn, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 36000000000 THEN 1 ELSE 0 END AS new, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        p AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM t), m AS (SELECT *, max(turn) OVER (PARTITION BY session) AS last, max(part) OVER (PARTITION BY session) AS now FROM p)
        SELECT session, doc_id, weight FROM (SELECT session, doc_id, round(max(weight::DOUBLE * pow(0.6::DOUBLE, last - turn)), 6) AS weight FROM m WHERE part = now GROUP BY 1, 2) WHERE weight >= 0.1"""),
    "session_context": (session_context, "WITH u AS (SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS j FROM conversations WHERE role = 'user'), c AS (SELECT conv_id, turn, substr(j, greatest(1, length(j) - 239), 240) AS c FROM u) SELECT conv_id, turn, length(c)::INT AS n, sha256(c) AS digest FROM c"),
    "reconcile": (reconcile, "WITH e AS (SELECT l_suppkey AS cluster, p_size > 40 AS gone FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) SELECT cluster, count(*) FILTER (gone) AS invalid, count(*) AS n, coalesce(bool_or(gone), false) AS emerging FROM e GROUP BY 1"),
}
