"""Registered queries of the sampling arms that draw from hashes, of greedy filters and of text repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as sq
from ..operators import evidence as ev
from ..operators import knowledge as kn
from ..operators import lexicon
from .common import read, sources


def gaussian_windows(spark, d):
    """A window around each document's middle, moved by a normal deviate drawn from its hash."""
    s = sources(spark, d).withColumn("centre", F.floor(F.length("body") / 2).cast("int"))
    return ev.jittered(s, "body", "centre").select("doc_id", "start", "end")


def scatter_windows(spark, d):
    return ev.scattered(sources(spark, d), "body", 3).select("doc_id", "slot", "start", "end")


def arm_slots(spark, d):
    """Slots of sampling arms by weight: events' types as arms of a user's query."""
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("item_id"), F.col("event_type").alias("arm")).agg(F.count("*").cast("double").alias("weight"))
    return ev.arm_slots(e, 8).select("item_id", "arm", "slots")


def filter_dissimilar(spark, d):
    """Turns of a conversation that differ enough from those kept before them, in order."""
    t = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    kept = lexicon.dissimilar(F.transform("turns", lambda x: x["text"]))
    return t.select("conv_id", F.size("turns").cast("long").alias("n"), F.size(kept).cast("long").alias("kept"))


def repair_json(spark, d):
    e = read(spark, d, "events")
    said = F.concat(F.lit("<think>a {b}</think> Sure {it is}: "), F.col("props"), F.lit(" done }"))
    return e.select("event_id", F.get_json_object(sq.salvage_json(said), "$.k").cast("long").alias("k"))


def renumber_citations(spark, d):
    s = sources(spark, d)
    text = F.concat(F.lit("see [2], [5] and [9]; "), F.translate("body", "[]", ""))
    return s.select("doc_id", sq.renumber(text, F.create_map(F.lit(2), F.lit(1), F.lit(5), F.lit(2))).alias("text"))


def detect_conflict_states(spark, d):
    """Clusters that a conflict makes contested: both ends of every differing claim."""
    from .knowledge import _claims

    c = kn.claim_classes(_claims(spark, d), "grp").where("others > 0")
    return c.select(F.col("id").alias("cluster")).distinct().withColumn("lifecycle", F.lit("contested"))


QUERIES = {
    "gaussian_windows": (gaussian_windows, None),
    "scatter_windows": (scatter_windows, None),
    "arm_slots": (arm_slots, "WITH e AS (SELECT user_id AS item_id, event_type AS arm, count(*) AS weight FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, arm) AS k, count(*) OVER (PARTITION BY item_id) AS n FROM e) SELECT item_id, arm, CASE WHEN k = 1 THEN greatest(1, 8 - n + 1) ELSE 1 END::BIGINT AS slots FROM r"),
    "filter_dissimilar": (filter_dissimilar, None),
    "repair_json": (repair_json, "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events"),
    "renumber_citations": (renumber_citations, "SELECT doc_id, 'see [1], [2] and [9]; ' || replace(replace(text, '[', ''), ']', '') AS text FROM documents"),
    "contested_clusters": (detect_conflict_states, "WITH c AS (SELECT source AS grp, regexp_extract(text, '[0-9]+') AS claim, min(doc_id) AS id FROM documents GROUP BY 1, 2), cf AS (SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON x.grp = y.grp AND x.id < y.id AND x.claim <> y.claim WHERE x.claim <> '' AND y.claim <> '') SELECT DISTINCT cluster, 'contested' AS lifecycle FROM (SELECT a AS cluster FROM cf UNION ALL SELECT b FROM cf)"),
}
