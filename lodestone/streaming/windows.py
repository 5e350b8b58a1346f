"""Streams: event-time windows, changelog reconciliation and per-session evidence, with batch forms of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of value in windows of event time; with a watermark on streams."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user, closed by a gap."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream's events once each, remembered for as long as they may come late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def reconcile(changes: DataFrame, evidence: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, clusters to review) after changed documents (doc_id, status): evidence of those no longer active is invalid, clusters anchored there emerge again. Applying it twice changes nothing more."""
    gone = changes.where("status <> 'active'").select("doc_id").distinct()
    bad = gone.withColumn("_gone", F.lit(True))
    e = evidence.join(bad, "doc_id", "left").withColumn("status", F.when(F.col("_gone"), "invalid").otherwise(F.col("status"))).drop("_gone")
    return e, anchors.join(gone, "doc_id", "left_semi").select("cluster").distinct()


def follow(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Consumes a changelog stream in batches from a durable place; apply must be idempotent, as a batch may come again."""
    w = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def session_evidence(turns: DataFrame, order: Column, decay: float = 0.6, floor: float = 0.1, cap: int = 40, gap_seconds: int = 1800) -> DataFrame:
    """(session, doc_id, weight) after each session's last turn: each touch (session, ts, doc_id, weight) fades by 0.6 a turn; touches under 0.1 or before a 30-minute pause are gone."""
    w = W.partitionBy("session").orderBy("ts", order)
    s = F.unix_micros("ts")
    t = turns.withColumn("_new", F.when(s - F.lag(s).over(w) > gap_seconds * 1_000_000, 1).otherwise(0))
    t = t.withColumn("_part", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_turn", F.row_number().over(w))
    every = W.partitionBy("session")
    t = t.withColumns({"_last": F.max("_turn").over(every), "_now": F.max("_part").over(every)}).where("_part = _now")
    t = t.withColumn("w", F.col("weight") * F.pow(F.lit(decay), F.col("_last") - F.col("_turn"))).groupBy("session", "doc_id").agg(F.round(F.max("w"), 6).alias("weight"))
    r = t.where(F.col("weight") >= floor).withColumn("_r", F.row_number().over(every.orderBy(F.desc("weight"), "doc_id")))
    return r.where(F.col("_r") <= cap).drop("_r")


class SessionStack:
    """Keyed state of the same evidence on a stream, for ``groupBy('session').applyInPandasWithState``: rows (session, ts, doc_id, weight) in, the stack's rows out."""

    OUT, STATE = "session long, doc_id long, weight double", "docs array<long>, weights array<double>, last double"

    def __init__(self, decay: float = 0.6, floor: float = 0.1, cap: int = 40, ttl: float = 1800.0):
        self.decay, self.floor, self.cap, self.ttl = decay, floor, cap, ttl

    def fold(self, docs: dict, last: float | None, rows) -> tuple[dict, float | None]:
        """The stack and its last second after more rows (second, doc_id, weight) in order."""
        for t, doc, weight in rows:
            if last is not None and t - last > self.ttl:
                docs = {}
            docs = {k: v * self.decay for k, v in docs.items() if v * self.decay >= self.floor}
            docs[doc], last = max(docs.get(doc, 0.0), weight), t
        return docs, last

    def best(self, docs: dict) -> list[tuple]:
        """(doc_id, weight) of the heaviest, ties by id."""
        return sorted(docs.items(), key=lambda x: (-x[1], x[0]))[: self.cap]

    def __call__(self, key, batches, state):
        import pandas as pd

        docs, last = {}, None
        if state.exists:
            d, w, last = state.get
            docs = dict(zip(d, w))
        for pdf in batches:
            rows = pdf.sort_values("ts")[["ts", "doc_id", "weight"]].itertuples(index=False)
            docs, last = self.fold(docs, last, ((ts.timestamp(), doc, weight) for ts, doc, weight in rows))
        top = self.best(docs)
        state.update(([k for k, _ in top], [v for _, v in top], last or 0.0))
        yield pd.DataFrame({"session": [key[0]] * len(top), "doc_id": [k for k, _ in top], "weight": [v for _, v in top]})


class SessionProcessor(StatefulProcessor):
    """The stack as keyed state that a timer of event time ends: see session_stacks()."""

    def __init__(self, stack: SessionStack):
        self.stack = stack

    def init(self, handle):
        self.handle, self.state = handle, handle.getValueState("stack", SessionStack.STATE)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        docs, last = {}, None
        if self.state.exists():
            d, w, last = self.state.get()
            docs = dict(zip(d, w))
        pdf = pd.concat(rows).sort_values(["ts", "doc_id"])
        docs, last = self.stack.fold(docs, last, ((ts.timestamp(), doc, weight) for ts, doc, weight in zip(pdf["ts"], pdf["doc_id"].tolist(), pdf["weight"].tolist())))
        top = self.stack.best(docs)
        self.state.update(([k for k, _ in top], [v for _, v in top], last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((last + self.stack.ttl) * 1000) + 1)
        yield self._rows(key, last, top)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.state.get()[2]
        self.state.clear()
        yield self._rows(key, last, [(None, None)])

    @staticmethod
    def _rows(key, last, top):
        import pandas as pd

        ids, weights = pd.array([k for k, _ in top], "Int64"), pd.array([v for _, v in top], "Float64")
        return pd.DataFrame({"session": key[0], "at": round(last * 1_000_000), "doc_id": ids, "weight": weights})


def session_stacks(turns: DataFrame, late: str = "10 minutes", stack: SessionStack | None = None) -> DataFrame:
    """A stream of touches (session, ts, doc_id, weight) as the stream of its sessions' stacks (session, at, doc_id, weight).

    Each micro-batch gives a touched session's whole stack, with its last touch's time in microseconds; rows with the
    same session and a later ``at`` take its place. Once the watermark is half an hour behind a session's last touch, its
    state is dropped and one row without a doc_id says so. Touches of one micro-batch are taken in order of time and
    doc_id. Nulls have no place here.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = turns.select("session", "ts", "doc_id", "weight").withWatermark("ts", late)
    processor = SessionProcessor(stack or SessionStack())
    return rows.groupBy("session").transformWithStateInPandas(processor, "session long, at long, doc_id long, weight double", "Update", "EventTime")


def session_context(turns: DataFrame, most: int = 240) -> DataFrame:
    """Each user turn with the last three user turns' texts joined, at most 240 characters from the end."""
    u = turns.where("role = 'user'")
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text")).over(w)), lambda x: x["text"]), " ")
    return u.select("conv_id", "turn", F.substring(joined, F.greatest(F.lit(1), F.length(joined) - most + 1), F.lit(most)).alias("context"))
