"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the words and a weight that changes linearly over the training time 0..1. The integral of
its weight is the demand that has built up by a time; a document's place in its source's shuffled stream of words,
inverted through that demand, is its training position. Streams repeat a source at most twice. Places come from prefix
sums over hash buckets: a source that holds a third of all words is spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import word_count

WEIGHTS, SHARE, LIMIT, BUCKETS = (5.0, 2.0, 1.0), 1.5, 2.0, 1024
#: For each weight in turn: how much the source's rate exceeds its mean at time 0; it falls short by as much at time 1.
LEAN = (0.5, 0.0, -0.5)


def targets(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, lean: tuple[float, ...] = LEAN) -> DataFrame:
    """source, source_size, target, lean from one row (source, source_size) for each source.

    Sources by code point, null last, take the weights in turn. What is above limit times a source's size is shared
    anew by weight until none is above: the common rate at which it all fits, found from the sources in the order in
    which they fill up. One task orders the sources' rows, one for each source.
    """
    whole, rest = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("fills", "nr").rowsBetween(W.currentRow, W.unboundedFollowing)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("nr") % len(values) + 1).cast("int"))
    rows = sums.withColumn("nr", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumns({"weight": pick(weights), "lean": pick(lean), "most": F.col("source_size") * F.lit(limit)})
    rows = rows.withColumn("fills", F.col("most") / F.col("weight"))
    before = W.orderBy("fills", "nr").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"total": F.sum("source_size").over(whole) * F.lit(share), "full": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "heavy": F.sum("weight").over(rest)})
    rows = rows.withColumn("rate", F.when(F.col("fills") * F.col("heavy") + F.col("full") >= F.col("total"), (F.col("total") - F.col("full")) / F.col("heavy")))
    rows = rows.withColumn("rate", F.max("rate").over(whole))  # beyond the first that fits, rates only fall
    target = F.when(F.col("rate").isNull(), F.col("most")).otherwise(F.least("most", F.col("rate") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"), "lean")


def when_reached(part: Column, lean: Column) -> Column:
    """The time at which a share of the source's words is due, where demand(t) = t + lean * (t - t²)."""
    b = 1 + lean
    return F.when(lean == 0, part).otherwise((b - F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * lean * part))) / (2 * lean))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, lean: tuple[float, ...] = LEAN, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, takes (words and position of each copy).

    size is the text's number of words (null: 0). A source's stream is its documents in hash order, then the same again,
    up to its target; the document at the end is cut there. Documents without words take nothing and have no position.
    Rows are mixed one by one: repeated rows each have a place of their own, and which of equal rows comes first
    doesn't matter. No documents give no rows. keep: further columns to carry.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text")).alias("key"), *[F.col(f"`{k}`").alias(f"keep_{k}") for k in keep])
    rows = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit, lean)
    order = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("words").over(order), F.lit(0)))
    base = base.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("s"), F.col("bucket").alias("b"), "base", "source_size", "target", "lean")
    rows = rows.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")

    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    goal_words = F.round("target").cast("long")

    def copy(k: int) -> Column:
        at = F.col("at") + k * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal_words - at))
        return F.struct(words.alias("words"), when_reached((at + words / 2) / F.col("target"), F.col("lean")).alias("position"))

    copies = F.filter(F.array(*[copy(k) for k in range(int(limit) + (limit % 1 > 0))]), lambda x: x["words"] > 0)
    rows = rows.withColumn("takes", copies)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "takes", *[F.col(f"`keep_{k}`").alias(k) for k in keep])


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word and the white space after it."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.array_join(F.slice(parts, 1, (n + lead).cast("int")), "")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The training stream: the columns of docs, a row for each copy that the mix takes, sorted by position over all partitions.

    A null text and a null source are as in mix(): no words, so no row, and a source of its own. A text of which the mix
    takes a part is cut there. Repeated rows are mixed one by one. Columns keep their values whatever their names; only
    doc_id, source and text mean anything here. An empty table gives an empty one.
    """
    names = list(docs.columns)
    own = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(names)])
    rows = mix(own, keep=tuple(f"own_{k}" for k in range(len(names))), **options)
    rows = rows.withColumn("take", F.explode("takes")).drop("takes")
    text = F.col(f"own_{names.index('text')}")
    cut = F.when(F.col("take.words") < F.col("size"), first_words(text, F.col("take.words"))).otherwise(text)
    rows = rows.withColumns({f"own_{names.index('text')}": cut, "position": F.col("take.position")})
    rows = rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return rows.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(names)])
