"""Filter interaction audit: a histogram of failure masks from which every order of the filters is read off.

Each document's failures of five filters are the bits of a mask, built by one projection of built-in functions. Whether
a text repeats that of a smaller doc_id comes from a groupBy over texts, which travel as their SHA-256. What is left of
the table is 32 cells a part, and all 120 orders of the filters are sums over those cells.

The groupBy carries one narrow row for each text, part and mask, summed before it is shuffled, so a group of copies that
holds a third of all rows sends a few rows from each task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, words_of

#: The filters' letters; the last is the one for repeated texts.
LETTERS = "ABCDE"
#: Characters that no text should hold; fixed by the contract.
SYMBOLS = "#$%&*|"


def failure_mask(text: Column) -> Column:
    """Bits of A (under 200 words), B (under half of the words different), C (over 3 % capitals) and D (symbols), A the lowest; null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own")))
    counts = let(words, lambda x: (x["n"] < 200).cast("int") + 2 * (100 * x["own"] < 50 * x["n"]).cast("int"))
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text)
    return counts + 4 * capitals.cast("int") + 8 * text.rlike(f"[{SYMBOLS}]").cast("int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns part, mask, n, n_good, n_toxic: documents (of quality 1, of toxic 1) with these failures, no empty cells.

    docs has doc_id, text and lang; others are not read. A null text is empty and a null lang the part "". A document
    without doc_id neither repeats another nor is repeated; rows that share doc_id and text don't repeat each other.
    labels has doc_id, quality and toxic; of several rows for a document one with a 1 is enough. No documents, no cells.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce("lang", F.lit("")).alias("part"), failure_mask(F.col("text")).alias("mask"))
    no_id = F.col("doc_id").isNull()  # rows without doc_id meet no label: dealt out by text
    rows = rows.select("*", no_id.alias("no_id"), F.when(no_id, F.hash("digest")).otherwise(F.hash("doc_id")).alias("salt"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(one("quality"), one("toxic"))
    marks = marks.select(F.lit(False).alias("no_id"), F.hash("doc_id").alias("salt"), "doc_id", F.col("quality").alias("good"), "toxic")
    rows = rows.join(marks, ["no_id", "salt", "doc_id"], "left").fillna(False, ["good", "toxic"])
    own = ("digest", "part", "mask", "good", "toxic")
    rows = rows.groupBy("no_id", "salt", "doc_id", *own).agg(F.count("*").alias("n"))
    first = F.when(~F.col("no_id"), F.struct("doc_id", "n"))
    texts = rows.groupBy(*own).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("no_id"), F.col("n")).otherwise(0)).alias("n_loose"), F.min(first).alias("first"))
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))  # a row for each part and mask of a text
    plain = F.col("n_loose") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), plain.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - plain).alias("n"))))
    split = texts.select("part", "good", "toxic", split.alias("x")).where("x.n > 0")
    n = F.col("x.n")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("n_toxic"))


def enumerated(histogram: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the cells alone; an empty histogram gives no rows.

    shapley: what the step's filter removes, summed over all orders: a document that fails k filters is removed by each
    of them in 1/k of the orders.
    """
    orders = ["".join(p) for p in permutations(letters)]
    parts = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))  # 2 ** filters at most
    rows = parts.select("part", "cells", F.explode(F.split(F.lit(",".join(orders)), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    place = lambda letter: F.expr(f"shiftleft(1, instr('{letters}', {letter}) - 1)")
    rows = rows.withColumn("bit", place("substring(filter_order, step, 1)"))
    before = F.expr(f"aggregate(sequence(1, {len(letters)}), 0, (m, k) -> m + if(k < step, shiftleft(1, instr('{letters}', substring(filter_order, k, 1)) - 1), 0))")
    rows = rows.withColumn("before", before)

    def total(value: str, of) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + F.when(of(c["mask"]), c[value]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    clear = lambda m: m.bitwiseAND(F.col("before")) == 0
    removed = lambda m: fails(m) & clear(m)
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + F.when(fails(c["mask"]), c["n"] * F.expr(f"{len(orders)}L") / F.bit_count(c["mask"])).otherwise(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(F.col("before") + F.col("bit")) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & ~clear(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("n_good", removed).alias("good_lost"),
        total("n_toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order, by part: enumerated(cells(docs, labels))."""
    return enumerated(cells(docs, labels))
