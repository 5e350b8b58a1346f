"""SpotSigs: chains of content words that follow common words form signatures; their sets are compared by Jaccard.

Everything is built-in functions over arrays. An anchor is any common word; its signature hashes the anchor and the next
content words. With k common words before an anchor at word a, a - k content words lie before it, which gives the
chain's place without a loop. A text without any common word takes every word as an anchor.

Near copies of a corpus are found among sets of like length: a set is dealt to the length partition that its size falls
into and to the next, within which two sets meet by a signature of their prefixes, and Jaccard is worked out only where
the sizes allow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, staged
from .components import components
from .quality import STOP_WORDS

CHAIN = 3


def signatures(text: Column, anchors: list[str] = STOP_WORDS, chain: int = CHAIN) -> Column:
    """The sorted set of 32-bit signatures of a text; null and wordless texts have none."""
    common = sorted(set(anchors))
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def of(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(common))

        def chains(x: Column) -> Column:
            spots, content = x["spots"], x["content"]
            start = lambda a, k: F.when(F.size(spots) == F.size(w), k + 1).otherwise(a - k)
            own = F.transform(spots, lambda a, k: let(start(a, k), lambda s: F.when(F.get(content, s).isNotNull(), F.hash(F.get(w, a), *[F.get(content, s + j) for j in range(chain)]))))
            lone = F.transform(w, lambda x, i: F.hash(x, *[F.get(w, i + 1 + j) for j in range(chain)]))
            return F.sort_array(F.array_distinct(F.when(F.exists(own, lambda x: x.isNotNull()), F.filter(own, lambda x: x.isNotNull())).otherwise(lone)))

        content = F.filter(w, lambda x: ~x.isin(common))
        return let(F.struct(places.alias("spots"), content.alias("content")), chains)

    return let(words, lambda w: F.when(F.size(w) > 0, of(w)).otherwise(F.array().cast("array<int>")))


def written(sigs: Column) -> Column:
    """A signature set as a fingerprint: eight hex digits for each signature, in order."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 1 for two empty ones. 0 where their sizes alone keep it below least, without a comparison."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    value = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(large == 0, 1.0).when(small < large * F.lit(least), 0.0).otherwise(value)


def _lists(sets: DataFrame, least: float) -> DataFrame:
    """(key, sid, n, part, root, root_n, root_part): the sets of each length partition by the signatures of their prefixes, with a list's least set.

    Partition k holds the lengths from least^-k to least^-(k+1): sets that can reach ``least`` lie in one or in two
    neighbouring ones. Of two sets in the order of signatures, the first n - ceil(least * n) + 1 of each must share one.
    """
    part = F.floor(F.log("n") / F.log(F.lit(1 / least)) + 1e-9).cast("int")
    prefix = F.slice("sigs", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int"))
    rows = sets.where("n > 0").select("sid", "n", part.alias("part"), F.explode(prefix).alias("sig"))
    rows = rows.select("sid", "n", "part", F.explode(F.array(F.struct("sig", F.col("part").alias("at")), F.struct("sig", (F.col("part") + 1).alias("at")))).alias("key"))
    roots = rows.groupBy("key").agg(F.min(F.struct("sid", "n", "part")).alias("root"), F.count("*").alias("size")).where("size > 1")
    return rows.join(roots, "key").select("key", "sid", "n", "part", F.col("root.sid").alias("root"), F.col("root.n").alias("root_n"), F.col("root.part").alias("root_part"))


def _close(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v) of those pairs whose sets reach ``least``."""
    x, y = (sets.select(F.col("sid").alias(c), F.col("sigs").alias(f"sigs_{c}")) for c in "uv")
    return pairs.join(x, "u").join(y, "v").where(jaccard(F.col("sigs_u"), F.col("sigs_v"), least) >= least).select("u", "v")


def near_classes(docs: DataFrame, least: float = 0.8, anchors: list[str] = STOP_WORDS, chain: int = CHAIN) -> DataFrame:
    """doc_id, class_id of each row: the least doc_id that links of signature sets of at least this Jaccard lead to.

    Equal sets are one entry, and so are all texts without signatures. In a list every set is compared with the list's
    least; only sets that this leaves in different classes are compared with each other, so no list gives all its pairs.
    Repeated rows and ids stay; null ids name a class only if it has no other. No rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text"), anchors, chain).alias("sigs"))
    rows = staged(rows.withColumn("sid", F.xxhash64("sigs")), "signatures")
    sets = staged(rows.groupBy("sid").agg(F.min("doc_id").alias("holder"), F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs")), "sets")
    fits = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-9
    lists = staged(_lists(sets, least), "lists")
    star = staged(lists.where(F.col("sid") != F.col("root")).where(fits("n", "root_n")).select(F.col("sid").alias("u"), F.col("root").alias("v")).distinct(), "pairs")
    near = staged(_close(star, sets, least), "near")
    found = components(near)
    rest = lists.join(found, F.col("sid") == F.col("node"), "left").select("key", "sid", "n", "part", F.coalesce("label", "sid").alias("label"))
    split = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rest = staged(rest.join(split, "key", "left_semi"), "lists")
    x, y = (rest.select("key", *[F.col(k).alias(f"{k}_{c}") for k in ("sid", "n", "part", "label")]) for c in "uv")
    # Sets of one partition meet there, those of neighbouring ones in the upper one: never twice.
    more = x.join(y, "key").where("sid_u > sid_v and label_u <> label_v").where(F.col("key.at") == F.greatest("part_u", "part_v")).where(fits("n_u", "n_v"))
    more = more.select(F.col("sid_u").alias("u"), F.col("sid_v").alias("v")).distinct().join(star, ["u", "v"], "left_anti")
    found = components(near.unionByName(staged(_close(more, sets, least), "near")))
    named = sets.join(found, F.col("sid") == F.col("node"), "left").select("sid", "holder", F.coalesce("label", "sid").alias("component"))
    whole = named.groupBy("component").agg(F.min("holder").alias("class_id"))
    return rows.select("doc_id", "sid").join(named.select("sid", "component"), "sid").join(whole, "component").select("doc_id", "class_id")


def with_next(rows: DataFrame, id_col: str, columns: tuple[str, ...], parts: int) -> DataFrame:
    """rows with next_<column>: the columns of the row after it in descending id order; after the last comes the first.

    Ids are cut at approximate quantiles into parts, a fixed number of bounds; a part's largest row is also sent to the
    part above, after its last row, so no task orders all rows. Null ids come last, equal ids by the first column.
    """
    shares = [k / parts for k in range(1, parts + 1)]
    found = rows.agg(F.percentile_approx(id_col, shares, 10_000).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    here = F.lit(0)
    if bounds:
        table, steps = F.array(*map(F.lit, bounds)), [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
        here = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(table, lo + s - 1) < F.col(id_col)), lo + s).otherwise(lo))
    rows = rows.withColumn("_part", here)
    if bounds:
        edge = F.get(table, F.col("_part")) == F.col(id_col)
        above = F.when(F.col("_part") == len(bounds) - 1, 0).otherwise(F.col("_part") + 1)
        copies = F.when(edge, F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("copy")), F.struct(above.alias("p"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("copy"))))
        rows = rows.withColumn("_at", F.explode(copies)).withColumns({"_part": F.col("_at.p"), "_copy": F.col("_at.copy")}).drop("_at")
    else:
        rows = rows.withColumn("_copy", F.lit(False))
    order = [F.col("_copy").asc(), F.col(id_col).desc_nulls_last(), F.col(columns[0]).desc_nulls_last()]
    w = W.partitionBy("_part").orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = {f"next_{c}": F.lead(c).over(w) if bounds else F.when(F.lead(F.lit(1)).over(w) == 1, F.lead(c).over(w)).otherwise(F.first(c).over(whole)) for c in columns}
    return rows.withColumns(follows).where(~F.col("_copy")).drop("_part", "_copy")


def compared(docs: DataFrame, anchors: list[str] = STOP_WORDS, chain: int = CHAIN, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document; see the contract of op5.

    A null text is empty. Equal ids follow each other by text; null ids come last. A lone row is its own next. No rows
    give none; other columns are ignored.
    """
    parts = parts or min(4096, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sigs", signatures(F.col("text"), anchors, chain)), "doc_id", ("text", "sigs"), parts)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), signatures(e, anchors, chain).alias("sigs"))).alias("edited"))
    both = let(F.col("edited.sigs"), lambda e: F.struct(written(e).alias("print"), jaccard(F.col("sigs"), e).alias("near")))
    rows = rows.withColumn("both", both)
    return rows.select("doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), written(F.col("sigs")).alias("fingerprint"), F.col("both.print").alias("edited_fingerprint"), F.col("both.near").alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
