"""Ingest: structure, blocks, versions, evidence marks and accounting over source documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

BLOCK, OVERLAP, SHORTCUT = 8000, 1000, 16_000


def top_line_share(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The commonest non-blank trimmed line's share of all lines; 0 under 32 lines or if no line repeats."""
    lines = docs.select(id_col, F.explode(F.split(text_col, "\n", -1)).alias("line")).withColumn("line", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", ""))
    c = lines.groupBy(id_col, "line").agg(F.count("*").alias("n"))
    t = c.groupBy(id_col).agg(F.sum("n").alias("lines"), F.max(F.when(F.col("line") != "", F.col("n")).otherwise(0)).alias("top"))
    return t.select(id_col, F.when((F.col("lines") < 32) | (F.col("top") <= 1), 0.0).otherwise(F.round(F.col("top") / F.col("lines"), 6)).alias("top_line_share"))


#: A line that begins a span: a heading or a page mark.
_HEADING, _PAGE = r"^#{1,6}[^\S\n]+\S", r"^--- page \d+ ---[^\S\n]*$"


def structure_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, label, start, end): headings and page marks cut the body into spans that tile it; one doc span without marks.

    A span's start is the length of what lies before it, a running sum over the document's spans; only their lengths and
    first lines are shuffled, never the text. A null text is an empty one.
    """
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), f"(?md)(?={_HEADING}|{_PAGE})", -1)
    rows = docs.select(F.col(id_col), F.posexplode(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), F.regexp_extract(p, r"^[^\n]*", 0).alias("line")))).alias("_i", "_p"), F.size(parts).alias("_parts"))
    w = W.partitionBy(id_col).orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("_p.n").over(w), F.lit(0)).cast("int"))
    line = F.col("_p.line")
    kind = F.when(line.rlike(_PAGE), "page").when(line.rlike(_HEADING), "heading").when(F.col("_parts") == 1, "doc").otherwise("preamble")
    label = F.when(line.rlike(_PAGE), F.regexp_extract(line, r"\d+", 0)).when(line.rlike(_HEADING), F.trim(F.regexp_replace(line, r"^#{1,6}\s+", ""))).otherwise("")
    return rows.select(id_col, kind.alias("kind"), label.alias("label"), "start", (F.col("start") + F.col("_p.n")).alias("end"))


def blocks(docs: DataFrame, id_col: str, text_col: str, size: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """docs' ids with block_index, block_start, block_end and the block's text: a fixed size, the last one clamped."""
    overlap = size // 4 if overlap >= size else max(0, overlap)
    stride = size - overlap
    n = F.length(text_col)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / stride).cast("int"))
    rows = docs.withColumn("block_index", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("block_start", F.col("block_index") * stride).withColumn("block_end", F.least(F.col("block_start") + size, n))
    return rows.withColumn("block", F.substring(F.col(text_col), F.col("block_start") + 1, F.col("block_end") - F.col("block_start")))


def by_policy(docs: DataFrame, id_col: str, text_col: str, least: int = SHORTCUT, size: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """Blocks of documents of at least ``least`` characters; the others whole, as block 0."""
    long = blocks(docs.where(F.length(text_col) >= least), id_col, text_col, size, overlap).withColumn("is_block", F.lit(True))
    n = F.length(text_col)
    short = docs.where(n < least).withColumns({"block_index": F.lit(0), "block_start": F.lit(0), "block_end": n, "block": F.col(text_col), "is_block": F.lit(False)})
    return long.unionByName(short)


def block_key(key: Column, index: Column) -> Column:
    return F.concat(F.lit("blk/"), F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")), F.lit("/"), F.lpad(index.cast("string"), 6, "0"))


def versions(rows: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """Puts of a key in order: a put whose digest equals the live one's changes nothing, any other is the next version; the last is active, those before stale."""
    w = W.partitionBy(key).orderBy(*order)
    new = F.coalesce(F.lag(digest).over(w) != F.col(digest), F.lit(True))
    kept = rows.withColumn("_new", new).where("_new").drop("_new")
    kept = kept.withColumn("version", F.row_number().over(w))
    return kept.withColumn("status", F.when(F.lead("version").over(w).isNull(), "active").otherwise("stale"))


def latest(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Each key's values of its last row by order: one pass of partial maxima, whatever the keys' sizes."""
    best = F.max(F.struct(*[F.col(c) for c in [*order, *[v for v in values if v not in order]]])).alias("_b")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"_b.{v}").alias(v) for v in values])


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with changes' rows in place of those of the same key, and new keys added."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def flatten_chat(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A conversation as one text: a line ``role: text`` for each turn, in order."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.concat(F.col(role), F.lit(": "), F.col(text)).alias("x"))))
    return rows.groupBy(conv).agg(F.array_join(F.transform(turns, lambda r: r["x"]), "\n").alias("body"), F.count("*").alias("turns"))


def widest_column(rows: DataFrame, columns: list[str], sample: int = 200, order: list[str] | None = None) -> DataFrame:
    """The text column of a table: that with the most characters over its first rows; one row (column, chars)."""
    head = rows.orderBy(*(order or columns)).limit(sample)
    sums = head.agg(*[F.coalesce(F.sum(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in columns])
    long = sums.select(F.explode(F.array(*[F.struct(F.col(c).cast("long").alias("chars"), F.lit(c).alias("column")) for c in columns])).alias("x"))
    return long.select("x.column", "x.chars").orderBy(F.desc("chars"), "column").limit(1)


def stratified(rows: DataFrame, stratum: str, order: list[str], limit: int) -> DataFrame:
    """Rows taken from each stratum in turn, strata sorted, until the limit."""
    rn = F.row_number().over(W.partitionBy(stratum).orderBy(*order))
    return rows.withColumn("turn", rn).where(F.col("turn") <= limit).orderBy("turn", stratum).limit(limit)


def overlay(rows: DataFrame, ranks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with place: externally ranked keys first, the others after them in their own order."""
    r = rows.join(ranks.groupBy(key).agg(F.min("rank").alias("rank")), key, "left")
    return numbered(r, [F.col("rank").asc_nulls_last(), *order], "rank", order[0]).drop("rank")


def numbered(rows: DataFrame, order: list, first: str, second: str, parts: int = 64) -> DataFrame:
    """rows with place, from 1 in the given order, whose first columns are the numbers ``first`` (null last) and ``second``.

    Ranges of the two, cut at quantiles, are numbered side by side on top of the sizes of those before: no task orders all rows.
    """
    shares = [k / parts for k in range(1, parts)]
    cut = {c: sorted(set(rows.agg(F.percentile_approx(c, shares).alias("b")).first()["b"] or [])) for c in (first, second)}  # fixed numbers of bounds
    part = lambda c: sum((F.when(F.col(c) > b, 1).otherwise(0) for b in cut[c]), F.lit(0))
    # Rows of one first value are cut by the second only where there is no first: else a value's rows stay together.
    rows = rows.withColumn("_part", F.when(F.col(first).isNull(), parts + part(second)).otherwise(part(first)))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a part
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("place", (F.col("_before") + F.col("_own")).cast("int")).drop("_part", "_own", "_before")


def safe_cell(value: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula."""
    return F.when(F.ltrim(value).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def template(pattern: str, columns: list[str]) -> Column:
    """A ``{{field}}`` template as a column; ValueError for a field that isn't there."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", pattern):
        if m[1] not in columns:
            raise ValueError(f"no field {m[1]}")
        parts += [F.lit(pattern[at : m.start()]), F.coalesce(F.col(m[1]).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def mark_evidence(live: DataFrame, marks: DataFrame, active: DataFrame) -> DataFrame:
    """New evidence rows: marks (doc_id, start, end) of active documents whose id isn't there yet."""
    ids = F.concat(F.lit("ev:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"))
    return marks.withColumn("evidence_id", ids).dropDuplicates(["evidence_id"]).join(active, "doc_id", "left_semi").join(live.select("evidence_id"), "evidence_id", "left_anti")


def invalidate(evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """evidence with the status invalid where its document is among those changed."""
    gone = changed.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    return evidence.join(gone, "doc_id", "left").withColumn("status", F.when(F.col("_gone"), "invalid").otherwise(F.col("status"))).drop("_gone")


def skip_reason(path: Column, size: Column, age_days: Column, exts: list[str], most: int, oldest: int) -> Column:
    """Why a file isn't a candidate; null if it is."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    ext = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    return F.when(name.rlike(r"^[.~]"), "hidden").when(~ext.isin(exts), "ext").when(size == 0, "empty").when(size > most, "oversized").when(age_days > oldest, "old")


def autodetect(rows: DataFrame, body: list[str], title: list[str], key: list[str]) -> DataFrame:
    """body, title and key of records: the first present candidate of each; a title defaults to the body's first line (60 characters), a key to title and digest."""
    first = lambda cols: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cols if c in rows.columns], F.lit(None).cast("string"))
    rows = rows.withColumn("body", first(body)).where("body is not null")
    line = F.substring(F.regexp_extract("body", r"[^\n]*\S[^\n]*", 0), 1, 60)
    rows = rows.withColumn("title", F.coalesce(F.when(F.length(first(title)) <= 200, first(title)), line))
    return rows.withColumn("key", F.coalesce(F.when(F.length(first(key)) <= 200, first(key)), F.concat(F.substring("title", 1, 60), F.lit("|"), F.substring(tx.digest(F.col("body")), 1, 8))))
