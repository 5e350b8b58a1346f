"""Vocabulary, set similarity and windows over token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import kept_table


def gold_pairs(queries: DataFrame, docs: DataFrame, index=None) -> DataFrame:
    """Queries beside the documents that contain them verbatim.

    A document that contains a query contains the query's inner tokens whole, so candidates come from an equi-join on one of
    them; queries with fewer than three tokens are tested by all. index: of the documents, which has the queries' terms
    counted; then that is each query's rarest, and the texts are read for the candidates alone. Without one it is the longest.
    """
    inner = F.when(F.size("tokens") >= 3, F.slice("tokens", 2, F.greatest(F.size("tokens") - 2, F.lit(1))))
    long, short = queries.where(inner.isNotNull()), queries.where(inner.isNull())
    if index is None:
        long = long.withColumn("_key", F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"])
        tokens = docs.select("doc_id", F.explode(F.array_distinct(tx.fields(F.col("body")))).alias("_key")).join(long.select("_key").distinct(), "_key", "left_semi")
    else:
        terms = long.select("item_id", "query", F.explode(F.array_distinct(inner)).alias("term")).join(index.df, "term", "left")
        keys = kept_table(terms.groupBy("item_id", "query").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))["term"].alias("_key")), "keys")
        tokens = index.tf.select("doc_id", F.col("term").alias("_key")).join(keys.select("_key").distinct(), "_key", "left_semi")
        long = long.join(keys, ["item_id", "query"])
    near = long.join(tokens, "_key").drop("_key")
    near = (near if index is None else kept_table(near, "candidates")).join(docs, "doc_id").where(F.contains("body", "query"))
    return near.unionByName(short.join(docs, F.contains("body", "query"))) if not short.isEmpty() else near


def jaccard_pairs(rows: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(a, b, jaccard) of rows that share tokens, through an inverted index of tokens, of at least ``least``."""
    t = rows.select(F.col(id_col).alias("id"), tx.jaccard_tokens(F.col(text_col)).alias("t")).withColumn("n", F.size("t"))
    p = t.select("id", "n", F.explode("t").alias("term"))
    a, b = p.select(F.col("id").alias("a"), F.col("n").alias("na"), "term"), p.select(F.col("id").alias("b"), F.col("n").alias("nb"), "term")
    k = a.join(b, "term").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    j = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return k.where(j >= least).select("a", "b", F.round(j, 6).alias("jaccard"))


def dissimilar(texts, most: float = 0.5):
    """The texts of an array, in order, whose token sets stay below ``most`` Jaccard against all those kept before: a fold over the array."""

    def step(kept, text):
        t = tx.jaccard_tokens(F.coalesce(text, F.lit("")))

        def far(k):
            both = F.size(F.array_intersect(t, k["tokens"]))
            return both < most * (F.size(t) + F.size(k["tokens"]) - both)

        ok = F.forall(kept, lambda k: far(k) | ((F.size(t) == 0) & (F.size(k["tokens"]) == 0)))
        return F.when(ok, F.concat(kept, F.array(F.struct(text.alias("text"), t.alias("tokens"))))).otherwise(kept)

    begin = F.array().cast("array<struct<text:string,tokens:array<string>>>")
    return F.transform(F.aggregate(texts, begin, step), lambda k: k["text"])


def keep_dissimilar(queries: list[str], tried: list[str], most: float = 0.5) -> list[str]:
    """Queries in order whose token sets stay below ``most`` Jaccard against those tried and kept; for a query's few rewrites."""

    def tokens(s):
        import re

        out = set()
        for t in s.lower().split():
            out |= {t, *re.findall("[一-鿿]|[^一-鿿]+", t)}
        return out

    seen, kept = [tokens(x) for x in tried], []
    for q in queries:
        t = tokens(q)
        if all(len(t & o) < most * len(t | o) for o in seen if t | o):
            kept.append(q)
            seen.append(t)
    return kept


def mine_vocabulary(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...], unit: str, least_df: int, limit: int) -> DataFrame:
    """Frequent n-grams of units (term, df, freq), without those that nearly always occur inside one longer gram.

    Those wanted are the first by df, so grams are counted from a df downwards that falls to a quarter until enough are
    left, at the end to least_df: exact each time. A gram of at least that df goes only by a longer one of eight tenths of
    its frequency, and no gram is more frequent than the shorter ones in it: longer grams are made of frequent ones alone.
    """
    w = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text_col), F.lit(unit), F.lit(0)).alias("w"))
    w = kept_table(w.groupBy("id").agg(F.collect_list("w").alias("texts")), "units")  # the rows of a document
    least = max(least_df, w.count() // 4)
    while True:
        k = _frequent_grams(w, sizes, 8 * least // 10).where(F.col("df") >= least_df)
        longer = k.where(F.col("n") > min(sizes)).select((F.col("n") - 1).alias("n"), F.explode(F.array(F.regexp_replace("term", " [^ ]+$", ""), F.regexp_replace("term", "^[^ ]+ ", ""))).alias("term"), F.col("freq").alias("f"))
        top = longer.groupBy("n", "term").agg(F.max("f").alias("most"))
        kept = k.where(F.col("df") >= least).join(top, ["n", "term"], "left").where(F.col("most").isNull() | (F.col("most") < F.floor(8 * F.col("freq") / 10)))
        kept = kept.select("term", "df", "freq").orderBy(F.desc("df"), F.desc("freq"), "term").limit(limit)
        if least == least_df:
            return kept
        kept = kept_table(kept, "vocabulary")
        if kept.count() >= limit:
            return kept.orderBy(F.desc("df"), F.desc("freq"), "term")
        least = max(least_df, least // 4)


def _frequent_grams(w: DataFrame, sizes: tuple[int, ...], least: int) -> DataFrame:
    """(n, term, df, freq) of the grams of these sizes that occur at least so often. w: a row for each document, with texts as arrays of units."""
    out, shorter = None, None
    for n in range(1 if least > 1 else min(sizes), max(sizes) + 1):
        if least <= 1 and n not in sizes:
            continue
        every = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, F.lit(n)), " "))
        grams = F.flatten(F.transform("texts", lambda x: F.when(F.size(x) >= n, every(x)).otherwise(F.array().cast("array<string>"))))
        count = lambda a, df, freq: F.transform(a, lambda g: F.struct(g.alias("term"), F.lit(df).alias("df"), F.lit(freq).alias("freq")))
        rows = w.select(F.explode(F.concat(count(grams, 0, 1), count(F.array_distinct(grams), 1, 0))).alias("r")).select("r.*")
        if shorter is not None:
            for part in (n - 1, 1 - n):  # without the last unit, without the first
                rows = rows.withColumn("part", F.substring_index("term", " ", part)).join(shorter.select(F.col("term").alias("part")), "part", "left_semi").drop("part")
        k = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("freq").alias("freq")).where(F.col("freq") >= least)
        k = kept_table(k.select(F.lit(n).alias("n"), "term", "df", "freq"), f"grams-{n}")
        shorter = k if least > 1 else None
        if n in sizes:
            out = k if out is None else out.unionByName(k)
    return out


#: Words whose grams a task counts before it sends them on, and about so many bytes of text for each part of all grams.
WORDS, PART_BYTES = 1 << 21, 8 << 20


def whole_vocabulary(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...], unit: str, least_df: int, limit: int) -> DataFrame:
    """The rows of mine_vocabulary, from one count of all grams of these sizes, which follow each other: the first ``limit`` by df, frequency and term.

    Tasks count the grams of the texts they read and deal them by their first words, in compressed batches; a gram and
    those that go on from it are added up in one task, which drops it where a longer one makes up its frequency and sends
    on what may outweigh a gram that ends the same way. Texts of one document are one document; a row without an id is none.
    """
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark, least, most = docs.sparkSession, min(sizes), max(sizes)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    w = docs.select(F.col(id_col).alias("id"), F.array(F.regexp_extract_all(F.lower(text_col), F.lit(unit), F.lit(0))).alias("texts"))
    if not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        w = w.groupBy("id").agg(F.flatten(F.collect_list("texts")).alias("texts"))  # the rows of a document
    w = w.select(F.col("id").isNotNull().alias("known"), "texts")

    def grams(held):
        """(n, part, words, parent, df, freq) of a list of batches, by size, in order of their words: the first words of the shortest grams, the last word of others and their place without it."""
        table = pa.Table.from_batches(held).combine_chunks()
        texts = table.column("texts").combine_chunks()
        inner = texts.flatten()
        words, size = inner.flatten().dictionary_encode(), pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)), size)
        known = table.column("known").to_numpy(zero_copy_only=False).astype("int64")
        places = pc.sort_indices(words.dictionary)
        own, m = words.dictionary.take(places), max(len(places), 1)
        rank = np.empty(m, "int64")
        rank[places.to_numpy()] = np.arange(len(places))
        code, ends = rank[words.indices.to_numpy()], np.repeat(np.cumsum(size), size)
        mixed = np.array([zlib.crc32(x) for x in own.cast(pa.binary()).to_pylist()], "int64")
        ids, at = code, np.arange(len(code))
        for n in range(1, most + 1):
            before = ids
            if n > 1:
                fits = at + n <= ends[at]
                at, before = at[fits], ids[fits]
                ids = before * m + code[at + n - 1]
            order = np.argsort(ids, kind="stable")  # documents stay in order
            g, d = ids[order], doc[at[order]]
            new = np.append(True, g[1:] != g[:-1])[: len(g)]
            starts = np.flatnonzero(new)
            ids = np.empty_like(ids)
            ids[order] = np.cumsum(new) - 1
            if n in sizes and len(at):
                begin = at[order[starts]]
                fresh = new | np.append(False, d[1:] != d[:-1])
                df = np.add.reduceat(fresh * known[d], starts)
                key = np.zeros(len(begin), "int64")
                for i in range(least):
                    key = (key * 1_000_003 + mixed[code[begin + i]]) & 0xFFFFFFFF
                tail = pc.binary_join_element_wise(*[own.take(pa.array(code[begin + i])) for i in range(0 if n == least else n - 1, n)], " ")
                yield n, key % parts, tail, before[order[starts]], df, np.diff(np.append(starts, len(g)))

    def dealt(held):
        sent, place, cuts = [[] for _ in range(parts)], None, None
        for n, part, tail, parent, df, freq in grams(held):
            order = np.argsort(part, kind="stable")
            above = np.zeros(len(order), "int64") if place is None else place[parent[order]] - cuts[part[order]]  # among the shorter ones of the part
            place, cuts = np.empty_like(order), np.searchsorted(part[order], np.arange(parts + 1))
            place[order] = np.arange(len(order))
            tail, df, freq = tail.take(pa.array(order)), df[order], freq[order]
            for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                if a < b:
                    small = (np.full(b - a, n), np.diff(above[a:b], prepend=0), df[a:b], freq[a:b])
                    sent[p].append(pa.RecordBatch.from_arrays([tail.slice(a, b - a), *(pa.array(x.astype("int32")) for x in small)], ["tail", "n", "step", "df", "freq"]))
        full = [p for p in range(parts) if sent[p]]
        if full:
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed(pa.Table.from_batches(sent[p]).combine_chunks()) for p in full], pa.binary())], ["part", "rows"])

    def packed(t):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_table(t)
        return sink.getvalue().to_pybytes()

    def opened(rows):
        t, terms, out = pa.ipc.open_stream(rows.as_buffer()).read_all().combine_chunks(), None, []
        n = t.column("n").to_numpy()
        for k in range(least, most + 1):
            own = t.slice(*(lambda a, b: (a, b - a))(*np.searchsorted(n, [k, k + 1]).tolist()))
            tail = pa.concat_arrays(own.column("tail").chunks) if own.num_rows else pa.array([], pa.string())
            terms = tail if terms is None else pc.binary_join_element_wise(terms.take(pa.array(np.cumsum(own.column("step").to_numpy()))), tail, " ")
            out.append(pa.table([own.column("n"), terms, own.column("df").cast(pa.int64()), own.column("freq").cast(pa.int64())], ["n", "term", "df", "freq"]))
        return pa.concat_tables(out)

    def count(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch.column(1).flatten().flatten())
            if n >= WORDS:
                yield from dealt(held)
                held, n = [], 0
        if held:
            yield from dealt(held)

    def add_up(batches):
        held, at = [], None
        for batch in batches:
            for p, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != at and held:
                    yield from told_apart(held)
                    held = []
                at = p
                held.append(opened(rows))
        if held:
            yield from told_apart(held)

    def told_apart(held):
        t = pa.concat_tables(held).group_by(["n", "term"]).aggregate([("df", "sum"), ("freq", "sum")])
        t = t.filter(pc.greater_equal(t.column("df_sum"), least_df)).combine_chunks()
        if not t.num_rows:
            return
        n, term = t.column("n").to_numpy(), t.column("term").combine_chunks()
        df, freq = t.column("df_sum").to_numpy(), t.column("freq_sum").to_numpy()
        long = np.flatnonzero(n > least)
        own = term.take(pa.array(long))
        shorter, ending = (pc.replace_substring_regex(own, pattern, "") for pattern in (" [^ ]+$", "^[^ ]+ "))
        over = np.full(len(n), -1)
        place = pc.index_in(shorter, value_set=term).to_numpy(zero_copy_only=False)
        there = ~np.isnan(place) if place.dtype.kind == "f" else np.ones(len(place), bool)
        np.maximum.at(over, place[there].astype("int64"), freq[long][there])
        stay = np.flatnonzero(over < 8 * freq // 10)
        last, rest = stay[n[stay] == most], stay[n[stay] < most]
        if len(last) > limit:  # nothing outweighs the longest: of these only the first can be among the first of all
            tops = pa.table([pa.array(-df[last]), pa.array(-freq[last]), term.take(pa.array(last))], ["d", "f", "t"])
            last = last[pc.sort_indices(tops, [(c, "ascending") for c in "dft"]).to_numpy()[:limit]]
        stay = np.r_[last, rest]
        yield pa.RecordBatch.from_arrays([term.take(pa.array(stay)), pa.array(n[stay].astype("int32")), pa.array(df[stay]), pa.array(freq[stay]), pa.nulls(len(stay), pa.int64())], ["term", "n", "df", "freq", "most"])
        if len(long):
            s = pa.table([ending, pa.array(n[long].astype("int32") - 1), pa.array(freq[long])], ["term", "n", "f"]).group_by(["term", "n"]).aggregate([("f", "max")]).combine_chunks()
            none = pa.nulls(s.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([s.column("term").combine_chunks(), s.column("n").combine_chunks(), none, none, s.column("f_max").combine_chunks()], ["term", "n", "df", "freq", "most"])

    rows = w.mapInArrow(count, "part int, rows binary").repartition(parts, "part").sortWithinPartitions("part")
    rows = rows.mapInArrow(add_up, "term string, n int, df long, freq long, most long")
    k = rows.groupBy("n", "term").agg(F.max("df").alias("df"), F.max("freq").alias("freq"), F.max("most").alias("most"))
    kept = k.where(F.col("df").isNotNull() & (F.col("most").isNull() | (F.col("most") < F.floor(8 * F.col("freq") / 10))))
    return kept.select("term", "df", "freq").orderBy(F.desc("df"), F.desc("freq"), "term").limit(limit)


def mine_han(docs: DataFrame, id_col: str, text_col: str, longest: int = 6, least_df: int = 2, limit: int = 2000) -> DataFrame:
    """The characteristic terms of Han texts (term, df, freq): runs' pieces of 2 to ``longest`` characters in at least so many documents.

    A piece goes if one that is a character longer at either end has at least eight tenths of its frequency, whole numbers
    rounded down. Equal runs of a document are taken apart once and counted; a piece's longer ones are found by cutting
    their first and their last character off, so no piece is searched in another. By df, then frequency, then term. Null
    texts have no runs.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(r"\p{IsHan}{2,}"), F.lit(0))).alias("run")).groupBy("id", "run").agg(F.count("*").alias("c"))
    n = F.length("run")

    def pieces(size: int):
        every = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(F.col("run"), i, F.lit(size)))
        return F.when(n >= size, every).otherwise(F.array().cast("array<string>"))

    g = runs.select("id", "c", F.explode(F.concat(*map(pieces, range(2, longest + 1)))).alias("term")).groupBy("id", "term").agg(F.sum("c").alias("c"))
    k = g.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("freq"))
    ends = F.array(F.substring("term", F.lit(1), F.length("term") - 1), F.substring("term", F.lit(2), F.length("term")))
    longer = k.where(F.length("term") > 2).select(F.explode(ends).alias("term"), "freq").groupBy("term").agg(F.max("freq").alias("most"))
    kept = k.where(F.col("df") >= least_df).join(longer, "term", "left").where(F.col("most").isNull() | (F.col("most") < F.floor(8 * F.col("freq") / 10)))
    return kept.select("term", "df", "freq").orderBy(F.desc("df"), F.desc("freq"), "term").limit(limit)


def hash_vectors(rows: DataFrame, id_col: str, text_col: str, width: int = 64) -> DataFrame:
    """(id, bucket, x): counts of distinct unigrams in hash buckets, scaled to length 1."""
    u = rows.select(F.col(id_col), F.explode(tx.unigrams(F.col(text_col))).alias("term")).withColumn("bucket", bucket_of(F.col("term"), width))
    v = u.groupBy(id_col, "bucket").agg(F.count("*").cast("double").alias("x"))
    m = v.groupBy(id_col).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return v.join(m, id_col).select(id_col, "bucket", (F.col("x") / F.col("len")).alias("x"))


def bucket_of(term, width: int = 64):
    return F.pmod(F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("long"), F.lit(width))


def nearest_terms(rows: DataFrame, id_col: str, text_col: str, k: int, least: float) -> DataFrame:
    """Vocabulary terms by cosine to each row's hash vector; a term's own vector has one bucket."""
    v = hash_vectors(rows, id_col, text_col)
    terms = rows.select(F.explode(tx.unigrams(F.col(text_col))).alias("term")).distinct().withColumn("bucket", bucket_of(F.col("term")))
    s = v.join(terms, "bucket").withColumn("cosine", F.round("x", 6)).where(F.col("cosine") > least)
    w = W.partitionBy(id_col).orderBy(F.desc("cosine"), "term")
    return s.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k).select(id_col, "term", "cosine", "rnk")


def top_terms(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    t = docs.select(F.col(id_col), F.explode(F.array_distinct(tx.fields(F.col(text_col)))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(n)


def densest_windows(pairs: DataFrame, tokens: str, text: str, size: int) -> DataFrame:
    """pairs with start and n_hits of the window that holds the most distinct tokens (ties: the earliest); the text's case is kept."""
    step = size // 4
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - size, F.lit(0)), F.lit(step)))
    keys = [c for c in pairs.columns if c not in (tokens, text, "query")]
    rows = pairs.withColumn("_t", F.array_distinct(tokens)).withColumn("start", at)
    k = F.size(F.filter("_t", lambda t: F.contains(F.substring(F.col(text), F.col("start") + 1, F.lit(size)), t)))
    rows = rows.select(*keys, "start", k.alias("n_hits"))
    best = F.max(F.struct(F.col("n_hits").alias("h"), (-F.col("start")).alias("s")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.s")).alias("start"), F.col("b.h").alias("n_hits"))
