"""Knowledge clusters, their merging, and the graph between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import kept_table

REUSE, MERGE, GATE = 0.85, 0.55, 0.15


def level_keys(query: Column, name: Column, anchor: Column, content: Column) -> Column:
    """Distinct (level, key) pairs: scenario, operation, anchor and principle, 80 characters each."""
    cut = lambda c: F.substring(F.trim(c), 1, 80)
    op = F.regexp_replace(query, tx.ASKING, "")
    rows = F.array(*[F.struct(F.lit(k).alias("level"), cut(v).alias("key")) for k, v in (("scenario", query), ("scenario", name), ("operation", op), ("anchor", anchor), ("principle", F.regexp_extract(content, r"[^\n]*\S[^\n]*", 0)))])
    return F.array_distinct(F.filter(rows, lambda r: r["key"] != ""))


def evolve(uses: DataFrame, topic: str, order: list[str], query: str) -> DataFrame:
    """Each topic after its uses in order: version, hotness from 0.5 by 0.1 up to 1, its last five queries."""
    w = W.partitionBy(topic).orderBy(*[F.desc(c) for c in order])
    r = uses.withColumn("_n", F.row_number().over(w))
    last = F.array_sort(F.collect_list(F.when(F.col("_n") <= 5, F.struct((-F.col("_n")).alias("n"), F.col(query).alias("q")))))
    g = r.groupBy(topic).agg(F.count("*").alias("version"), last.alias("_q"))
    return g.select(topic, "version", F.round(F.least(F.lit(1.0), 0.5 + 0.1 * (F.col("version") - 1)), 6).alias("hotness"), F.transform("_q", lambda x: x["q"]).alias("queries"))


def reuse_score(vector_cos: Column, key_cover: Column, key_cos: Column) -> Column:
    return F.greatest(F.lit(0.0), vector_cos, key_cover, key_cos)


def evidence_state(evidence: DataFrame, docs: DataFrame, cluster: str) -> DataFrame:
    """(cluster, windows, stale): a cluster is stale if any of its windows is missing, out of range or reads otherwise now."""
    r = evidence.join(docs.select("doc_id", "body"), "doc_id", "left")
    bad = F.col("body").isNull() | (F.col("end") > F.length("body")) | (F.substring(F.col("body"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("content"))
    return r.groupBy(cluster).agg(F.count("*").alias("windows"), F.bool_or(bad).alias("stale"))


def fold(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters (id, conf, hotness, queries) with pairs (winner, loser) folded: mean confidence, largest hotness, queries united (the last five)."""
    l = clusters.select(F.col("id").alias("loser"), F.col("conf").alias("c2"), F.col("hotness").alias("h2"), F.col("queries").alias("q2"))
    w = clusters.join(pairs, clusters["id"] == pairs["winner"]).join(l, "loser")
    q = F.array_union("queries", "q2")
    merged = w.select("id", F.round((F.col("conf") + F.col("c2")) / 2, 6).alias("conf"), F.greatest("hotness", "h2").alias("hotness"), F.slice(q, F.greatest(F.lit(1), F.size(q) - 4), F.lit(5)).alias("queries"))
    rest = clusters.join(pairs.select(F.col("winner").alias("id")), "id", "left_anti").join(pairs.select(F.col("loser").alias("id")), "id", "left_anti")
    return rest.unionByName(merged)


def greedy_merges(pairs: list[tuple[float, int, int]], most: int | None = None) -> list[tuple[int, int]]:
    """(winner, loser) in order of similarity, then ids; the older id wins and a folded one is gone. For the clusters' short list of close pairs."""
    gone, out = set(), []
    for _, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in gone and b not in gone and (most is None or len(out) < most):
            out.append((min(a, b), max(a, b)))
            gone.add(max(a, b))
    return out


def merged_greedily(pairs: DataFrame) -> DataFrame:
    """(winner, loser) of greedy_merges over any number of pairs (a, b, cosine), in its order; the pairs stay in DataFrames.

    A cluster goes only as a loser. So a pair merges if no earlier undecided pair has its winner or its loser as the loser;
    then the loser's later pairs drop out, and its earlier ones, in which it wins, stay. The first pair left
    always merges, so the rounds end.
    """
    rank = F.struct((-F.col("cosine")).alias("c"), F.col("winner").alias("a"), F.col("loser").alias("b"))  # made where it is asked for, so a pair stays three numbers
    left = kept_table(pairs.select(F.least("a", "b").alias("winner"), F.greatest("a", "b").alias("loser"), "cosine"), "merge-pairs")
    done = left.select("winner", "loser", rank.alias("rank")).limit(0)
    while not left.isEmpty():
        first = kept_table(left.groupBy("loser").agg(F.min(rank).alias("first")), "merge-first")  # names the pair as well: the pairs meet nothing to find those that merge
        at = first.select(F.col("first.a").alias("winner"), "loser", F.col("first").alias("rank")).join(first.select(F.col("loser").alias("winner"), F.col("first").alias("before")), "winner", "left")
        now = kept_table(at.where(F.col("before").isNull() | (F.col("rank") < F.col("before"))).select("winner", "loser", "rank"), "merge-now")
        gone = now.select(F.col("loser").alias("gone"), F.col("rank").alias("at"))
        rest = left.join(gone.select(F.col("gone").alias("loser")), "loser", "left_anti").join(gone.withColumnRenamed("gone", "winner"), "winner", "left")
        left = kept_table(rest.where(F.col("at").isNull() | (rank < F.col("at"))).select("winner", "loser", "cosine"), "merge-pairs")
        done = done.unionByName(now)
    return done.orderBy("rank").select("winner", "loser")


def conflicts(claims: DataFrame, group: str) -> DataFrame:
    """(group, a, b): members (id, claim) of a group whose numbers differ, a < b; equal claims are one class each, named by its least id."""
    return _conflicts(claims, group)[0]


def barriers(claims: DataFrame, group: str) -> DataFrame:
    """(a, b, weight): what conflicts() lists, both ways and once each."""
    pairs, parts = _conflicts(claims, group)
    return both_ways(pairs.select("a", "b").repartition(parts, "a", "b").distinct().withColumn("weight", F.lit(1.0)))  # a < b, so no pair is another one turned round


def _conflicts(claims: DataFrame, group: str) -> tuple[DataFrame, int]:
    """The pairs of conflicts() and in how many partitions they are made: a group's first ends are dealt to several tasks, so none makes all pairs of a group."""
    c = kept_table(claims.where("claim <> ''").groupBy(group, "claim").agg(F.min("id").alias("id")), "claims")
    n = c.groupBy(group).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs")).first()["pairs"]
    parts = parts_for(c.sparkSession, n)
    salts = min(n // ROWS + 1, MOST_SALTS)
    x = c.select(group, F.col("id").alias("a"), F.col("claim").alias("p"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).repartition(parts, group, "salt")
    y = c.select(group, F.col("id").alias("b"), F.col("claim").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")).repartition(parts, group, "salt")
    return x.hint("merge").join(y, [group, "salt"]).where("a < b and p <> q").select(group, "a", "b"), parts


def claim_classes(claims: DataFrame, group: str) -> DataFrame:
    """(group, id, others): one member of each class of equal claims of a group, named by its least id, and with how many other classes it conflicts.

    What conflicts() would list as pairs, counted without making them.
    """
    c = claims.where("claim <> ''").groupBy(group, "claim").agg(F.min("id").alias("id"))
    n = c.groupBy(group).agg(F.count("*").alias("classes"))
    return c.join(n, group).select(group, "id", (F.col("classes") - 1).alias("others"))


#: Rows that one task of a join or a count gets, and tasks that a group's pairs are dealt to at most.
ROWS, MOST_SALTS = 1 << 20, 256
#: The most blocks that members are dealt to where their pairs outnumber them so many times, the least, a block's members before there are more, and pairs that are counted at a time.
BLOCKS, LEAST_BLOCKS, BLOCK_MEMBERS, COUNTED = 32, 12, 3_000_000, 1 << 22


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: a shuffle's usual number, or more where a task's share would grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS + 1)


def pair_edges(rows: DataFrame, group: str, member: str, first: float = 0.7, step: float = 0.1) -> DataFrame:
    """(a, b, hits, weight) of members that share groups: 0.7 for the first, 0.1 more for each further one, at most 1.

    Pairs of small groups are joined and counted in as many tasks as they are many. Where groups are large, so that pairs
    outnumber their members by more than BLOCKS, members (whole numbers) are dealt to blocks, as few as their number allows, and each
    two blocks' pairs are counted where they meet: members cross the network once for each block, pairs never.
    """
    spark = rows.sparkSession
    r = rows.select(F.col(group).alias("grp"), F.col(member).alias("member")).where("grp is not null and member is not null")
    r = kept_table(r.repartition(parts_for(spark, rows.count()), "grp").distinct(), "members")
    n = r.groupBy("grp").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs")).first()
    whole = r.schema["member"].dataType.simpleString() in ("bigint", "int")
    if whole and n["pairs"] > BLOCKS * n["members"]:
        e = _pairs_by_blocks(r)
    else:
        parts = parts_for(spark, n["pairs"])
        x = r.repartition(parts, "grp")
        e = x.select("grp", F.col("member").alias("a")).hint("merge").join(x.select("grp", F.col("member").alias("b")), "grp").where("a < b").select("a", "b")
        e = e.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("hits"))
    return e.withColumn("weight", F.round(F.least(F.lit(1.0), first + step * (F.col("hits") - 1)), 6))


def _pairs_by_blocks(members: DataFrame) -> DataFrame:
    """(a, b, hits) of the distinct rows (grp, member): blocks of members meet in tasks, which count their pairs COUNTED at a time. Groups that are no whole numbers go by a hash of 64 bits."""
    import numpy as np
    import pyarrow as pa

    kind = members.schema["member"].dataType
    blocks = min(BLOCKS, max(LEAST_BLOCKS, members.count() // BLOCK_MEMBERS + 1))
    at = F.pmod(F.xxhash64("member"), F.lit(blocks)).cast("int")
    cells = members.groupBy("grp", at.alias("at")).agg(F.collect_list(F.col("member").cast("long")).alias("own"))
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.least("at", k) * blocks + F.greatest("at", k))
    whole = members.schema["grp"].dataType.simpleString() in ("bigint", "int")
    dealt = cells.select(F.col("grp").cast("long").alias("grp") if whole else F.xxhash64("grp").alias("grp"), "at", "own", F.explode(meets).alias("meet"))

    def run(batches):
        held, at = [], None
        for batch in batches:
            meets = batch.column("meet").to_numpy()
            cuts = [0, *(np.flatnonzero(meets[1:] != meets[:-1]) + 1), len(meets)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin < end:
                    if meets[begin] != at and held:
                        yield from count(held, at)
                        held = []
                    at = int(meets[begin])
                    held.append(batch.slice(begin, end - begin))
        if held:
            yield from count(held, at)

    def count(held, meet):
        table = pa.Table.from_batches(held).combine_chunks()
        own = table.column("own").combine_chunks()
        size = own.value_lengths().to_numpy(zero_copy_only=False)
        member, grp = own.flatten().to_numpy(), np.repeat(table.column("grp").to_numpy(), size)
        left = np.repeat(table.column("at").to_numpy() == meet // blocks, size)
        same = meet // blocks == meet % blocks
        right = np.ones(len(left), bool) if same else ~left
        a, b = np.unique(member[left]), np.unique(member[right])
        order = np.lexsort((member[right], grp[right]))
        groups, others = grp[right][order], np.searchsorted(b, member[right][order])
        mine = np.argsort(member[left], kind="stable")
        asked, x = grp[left][mine], np.searchsorted(a, member[left][mine])
        begin, end = np.searchsorted(groups, asked), np.searchsorted(groups, asked, "right")
        ends = np.cumsum(end - begin)
        k = 0
        while k < len(x):  # as many whole members of the left as have about COUNTED pairs
            last = np.searchsorted(ends, (ends[k - 1] if k else 0) + COUNTED)
            last = np.searchsorted(x, x[min(last, len(x) - 1)], "right")
            size = (end - begin)[k:last]
            place = np.repeat(begin[k:last] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            code = np.sort(np.repeat(x[k:last], size) * len(b) + others[place])
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else code
            hits, code = np.diff(np.r_[starts, len(code)]), code[starts]
            p, q = a[code // len(b)], b[code % len(b)]
            if same:
                keep = p < q
                p, q, hits = p[keep], q[keep], hits[keep]
            if len(p):
                yield pa.RecordBatch.from_pydict({"a": np.minimum(p, q), "b": np.maximum(p, q), "hits": hits.astype("int64")})
            k = last

    found = dealt.repartition(blocks * (blocks + 1) // 2, "meet").sortWithinPartitions("meet").mapInArrow(run, "a long, b long, hits long")
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "hits")


def sequence_edges(rows: DataFrame, owner: str, order: list[str], node: str, among: DataFrame | None = None) -> DataFrame:
    """(a, b, hits, weight, kind) from each node to the owner's next one; a pathway from two hits on. among (node): edges with an end elsewhere are left out before they are counted."""
    rows = rows.repartition(parts_for(rows.sparkSession, rows.count()), owner)
    r = rows.withColumn("b", F.lead(node).over(W.partitionBy(owner).orderBy(*order))).where(F.col("b").isNotNull() & (F.col("b") != F.col(node)))
    r = r.select(F.col(node).alias("a"), "b")
    if among is not None:
        for end in ("a", "b"):
            r = r.join(among.select(F.col("node").alias(end)), end, "left_semi")
    e = r.groupBy("a", "b").agg(F.count("*").alias("hits"))
    return e.select("a", "b", "hits", F.lit(0.6).alias("weight"), F.when(F.col("hits") >= 2, "pathway").otherwise("plain").alias("kind"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


#: What a walked pathway counts more than a one-off link of the same weight.
PATHWAY = 1.5


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """edges (a, b, weight and more) as steps from a to b: as they are (out), turned round (in), or both (any)."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    out = edges.select("a", "b", *rest)
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest)
    return {"out": out, "in": back, "any": out.unionByName(back)}[direction]


def barred(starts: DataFrame, edges: DataFrame, direction: str = "any") -> DataFrame:
    """(start, node): what a barrier edge keeps out of a start's neighbourhood, at every depth; those that lead in count unless only ways out do."""
    b = edges.where(F.col("kind") == "barrier").select("a", "b")
    ends = directed(b, "out" if direction == "out" else "any")
    return starts.select("start").join(ends, F.col("start") == F.col("a")).where("a <> b").select("start", F.col("b").alias("node")).distinct()


def fit_nodes(nodes: DataFrame, hotness: float = 0.0, confidence: float = 0.0) -> DataFrame:
    """Clusters (node, hotness, confidence, lifecycle) that an expansion may reach: not deprecated, as hot and as sure as wanted."""
    return nodes.where((F.col("lifecycle") != "deprecated") & (F.col("hotness") >= hotness) & (F.col("confidence") >= confidence))


def expand(starts: DataFrame, edges: DataFrame, depth: int = 2, least: float = 0.5, most: int = 32, direction: str = "out", nodes: DataFrame | None = None, hop_nearest: int | None = None, barriers: DataFrame | None = None) -> DataFrame:
    """(start, node, depth, score, place): nodes within so many hops of each start, each at its first depth, by its best path.

    edges have a, b, weight and kind (plain, pathway or barrier): a path's score is the sum of its edges' weights, pathways
    counting PATHWAY times; edges below ``least`` and barriers are not walked, and what a start has a barrier to is left
    out at every depth (``barriers`` (start, node) bars more). nodes: only these are reached; with their embedding and
    hop_nearest, each step from a node goes on to the neighbours nearest to the start's probe by cosine alone (ties: the
    smaller node), so starts need a probe then. The cut to ``most`` is by depth, then score, then node. Null ends of edges
    lead nowhere; no starts or no edges give no rows. Rounds beyond the second read the nodes seen so far from the shared
    folder, so that no plan grows with the depth.
    """
    e = directed(edges.where((F.col("weight") >= least) & (F.col("kind") != "barrier")), direction)
    e = e.select("a", "b", (F.col("weight") * F.when(F.col("kind") == "pathway", PATHWAY).otherwise(1.0)).alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))  # the best of parallel edges
    if nodes is not None:
        e = e.join(nodes.select(F.col("node").alias("b"), *([F.col("embedding")] if hop_nearest else [])), "b")
    out = barred(starts, edges, direction)
    if barriers is not None:
        out = out.unionByName(barriers.select("start", "node"))
    probes = starts.select("start", "probe") if hop_nearest else None
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(0.0).alias("score")).distinct()
    front = seen
    for k in range(1, depth + 1):
        step = front.select("start", F.col("node").alias("a"), "score").join(e, "a")
        step = step.join(seen.select("start", F.col("node").alias("b")), ["start", "b"], "left_anti").join(out.select("start", F.col("node").alias("b")), ["start", "b"], "left_anti")
        if hop_nearest:
            near = F.round(tx.cosine(F.col("embedding"), F.col("probe")), 9)
            step = step.join(probes, "start").withColumn("near", near).withColumn("at", F.row_number().over(W.partitionBy("start", "a").orderBy(F.desc("near"), "b"))).where(F.col("at") <= hop_nearest)
        front = step.groupBy("start", F.col("b").alias("node")).agg(F.lit(k).alias("depth"), F.max(F.col("score") + F.col("w")).alias("score"))
        if 2 <= k < depth:
            front = kept_table(front, "front")
        seen = seen.unionByName(front)
    w = W.partitionBy("start").orderBy("depth", F.desc("score"), "node")
    return seen.where("depth > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).withColumn("score", F.round("score", 6))

