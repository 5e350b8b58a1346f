"""Packing by minimum bin slack: documents become token sequences of at most one window, with hardly any padding.

Every document is cut into whole windows and a remainder. The remainders' length histogram (at most a window's number
of entries, whatever the corpus) goes to the driver, where a bitset subset-sum finds, for the longest length left, the
multiset of lengths that fills a window closest to its capacity; counts are backtracked, and a multiset that fills it
exactly is repeated as often as the histogram allows. What can fill no window exactly is laid end to end and cut at
the windows' ends, the last part at powers of two, which need no padding. Ranks within lengths, found in hash buckets,
then say which piece goes where.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encoder, in_batches, staged

WINDOW, BUCKETS = 2048, 256
PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, the longest included, whose sum is closest to capacity from below, with counts.

    A big integer's bit s says that s can be reached. Each length enters with binary-split counts, longest first; the
    backtrack takes a split only where the sum isn't reachable without it.
    """
    lengths = sorted((x for x in counts if counts[x] > 0), reverse=True)
    first = lengths[0]
    room, limit = capacity - first, (1 << (capacity - first + 1)) - 1
    steps, reach = [], 1
    for x in lengths:
        left, k = min(counts[x] - (x == first), room // x), 1
        while left > 0 and not reach >> room & 1:
            k = min(k, left)
            steps.append((x, k, reach))
            reach = (reach | reach << x * k) & limit
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {first: 1}
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            taken[x] = taken.get(x, 0) + k
            at -= x * k
    return taken


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """[(times, multiset)] of windows filled exactly, and the lengths that are left."""
    left, out, aside = {x: n for x, n in counts.items() if n > 0 and x > 0}, [], {}
    while left:
        taken = fill(left, window)
        longest = max(left)
        if sum(x * k for x, k in taken.items()) < window:
            aside[longest] = left.pop(longest)
            continue
        times = min(left[x] // k for x, k in taken.items())
        out.append((times, taken))
        for x, k in taken.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return out, aside


def layout(patterns: list[tuple[int, dict[int, int]]], aside: dict[int, int]) -> tuple[dict, dict, int, int]:
    """Where ranks of a length go: {length: (first ranks, [(first sequence, offset, count)])}, {length: (first rank, start in the stream)}, number of sequences so far, the stream's length."""
    used, slots, base = {}, {}, 0
    for times, taken in patterns:
        at = 0
        for x, k in sorted(taken.items(), reverse=True):
            first, places = slots.setdefault(x, ([], []))
            first.append(used.get(x, 0))
            places.append((base, at, k))
            used[x] = used.get(x, 0) + k * times
            at += x * k
        base += times
    stream, tail = {}, 0
    for x in sorted(aside, reverse=True):
        stream[x] = (used.get(x, 0), tail)
        tail += x * aside[x]
    return slots, stream, base, tail


def cuts(start: int, length: int, tail: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start in the piece, length, sequence, offset) of a piece of the stream, which is cut at windows' ends and its last part at powers of two."""
    whole = tail // window * window
    ends, at = [], whole
    for k in range(window.bit_length() - 1, -1, -1):
        if tail - whole >> k & 1:
            ends.append(at := at + (1 << k))
    out, p = [], start
    while p < start + length:
        if p < whole:
            number, begin, end = p // window, p // window * window, (p // window + 1) * window
        else:
            k = bisect_right(ends, p)
            number, begin, end = whole // window + k, ends[k - 1] if k else whole, ends[k]
        q = min(end, start + length)
        out.append((p - start, q - p, number, p - begin))
        p = q
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, spaced: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Whole windows and the remainder of each document, with the checksum of their ids, dealt to buckets in turn."""
    import pyarrow as pa
    from pyspark import TaskContext

    def cut(batches):
        e = encoder(tokenizer, spaced)
        end = np.array([end_id], dtype=e.dtype).tobytes()
        turn = TaskContext.get().partitionId() * 37
        for batch in batches:
            out = {k: [] for k in ("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket")}
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                ids = np.frombuffer(e.encode(text or b"") + end, dtype=e.dtype).astype("<u4")
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    for k, v in zip(out, (row, doc_id, s, len(part), zlib.crc32(part), len(ids), turn % buckets)):
                        out[k].append(v)
                    turn += 1
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int32() if k == "bucket" else pa.int64()) for k in out]))

    return in_batches(docs.select("row", "doc_id", "text"), cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, spaced: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """One row for each piece of the documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    window is a power of two. A null text is empty: one piece with the end id. Rows are packed one by one, so repeated
    rows and null or equal ids are each packed; no documents give no rows. Other columns are ignored. Equal input rows
    may change places between runs, no piece's content does.
    """
    import pyarrow as pa

    rows = docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = staged(pieces(rows, tokenizer, end_id, window, spaced, buckets), "pieces")
    sums = cut.groupBy("length", "bucket").count()
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = staged(sums.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))), "ranks")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most a window's number of rows
    slots, stream, base, tail = layout(*plan(counts, window))

    order = W.partitionBy("length", "bucket").orderBy("doc_id", "row", "start")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1).join(sums.drop("count"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row")

    def place(batches):
        for batch in batches:
            cols, out = [batch.column(k).to_pylist() for k in range(7)], {k: [] for k in names}
            for row, doc_id, start, length, crc, doc_tokens, rank in zip(*cols):
                if length in stream and rank >= stream[length][0]:
                    first, at = stream[length]
                    parts = [(s, n, base + q, o) for s, n, q, o in cuts(at + (rank - first) * length, length, tail, window)]
                else:
                    first, places = slots[length]
                    k = bisect_right(first, rank) - 1
                    q, at, count = places[k]
                    q, slot = divmod(rank - first[k], count)
                    parts = [(0, length, places[k][0] + q, at + slot * length)]
                for s, n, q, o in parts:
                    for k, v in zip(names, (doc_id, start + s, n, crc if n == length else None, doc_tokens, q, o, row)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in names]))

    placed = ranked.select("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, ", ".join(f"{k} long" for k in names))
    if not tail:
        return placed.drop("row")

    placed = staged(placed, "placed")
    torn = placed.where("ids_crc32 is null").select("row", "doc_id", "start", "length").distinct()

    def sums_of(batches):
        e = encoder(tokenizer, spaced)
        end = np.array([end_id], dtype=e.dtype).tobytes()
        for batch in batches:
            out = {k: [] for k in ("row", "doc_id", "start", "length", "crc")}
            for row, doc_id, text, parts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids = np.frombuffer(e.encode((text or "").encode()) + end, dtype=e.dtype).astype("<u4")
                for x in parts:
                    for k, v in zip(out, (row, doc_id, x["start"], x["length"], zlib.crc32(ids[x["start"] : x["start"] + x["length"]]))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    # A hash that two texts share would only repeat a lookup: doc_id is part of the key, and equal rows have equal sums.
    # Written first, so that its size is known: a few rows are sent to the texts, many are joined by a shuffle.
    wanted = staged(torn.groupBy("row", "doc_id").agg(F.collect_list(F.struct("start", "length")).alias("parts")), "torn")
    once = rows.join(wanted.withColumnRenamed("row", "r").withColumnRenamed("doc_id", "d"), (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))
    found = in_batches(once.dropDuplicates(["row", "doc_id"]).select("row", "doc_id", "text", "parts"), sums_of, "row long, doc_id long, start long, length long, crc long")
    found = found.select(F.col("row").alias("r"), F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("length").alias("n"), "crc")
    same = (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("start") == F.col("s")) & (F.col("length") == F.col("n"))
    done = placed.where("ids_crc32 is null").join(found, same).select(*names[:3], F.col("crc").alias("ids_crc32"), *names[4:7])
    return placed.where("ids_crc32 is not null").select(*names[:7]).unionByName(done)
