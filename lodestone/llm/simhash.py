"""SimHash near copies through an inverted index on positional bytes with count filtering.

Of two 64-bit fingerprints that differ in at most k bits, at least 8 - k of their eight bytes are equal at the same
place: the guaranteed minimum of matches. A list of all fingerprints with one byte at one place holds 1/256 of them, so
the lists are intersected: the index's terms are all sets of 8 - k places with their bytes, and exactly the pairs
that reach the minimum meet in a list. Within a list, each pair's equal bytes are tallied, pairs below the minimum
(of colliding terms) dropped, and the bits compared. Equal fingerprints are one entry. A list gives the links of a
spanning forest, never all its pairs, and stops once its members are all connected.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, in_batches, one_row, restored, staged, take_memory
from .components import components

WIDTH, SEED, BITS = 4, 42, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Bits set in over half the XXH64 hashes of the lower-cased text's word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    return bits_over_half(np.fromiter((xxh64_intdigest(x, seed) for x in shingles), np.uint64))


def bits_over_half(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """The kept columns with rid (tells rows apart) and fp, written to the shared folder. A null text has no words."""
    import pyarrow as pa

    def run(batches):
        take_memory("simhash")
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(x or b"", width, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], [*batch.schema.names[:-1], "fp"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("_text"))
    return staged(in_batches(rows, run, ", ".join([*fields, "rid long", "fp long"])), "fingerprints")


def links_of(members: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for members of one list that are connected: a spanning forest of the pairs within so many bits."""
    m = len(members)
    label, parts = np.arange(m), m
    for i in range(m - 1):
        x = members[i] ^ members[i + 1 :]
        equal = 8 - np.bitwise_count(((x & _LOW) + _LOW | x) & _HIGH)
        near = np.flatnonzero((equal >= 8 - bits) & (np.bitwise_count(x) <= bits)) + i + 1
        if len(near):
            group = np.unique(label[np.append(near, i)])
            if len(group) > 1:
                label[np.isin(label, group)] = group[0]
                parts -= len(group) - 1
                if parts == 1:
                    break
    moved = np.flatnonzero(label != np.arange(m))
    return members[moved], members[label[moved]]


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v) of distinct fingerprints (column fp): enough links to connect all that are within so many bits, directly or by steps.

    Zero, the fingerprint of texts without words, links like any other. Fewer than two fingerprints give no rows.
    """
    import pyarrow as pa

    places = list(combinations(range(8), 8 - bits))
    masks = np.array([sum(0xFF << 8 * p for p in x) for x in places], np.uint64)
    salts = np.arange(1, len(places) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def terms(batches):
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(every), 2000):
                fp = every[k : k + 2000]
                h = (fp[:, None] & masks ^ salts) * _MIX
                h = (h ^ h >> np.uint64(31)) * _MIX
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(fp, len(masks)).view(np.int64))], ["term", "fp"])

    def lists(batches):
        held_t, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            t = np.concatenate([held_t, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            last = starts[-1]
            yield from found(t[:last], f[:last], starts[:-1])
            held_t, held_f = t[last:], f[last:]
        if len(held_t):
            yield from found(held_t, held_f, np.zeros(1, np.int64))

    def found(t, f, starts):
        sizes = np.diff(np.append(starts, len(t)))
        us, vs = [], []
        pairs = starts[sizes == 2]
        if len(pairs):
            x = f[pairs] ^ f[pairs + 1]
            near = pairs[(8 - np.bitwise_count(((x & _LOW) + _LOW | x) & _HIGH) >= 8 - bits) & (np.bitwise_count(x) <= bits)]
            us, vs = [f[near + 1]], [f[near]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            u, v = links_of(f[s : s + n], bits)
            us.append(u), vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])

    index = prints.select("fp").mapInArrow(terms, "term long, fp long")
    return index.repartition("term").sortWithinPartitions("term", "fp").mapInArrow(lists, "u long, v long")


def grouped(prints: DataFrame, bits: int = BITS, holder: Column | None = None) -> DataFrame:
    """(fp, component, holder) for each distinct fp of prints; holder is the least value of that column in the component, null if all are. No prints, no rows."""
    own = prints.groupBy("fp").agg(F.min(holder).alias("holder"))
    found = components(links(own.select("fp"), bits))
    named = own.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("component"), "holder")
    whole = named.groupBy("component").agg(F.min("holder").alias("holder"))
    return named.drop("holder").join(whole, "component")


def near_copies(docs: DataFrame, bits: int = BITS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row: the least doc_id that links lead to.

    Null and blank texts have fingerprint zero and link like any other. Rows are kept one by one, equal ids and texts
    included; null ids never name a component unless it has no other (then null). No rows give none.
    """
    rows = fingerprinted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ("doc_id",), width, seed)
    groups = grouped(rows, bits, F.col("doc_id"))
    out = rows.join(groups, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("holder").alias("component_id"))


def near_dedup(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs with one row left of each group of near copies by five-word shingles: see shingles.one_of_each.

    Fingerprints of five-word shingles go through links() first, and every candidate is then compared by its whole set.
    Fingerprints of texts at Jaccard 0.8 differ in 10 of 64 bits on average, where no byte need be equal, so pairs that
    the index can't promise come from MinHash terms of the same shingles.
    """
    from . import shingles

    return shingles.one_of_each(docs, least)


def one_of_each(docs: DataFrame, bits: int = BITS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """docs with one row left of each component: that with the least doc_id (null last; of equal ids, one).

    Only ids, a hash of the whole row and fingerprints are written and compared; the kept rows are then picked from docs
    by id and hash, and rows that are equal in every column count once. Columns of any name and type come through as they
    are. Null and blank texts have fingerprint zero, so one of them stays. An empty table gives an empty one.
    """
    marked = carried(docs)
    rows = fingerprinted(marked.select("doc_id", "_row", "text"), ("doc_id", "_row"), width, seed)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("row"))
    own = rows.groupBy("fp").agg(F.min(first).alias("holder"))
    found = components(links(own.select("fp"), bits))
    named = own.join(found, F.col("fp") == F.col("node"), "left").select(F.coalesce("label", "fp").alias("component"), "holder")
    kept = named.groupBy("component").agg(F.min("holder").alias("holder")).select(F.col("holder.row").alias("_r"), F.col("holder.doc_id").alias("_d"))
    picked = marked.join(kept, (F.col("_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    return restored(one_row(picked), docs.columns)
