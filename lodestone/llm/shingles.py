"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash find candidates, the whole sets decide.

A text is the set of its lower-cased shingles of five words. Equal sets are one entry. Sets whose SimHash fingerprints
differ in at most four bits meet through the byte-position index of simhash.py. Each set also gives BANDS terms of ROWS
minima each; two sets meet in a list if they share a term, which a pair of Jaccard s does with probability
1 - (1 - s^ROWS)^BANDS: all but 1.3e-7 of pairs at 0.8, and fewer are missed above. A set's sketch holds one bit of each of its
minima; two sets of Jaccard s agree in a bit with probability (1 + s) / 2, so all but 6.5e-8 of pairs at 0.8 differ in at
most far() = 45 of 200 bits, while 1.2 % of pairs at 0.4 do. Candidates within that are then compared by their whole sets, so
nothing below the bound is linked. In a list every member is compared with the list's least one first; only members that
this leaves in different components are compared with each other. Lists may hold many sets that share one long passage,
with a Jaccard of 0.6 to 0.7, which 200 bits don't tell from 0.8. So a pair leaves the list only if its parities allow it
as well: a set's parities tell of each of PARITIES bins whether it holds an odd number of the set, so two sets differ in as
many shingles at least as in parities, and no pair at the bound is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, in_batches, one_row, restored, staged, take_memory
from .components import components
from .simhash import bits_over_half, links

WIDTH, LEAST, SEED = 5, 0.8, 42
BANDS, ROWS = 40, 5
MISSED = 1e-7
PARITIES = 2048
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64)
_SALT, _TIMES, _JOIN = _DRAWN[0], _DRAWN[1] | np.uint64(1), _DRAWN[2].reshape(BANDS, ROWS) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The XXH64 hashes of a text's shingles in order; a shorter text is one shingle, a wordless one has none."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.fromiter((xxh64_intdigest(x, SEED) for x in parts), np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of a text's hashes."""
    return np.unique(hashes(text, width))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of a set under each of BANDS * ROWS hash functions; all ones for an empty set."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(found), 256):
        drawn = found[None, k : k + 256] ^ _SALT[:, None]
        drawn *= _TIMES[:, None]
        least = np.minimum(least, drawn.min(1))
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """One mixed bit of each minimum, packed into words of 64 bits."""
    bits = (least ^ least >> np.uint64(29)) * _MIX >> np.uint64(63)
    return np.packbits(np.pad(bits.astype(np.uint8), (0, -len(bits) % 64))).view(np.int64)


def far(least: float) -> int:
    """The fewest differing bits of two sketches that a pair of this Jaccard exceeds with a probability of at most MISSED."""
    from math import comb

    n, p = BANDS * ROWS, (1 - least) / 2
    tail, d = 0.0, n
    while d > 0 and (tail := tail + comb(n, d) * p**d * (1 - p) ** (n - d)) <= MISSED:
        d -= 1
    return d


def parities(found: np.ndarray) -> np.ndarray:
    """Whether each of PARITIES bins holds an odd number of a set's hashes, packed into words of 64 bits."""
    bins = ((found ^ found >> np.uint64(31)) * _MIX >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


def terms(least: np.ndarray) -> np.ndarray:
    """The terms of a set by its minima, one a band."""
    h = ((least.reshape(BANDS, ROWS) ^ least.reshape(BANDS, ROWS) >> np.uint64(29)) * _JOIN).sum(1, dtype=np.uint64)
    return (h ^ h >> np.uint64(31)) * _MIX


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n / (len(a) + len(b) - n) if len(a) + len(b) else 1.0


def _entries(marked: DataFrame) -> DataFrame:
    """(doc_id, _row, fp, n, print, sketch, terms) of each row: fp names the set, n is its size, print its SimHash fingerprint; an empty set has no terms."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    def run(batches):
        take_memory("shingles")
        for batch in batches:
            names, sizes, prints, sketches, own = [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                every = hashes(text)
                found = np.unique(every)
                prints.append(bits_over_half(every))
                least = minima(found)
                names.append(xxh64_intdigest(found.tobytes(), SEED)), sizes.append(len(found)), sketches.append(sketch(least).tolist())
                own.append(terms(least) if len(found) else np.empty(0, np.uint64))
            edges = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int32)
            flat = np.concatenate(own) if own else np.empty(0, np.uint64)
            columns = [pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sketches, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.view(np.int64)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "_row", "fp", "n", "print", "sketch", "terms"])

    id_type = marked.schema["doc_id"].dataType.simpleString()
    rows = marked.select("doc_id", "_row", F.col("text").cast("string").alias("text"))
    return staged(in_batches(rows, run, f"doc_id {id_type}, _row long, fp long, n long, print long, sketch array<long>, terms array<long>"), "shingles")


def _lists(own: DataFrame) -> DataFrame:
    """(term, fp, n, root, root_n) of the lists with two members or more; the root is a list's least fp."""
    import pyarrow as pa

    def run(batches):
        held = np.empty((3, 0), np.int64)
        for batch in batches:
            x = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(3)])], axis=1)
            if not x.shape[1]:
                continue
            last = np.searchsorted(x[0], x[0, -1])
            yield from found(x[:, :last])
            held = x[:, last:]
        yield from found(held)

    def found(x):
        if x.shape[1] < 2:
            return
        starts = np.flatnonzero(np.append(True, x[0, 1:] != x[0, :-1]))
        sizes = np.diff(np.append(starts, x.shape[1]))
        roots, many = np.repeat(starts, sizes), np.repeat(sizes > 1, sizes)
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (*x, x[1, roots], x[2, roots])], ["term", "fp", "n", "root", "root_n"])

    index = own.select(F.explode("terms").alias("term"), "fp", "n")
    index = index.repartition("term").sortWithinPartitions("term", "fp")
    return staged(index.mapInArrow(run, "term long, fp long, n long, root long, root_n long"), "lists")


def _alike(own: DataFrame) -> DataFrame:
    """(u, v) of sets that share a fingerprint with the least set of theirs, and of least sets whose fingerprints the byte-position index links."""
    least = own.groupBy("print").agg(F.min("fp").alias("least"))
    same = own.join(least, "print").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    x, y = (least.select(F.col("print").alias(c), F.col("least").alias(f"least_{c}")) for c in "uv")
    linked = links(least.select(F.col("print").alias("fp"))).join(x, "u").join(y, "v").select(F.greatest("least_u", "least_v").alias("u"), F.least("least_u", "least_v").alias("v"))
    return same.unionByName(linked).distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """(fp, found, parities): the sorted set of each text's hashes, as bytes, worked out once for all pairs that it is in, and its parities."""
    import pyarrow as pa

    def run(batches):
        take_memory("shingles")
        for batch in batches:
            found = [shingles(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([parities(x) for x in found], pa.list_(pa.int64()))], ["fp", "found", "parities"])

    return staged(in_batches(texts.select("fp", "text"), run, "fp long, found binary, parities array<long>"), "sets")


def _near(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v) of those pairs (u, v) whose sets' Jaccard is at least so much."""
    import pyarrow as pa

    def run(batches):
        take_memory("shingles")
        for batch in batches:
            u, v = (batch.column(k).to_numpy() for k in range(2))
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            keep = np.fromiter((jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(a, b)), bool, len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    x, y = (sets.select(F.col("fp").alias(c), F.col("found").alias(f"found_{c}")) for c in "uv")
    both = pairs.join(x, "u").join(y, "v").select("u", "v", "found_u", "found_v")
    return staged(in_batches(both, run, "u long, v long"), "near")


def _sized(small: str, large: str, least: float):
    """Whether sizes alone leave a pair's Jaccard at least so much."""
    return F.least(small, large) >= F.lit(least) * F.greatest(small, large)


def _differing(u: str, v: str, bits: int):
    """In how many of so many bits two columns of 64-bit words differ."""
    return sum(F.bit_count(F.col(u)[k].bitwiseXOR(F.col(v)[k])) for k in range(-(-bits // 64)))


def _within(u: str, v: str, bits: int):
    """Whether two sketches differ in at most so many bits."""
    return _differing(u, v, BANDS * ROWS) <= bits


def _even(c: str, d: str, least: float):
    """Whether the parities of the sets c and d leave a Jaccard of at least so much: such sets of m and n shingles differ in at most (1 - least) / (1 + least) * (m + n)."""
    most = (F.col(f"n_{c}") + F.col(f"n_{d}")) * F.lit((1 - least) / (1 + least))
    return _differing(f"parities_{c}", f"parities_{d}", PARITIES) <= most + 1e-6


def _sketched(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """Those pairs (u, v) whose sketches leave a Jaccard of at least so much."""
    x, y = (own.select(F.col("fp").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "uv")
    return pairs.join(x, "u").join(y, "v").where(_within("sketch_u", "sketch_v", far(least))).select("u", "v")


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with one row left of each component of pairs with at least this Jaccard: that with the least doc_id (null last; of equal ids, one).

    Rows are picked from docs by id and a hash of the whole row; rows that are equal in every column count once. Columns
    of any name and type come through as they are. Null and blank texts are the empty set, which is one group: one of
    them stays. An empty table gives an empty one.
    """
    marked = carried(docs)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("row"))
    own = staged(_entries(marked).groupBy("fp").agg(F.min(first).alias("holder"), F.first("n").alias("n"), F.min("print").alias("print"), F.first("sketch").alias("sketch"), F.first("terms").alias("terms")), "sets")
    lists = _lists(own)
    alike = staged(_alike(own), "alike")
    members = lists.select("fp").unionByName(alike.select(F.col("u").alias("fp"))).unionByName(alike.select(F.col("v").alias("fp"))).distinct().join(own.select("fp", "holder"), "fp").select("fp", F.col("holder.row").alias("_r"), F.col("holder.doc_id").alias("_d"))
    texts = marked.select("doc_id", "_row", "text").join(members, (F.col("_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("fp", F.col("text").cast("string").alias("text"))
    sets = _sets(texts.dropDuplicates(["fp"]))

    star = lists.where(F.col("fp") != F.col("root")).where(_sized("n", "root_n", least)).select(F.col("fp").alias("u"), F.col("root").alias("v")).unionByName(alike).distinct()
    star = staged(_sketched(star, own, least), "pairs")
    near = _near(star, sets, least)
    found = components(near)
    rest = lists.where(F.col("fp") != F.col("root")).join(found, F.col("fp") == F.col("node"), "left").select("term", "fp", "n", F.coalesce("label", "fp").alias("label"))
    split = rest.groupBy("term").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("term")
    rest = staged(rest.join(split, "term", "left_semi").join(own.select("fp", "sketch"), "fp").join(sets.select("fp", "parities"), "fp"), "lists")
    x, y = (rest.select("term", F.col("fp").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "label", "sketch", "parities")]) for c in "uv")
    more = x.join(y, "term").where("u > v and label_u <> label_v").where(_sized("n_u", "n_v", least)).where(_within("sketch_u", "sketch_v", far(least))).where(_even("u", "v", least)).select("u", "v").distinct().join(star, ["u", "v"], "left_anti")
    found = components(near.unionByName(_near(more, sets, least)))

    named = own.join(found, F.col("fp") == F.col("node"), "left").select(F.coalesce("label", "fp").alias("component"), "holder")
    kept = named.groupBy("component").agg(F.min("holder").alias("holder")).select(F.col("holder.row").alias("_r"), F.col("holder.doc_id").alias("_d"))
    picked = marked.join(kept, (F.col("_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    return restored(one_row(picked), docs.columns)
