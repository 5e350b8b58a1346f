"""Importance resampling towards a target's distribution of hashed word features, with Gumbel top-k draws.

Two passes over the texts: one counts features by bucket, the other sums an array of gains over each document's
features. The draw is a merge of sorted runs: every task sorts the eligible rows that can be drawn into runs, cuts them
at common splitters, and for each range of keys one task merges the runs' slices by a tournament tree. Ranks are the
range's exact offset plus the place in the merge, which stops when the exact count is drawn. No task holds more than a
range, however many rows are drawn, and rows behind the last range are never sorted or moved.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, staged

#: ASCII capitals to small letters, and all ASCII but letters and digits to spaces; words are what stands between spaces.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x > 127 or chr(x).isalnum() else 32 for x in range(256))
#: Rows of a range about, and least number of ranges; rows of a sorted run at most.
RANGE_ROWS, LEAST_RANGES, RUN_ROWS = 1 << 20, 16, 1 << 19
#: Sampled keys for each range that place the splitters; they move no result, only the ranges' sizes.
KEYS_A_RANGE = 16
#: Features whose gain a worker remembers at most.
_MEMO = 1 << 18


def features(text: bytes | None, width: int = 1) -> list[bytes]:
    """All runs of 1 to width words of a text, repeats included; None has none."""
    words = (text or b"").translate(_TABLE).split()
    return words + [b" ".join(words[i : i + k]) for k in range(2, width + 1) for i in range(len(words) - k + 1)]


def bucket_counts(texts: DataFrame, buckets: int, width: int) -> np.ndarray:
    """Features of all texts by bucket. At most ``buckets`` rows come from a task and to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            seen = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(features(text, width))
            for f, n in seen.items():
                total[zlib.crc32(f) % buckets] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in in_batches(texts.select(F.col("text").cast("binary").alias("text")), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln of the smoothed share in the target over that in the source) by bucket."""
    b, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for s, t in zip(source, target)]


class _Gains(dict):
    """A feature's gain, remembered; lets all go when full."""

    def __init__(self, by_bucket: list[int]):
        super().__init__()
        self.by_bucket = by_bucket

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        out = self[feature] = self.by_bucket[zlib.crc32(feature) % len(self.by_bucket)]
        return out


def _noise(seed: int) -> Column:
    """Gumbel noise in thousandths from the hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, by_bucket: list[int], width: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, n_words, weight and score (weight plus noise) of each row of docs; see resample()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Gains(by_bucket)
        for batch in batches:
            n, words, weights = [], [], []
            for text in batch.column(1).to_pylist():
                got = features(text, width)
                n.append(len(got))
                words.append(len(got) if width == 1 else len((text or b"").translate(_TABLE).split()))
                weights.append(sum(map(memo.__getitem__, got)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(weights, pa.int64())], names=["doc_id", "n_features", "n_words", "weight"])

    rows = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id long, n_features long, n_words long, weight long")
    return rows.withColumn("score", F.col("weight") + _noise(seed))


class Tournament:
    """Sorted iterators of tuples merged by a tree of matches: each row played costs one match for each level.

    ``winner[k]`` is the run that wins the matches below node k; the leaves are the runs' first rows, and a run that is
    out loses every match. Rows that compare equal come in the order of their runs.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.size = runs, 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.winner = [0] * self.size + list(range(self.size))
        for k in range(self.size - 1, 0, -1):
            self._play(k)

    def _play(self, k: int) -> None:
        a, b = self.winner[2 * k], self.winner[2 * k + 1]
        x, y = self.heads[a], self.heads[b]
        self.winner[k] = a if y is None or x is not None and x <= y else b

    def __iter__(self) -> Iterator[tuple]:
        while True:
            run = self.winner[1]
            if (head := self.heads[run]) is None:
                return
            self.heads[run] = next(self.runs[run], None)
            k = (self.size + run) >> 1
            while k:
                self._play(k)
                k >>= 1
            yield head

    def rest(self) -> Iterator[tuple]:
        """What was not merged, in any order and without matches."""
        for head, run in zip(self.heads, self.runs):
            if head is not None:
                yield head
                yield from run


#: A row as numbers that sort as rows are drawn: score from high to low, then doc_id from low to high, null last.
_KEY = ("score", "no_id", "doc_id", "n_features", "weight")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    col = lambda name: batch.column(batch.schema.get_field_index(name))
    ids = col("doc_id")
    return np.column_stack([-col("score").to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False), col("n_features").to_numpy(zero_copy_only=False), col("weight").to_numpy(zero_copy_only=False)]).astype(np.int64)


def _ranges(rows: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """For each row how many splitters (negative score, doc_id; sorted) stand before it."""
    low, high = (np.searchsorted(splitters[:, 0], rows[:, 0], side) for side in ("left", "right"))
    out = low.copy()
    for k in np.unique(low[high > low]):
        at = np.flatnonzero((low == k) & (high > low))
        own = splitters[k : high[at[0]], 1]
        out[at] = k + np.where(rows[at, 1] > 0, len(own), np.searchsorted(own, rows[at, 2], "left"))
    return out


def drawn(rows: DataFrame, draw: int, eligible: Column, n_eligible: int) -> DataFrame:
    """rows (doc_id, n_features, weight, score; a table that is read anew) with rank: 1 to draw by falling score, ties to the smaller doc_id.

    Exactly draw of the eligible rows get a rank, the others null. A null doc_id comes last among ties; rows that agree
    in all four columns are interchangeable. draw 0 or an empty table gives null ranks only.
    """
    plain = rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if draw == 0:
        return plain
    able = rows.where(eligible).select("doc_id", "n_features", "weight", "score")
    ranges = max(LEAST_RANGES, -(-draw // RANGE_ROWS))
    keys = KEYS_A_RANGE * ranges * n_eligible / draw
    sample = able.where(F.col("doc_id").isNotNull()).select("score", "doc_id").sample(min(1.0, keys / n_eligible), 7).collect()
    order = sorted((-r["score"], r["doc_id"]) for r in sample)[KEYS_A_RANGE // 2 :: KEYS_A_RANGE][: ranges + ranges // 5 + 2]
    splitters = np.array(sorted(set(order)), dtype=np.int64).reshape(-1, 2)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(splitters) + 1, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_ranges(_matrix(batch), splitters), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["range", "n"])

    sizes = np.zeros(len(splitters) + 1, dtype=np.int64)
    for r in in_batches(able, counted, "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():
        sizes[r["range"]] = r["n"]
    ends = np.cumsum(sizes)
    last = int(np.searchsorted(ends, draw))  # the range that the draw ends in
    starts = ends - sizes
    behind = F.lit(False)
    if last < len(splitters):
        s, d = int(-splitters[last, 0]), int(splitters[last, 1])
        behind = (F.col("score") < s) | ((F.col("score") == s) & (F.col("doc_id").isNull() | (F.col("doc_id") > d)))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted runs, cut at the splitters: a row for each slice."""

        def cut(parts: list[np.ndarray]) -> pa.RecordBatch:
            run = np.concatenate(parts)
            run = run[np.lexsort(run.T[::-1])]
            own = _ranges(run, splitters)
            at = np.flatnonzero(np.diff(own, prepend=-1))
            slices = np.split(run, at[1:])
            return pa.RecordBatch.from_arrays([pa.array(own[at], pa.int32()), pa.array([x.tobytes() for x in slices], pa.binary())], names=["range", "slice"])

        held, n = [], 0
        for batch in batches:
            held.append(_matrix(batch))
            n += len(held[-1])
            if n >= RUN_ROWS:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def played(run: np.ndarray) -> Iterator[tuple]:
            for k in range(0, len(run), 1024):
                yield from map(tuple, run[k : k + 1024].tolist())

        place = key[0].as_py()
        slices = [np.frombuffer(x, dtype=np.int64).reshape(-1, len(_KEY)) for b in batches for x in b.column(b.schema.get_field_index("slice")).to_pylist()]
        game, rank = Tournament([played(x) for x in slices]), int(starts[place])
        won = islice(iter(game), max(0, draw - rank))  # no match is played beyond the last draw
        for rows in (won, game.rest()):
            while got := list(islice(rows, 1 << 16)):
                table = np.array(got, dtype=np.int64)
                ranks = pa.array(np.arange(rank + 1, rank + 1 + len(got))) if rows is won else pa.nulls(len(got), pa.int64())
                rank += len(got)
                yield pa.RecordBatch.from_arrays([pa.array(table[:, 2], mask=table[:, 1] > 0), pa.array(table[:, 3]), pa.array(table[:, 4]), pa.array(-table[:, 0]), ranks], names=["doc_id", "n_features", "weight", "score", "rank"])

    slices = in_batches(able.where(~behind), runs, "range int, slice binary")
    ranked = slices.groupBy("range").applyInArrow(merged, "doc_id long, n_features long, weight long, score long, rank long")
    return ranked.unionByName(plain.where(~F.coalesce(eligible, F.lit(False)) | behind) if last < len(splitters) else plain.where(~F.coalesce(eligible, F.lit(False))))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, width: int = 1, share: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs: the draw of share % of those with least_words words, by likeness to target's texts.

    docs has doc_id (a long, or what casts to one) and text, target has text; other columns are not read. A null text has
    no features and weight 0; a null doc_id is hashed as an empty one. Empty tables give no rows, or gains from smoothing alone.
    """
    by_bucket = gains(bucket_counts(docs, buckets, width), bucket_counts(target, buckets, width))
    rows = staged(scored(docs, by_bucket, width, seed), "resample-scores")
    eligible = F.col("n_words") >= least_words
    n = rows.where(eligible).count()
    return drawn(rows, n * share // 100, eligible, n)
