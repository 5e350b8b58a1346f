"""A hashed maximum-entropy language model with class-factored softmax.

A word is scored as P(class | history) * P(place in class | class, history) * P(word | class, place). Endings are hashed to
4,096 kinds, and a kind's class is learned: kinds whose neighbours are alike are put together, so that classes tell
languages and uses apart. The place is a hash of the word. Both softmaxes are log-linear in hashed features of the words
before: the last word, the one before it with the last skipped, the pair of their classes and the pair of classes two words
further back for the class; the pairs of the own class with the last word's and with that of the one before for the place.
The third factor shares a place out among its words by add-one counts, one share being for all unseen words. Counts cover
every training token, and so do the neighbours' counts. The weights are trained in rounds over disjoint parts of the
training rows: each trainer takes AdaGrad steps over its rows from common weights, and the changes are averaged, by
tokens, in levels of 64 changes each. What words' counts gather grows with the corpus; the classes and the weights of the contexts
have a fixed size.

A word's number is 64 bits: a hash above, its ending's kind and its place below. Texts are split into words once; their
numbers are written and read by all later steps. The commonest words' counts go to every task (a fixed number); the other
words of a text are joined to the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_batches, staged, take_memory

CLASSES, PLACES, ROWS, KINDS, NEAR = 32, 32, 4096, 4096, 64
HEAD, ROUNDS, BATCH, RATE = 1 << 18, 2, 4096, 0.15
ENDING = 3
_SLOTS = CLASSES * PLACES
_LOW = KINDS * PLACES  # the part of a number that says kind and place
_END, _BEFORE = b"\n", b"\r"  # no word holds white space
_MEMORY = 200_000
SLICE = 1 << 15  # of the weights, summed over the trainers by one task of a level
_memo: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})  # words seen lately, and before those


def number(word: bytes) -> int:
    """The number of a word."""
    from xxhash import xxh64_intdigest

    ending = word.rstrip(b".,;:!?|")[-ENDING:]
    own, kind = xxh64_intdigest(word, 1), xxh64_intdigest(ending, 2) % KINDS
    x = own >> 17 << 17 | kind * PLACES + own % PLACES
    return x - (1 << 64) if x >> 63 else x


def _forget() -> None:
    global _memo
    _memo = {}, {}


def numbers(words: list[bytes]) -> np.ndarray:
    """The numbers of words; what is remembered is bounded by two generations."""
    global _memo
    new, old = _memo
    found = list(map(new.get, words))
    if None in found:
        if len(new) > _MEMORY:
            _memo = new, old = {}, new
        for i in [i for i, x in enumerate(found) if x is None]:
            w = words[i]
            x = new.get(w)
            if x is None:
                x = old.get(w)
                if x is None:
                    x = number(w)
                if len(w) <= 64:
                    new[w] = x
            found[i] = x
    return np.array(found, np.int64)


def tokens_of(text: bytes | None) -> np.ndarray:
    """The numbers of a text's words and of its end."""
    return numbers([*(text or b"").lower().split(), _END])


def numbered(docs: DataFrame) -> DataFrame:
    """docs with each text's words as numbers (words, bytes of 64-bit integers, the end included) in its place, written once.

    A null or blank text has its end alone. Rows stand one by one, whatever repeats; no rows give none.
    """

    def run(batches):
        take_memory("words", _forget)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([tokens_of(x).tobytes() for x in texts], pa.binary())], [*batch.schema.names[:-1], "words"])

    names = [c for c in docs.columns if c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema]
    return staged(in_batches(docs.select(*names, F.col("text").cast("string").alias("text")), run, ", ".join([*fields, "words binary"])), "numbers")


def _words(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in batch.column(batch.num_columns - 1).to_pylist()]


def count(rows: DataFrame) -> DataFrame:
    """(near, id, n): how often each word occurs in all texts, the ends included; pre-aggregated in the tasks.

    Rows marked near stand apart: how often a kind of ending has words of each of NEAR sorts beside it or one word away.
    """

    def run(batches):
        held, size, near = [], 0, np.zeros(KINDS * NEAR, np.int64)
        for batch in batches:
            for words in _words(batch):
                held.append(words)
                size += len(words)
                if size > 2_000_000:
                    yield from flush(held, near)
                    held, size = [], 0
        yield from flush(held, near)
        some = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(near[some]), pa.array(np.ones(len(some), bool))], ["id", "n", "near"])

    def flush(held, near):
        if held:
            words = np.concatenate(held)
            kind = (words >> 5) & (KINDS - 1)
            sort = kind & (NEAR - 1)
            for step in (1, 2):
                near += np.bincount(kind[step:] * NEAR + sort[:-step], minlength=KINDS * NEAR)
                near += np.bincount(kind[:-step] * NEAR + sort[step:], minlength=KINDS * NEAR)
            u, n = np.unique(words, return_counts=True)
            for k in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000]), pa.array(n[k : k + 100_000]), pa.array(np.zeros(len(u[k : k + 100_000]), bool))], ["id", "n", "near"])

    return in_batches(rows.select("words"), run, "id long, n long, near boolean").groupBy("near", "id").agg(F.sum("n").alias("n"))


def classes_of(near: np.ndarray, tokens: np.ndarray, steps: int = 12) -> np.ndarray:
    """The class of each kind from its neighbours' counts (KINDS by NEAR) and its tokens: weighted k-means over shares' square roots.

    Kinds are put together greedily from the commonest on, then moved; ties go to the lower number, so reruns agree.
    """
    x = np.sqrt((near + 0.5 * near.sum(0) / max(1, near.sum())) / np.maximum(1.0, near.sum(1, keepdims=True) + 0.5))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    weight = np.sqrt(tokens.astype(float))
    centres = [int(tokens.argmax())]
    far = 1 - x @ x[centres[0]]
    while len(centres) < CLASSES:
        centres.append(int((far * weight).argmax()))
        far = np.minimum(far, 1 - x @ x[centres[-1]])
    c, weight = x[centres], tokens.astype(float)
    for _ in range(steps):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x * weight[:, None])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return (x @ c.T).argmax(1).astype(np.uint16)


class Weights:
    """The tables of both softmaxes, float32."""

    SHAPES = ((ROWS, CLASSES), (ROWS, CLASSES), (CLASSES * CLASSES, CLASSES), (CLASSES * CLASSES, CLASSES), (CLASSES * CLASSES, PLACES), (CLASSES * CLASSES, PLACES))

    def __init__(self, tables: list[np.ndarray], class_bias: np.ndarray, place_bias: np.ndarray):
        self.tables, self.class_bias, self.place_bias = tables, class_bias.astype(np.float32), place_bias.astype(np.float32)

    @classmethod
    def start(cls, counts: np.ndarray) -> Weights:
        """From the tokens of each slot: what the slots' own shares give, and zero weights."""
        n = counts.reshape(CLASSES, PLACES) + 1.0
        return cls([np.zeros(s, np.float32) for s in cls.SHAPES], np.log(n.sum(1) / n.sum()), np.log(n / n.sum(1, keepdims=True)))

    def flat(self) -> np.ndarray:
        return np.concatenate([t.ravel() for t in self.tables])

    def moved(self, by: np.ndarray) -> Weights:
        out, at = [], 0
        for t in self.tables:
            out.append(t + by[at : at + t.size].reshape(t.shape).astype(np.float32))
            at += t.size
        return Weights(out, self.class_bias, self.place_bias)


def features(line: np.ndarray, table: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Class, place and rows of the tables for the words of a line from start (4 at least) to end; table: the kinds' classes."""
    own = line[start - 4 : end]
    kind = table[(own >> 5) & (KINDS - 1)]
    row = ((own >> 17) & (ROWS - 1)).astype(np.uint16)
    k0, k1, k2, k3, k4 = kind[4:], kind[3:-1], kind[2:-2], kind[1:-3], kind[:-4]
    return k0, (own[4:] & (PLACES - 1)).astype(np.uint16), [row[3:-1], row[2:-2], k1 * CLASSES + k2, k3 * CLASSES + k4, k0 * CLASSES + k1, k0 * CLASSES + k2]


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def logits(w: Weights, own: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = w.tables
    a = t[0][rows[0]]
    a += t[1][rows[1]]
    a += t[2][rows[2]]
    a += t[3][rows[3]]
    a += w.class_bias
    b = t[4][rows[4]]
    b += t[5][rows[5]]
    b += w.place_bias[own]
    return a, b


def line_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one line of words, four starts before each, and which of the line are words of the texts."""
    pad = np.full(4, number(_BEFORE), np.int64)
    line = np.concatenate([x for t in texts for x in (pad, t)])
    keep = np.ones(len(line), bool)
    starts = np.cumsum([0, *(len(t) + 4 for t in texts[:-1])])
    keep[(starts[:, None] + np.arange(4)).ravel()] = False
    return line, keep


def train(w: Weights, table: np.ndarray, line: np.ndarray, keep: np.ndarray, sums: list[np.ndarray], rate: float = RATE) -> None:
    """AdaGrad steps over batches of the words of a line; changes w and sums."""
    for k in range(4, len(line), BATCH):
        end = min(len(line), k + BATCH)
        own, place, rows = features(line, table, k, end)
        if not keep[k:end].all():
            own, place, rows = own[keep[k:end]], place[keep[k:end]], [r[keep[k:end]] for r in rows]
        a, b = logits(w, own, rows)
        i = np.arange(len(own))
        for z, y, which in ((a, own, (0, 1, 2, 3)), (b, place, (4, 5))):
            g = _softmax(z)
            g[i, y] -= 1
            for f in which:
                order = np.argsort(rows[f], kind="stable")  # two bytes wide: a radix sort
                r = rows[f][order]
                first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                total, r = np.add.reduceat(g[order], first, axis=0), r[first]
                sums[f][r] += total * total
                w.tables[f][r] -= rate * total / np.sqrt(sums[f][r] + 1.0)


def train_round(rows: DataFrame, w: Weights, table: np.ndarray) -> Weights:
    """The common weights after each trainer's steps over its rows: every task of the scan is a trainer."""
    sent = rows.sparkSession.sparkContext.broadcast((w.tables, w.class_bias, w.place_bias, table))  # fixed size

    def run(batches):
        take_memory("weights")
        tables, cb, pb, table = sent.value
        own = Weights([t.copy() for t in tables], cb, pb)
        sums, n, held, size = [np.zeros_like(t) for t in tables], 0, [], 0
        for batch in batches:
            for words in _words(batch):
                held.append(words)
                size += len(words)
                if size >= 16 * BATCH:
                    train(own, table, *line_of(held), sums)
                    n, held, size = n + size, [], 0
        if held:
            train(own, table, *line_of(held), sums)
            n += size
        if n:
            part = TaskContext.get().partitionId()
            moved = n * (own.flat() - Weights(tables, cb, pb).flat()).astype(np.float64)
            for k in range(0, len(moved), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k // SLICE], pa.int32()), pa.array([n], pa.int64()), pa.array([moved[k : k + SLICE].tobytes()], pa.binary())], ["part", "slice", "n", "moved"])

    trained = in_batches(rows.select("words"), run, "part long, slice int, n long, moved binary")
    slices = sorted(summed_in_levels(trained, rows.rdd.getNumPartitions()).collect(), key=lambda r: r["slice"])  # the weights' own size
    return w.moved(np.concatenate([np.frombuffer(r["moved"], np.float64) for r in slices]) / slices[0]["n"]) if slices else w


def summed_in_levels(slices: DataFrame, parts: int, fan_in: int = 64) -> DataFrame:
    """(part, slice, n, moved) summed over parts to one row for each slice, in levels of ``fan_in`` parts.

    A task adds up the rows of one slice from at most ``fan_in`` parts, one row after the other, however many parts there
    are. No rows give none.
    """

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for b in batches:
            for m, x in zip(b.column(b.schema.get_field_index("n")).to_pylist(), b.column(b.schema.get_field_index("moved")).to_pylist()):
                x = np.frombuffer(x, np.float64)
                n, s = n + m, x if s is None else s + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["part", "slice", "n", "moved"])

    while True:
        parts = -(-parts // fan_in)
        slices = slices.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part", "slice").applyInArrow(total, "part long, slice int, n long, moved binary")
        if parts <= 1:
            return slices


class Model:
    """Weights and counts of a training corpus."""

    def __init__(self, weights: Weights, table: np.ndarray, vocabulary: DataFrame, head: tuple[np.ndarray, np.ndarray], slot_tokens: np.ndarray, slot_words: np.ndarray):
        self.weights, self.table, self.vocabulary, self.head = weights, table, vocabulary, head
        self.slot_tokens, self.slot_words = slot_tokens, slot_words
        self.tokens, self.words = int(slot_tokens.sum()), int(slot_words.sum())


def commonest(vocabulary: DataFrame, head: int):
    """The commonest words, at most ``head``, by id. Counts fall into 16 steps for each doubling; whole steps are taken, so no task sends more than its share."""
    step = F.floor(F.log2("n") * 16)
    sizes = {r["step"]: r["words"] for r in vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}  # 16 a doubling
    least, total = None, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > head:
            break
        least = k
    return vocabulary.where(step >= (least if least is not None else 1 << 20)).toPandas().sort_values("id")


def fit(rows: DataFrame, rounds: int = ROUNDS, head: int = HEAD) -> Model:
    """Learns from every text of numbered rows. Without rows, all words are unseen and every class alike."""
    counted = staged(count(rows), "vocabulary")
    vocabulary = counted.where("not near").select("id", "n")
    top = commonest(vocabulary, head)
    near = np.zeros(KINDS * NEAR)
    found = counted.where("near").select("id", "n").toPandas()  # KINDS * NEAR rows at most
    near[found["id"]] = found["n"]
    low = vocabulary.groupBy(F.col("id").bitwiseAND(F.lit(_LOW - 1)).alias("low")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()  # _LOW rows at most
    each, words = np.zeros(_LOW, np.int64), np.zeros(_LOW, np.int64)
    each[low["low"]], words[low["low"]] = low["n"], low["words"]
    table = classes_of(near.reshape(KINDS, NEAR), each.reshape(KINDS, PLACES).sum(1))
    slot_tokens, slot_words = (np.stack([np.bincount(table, x.reshape(KINDS, PLACES)[:, p], CLASSES) for p in range(PLACES)], axis=1).astype(np.int64).ravel() for x in (each, words))
    w = Weights.start(slot_tokens)
    turn = F.pmod(F.xxhash64("doc_id", F.octet_length("words")), F.lit(rounds))
    for k in range(rounds):
        w = train_round(rows.where(turn == k), w, table)
    return Model(w, table, vocabulary, (top["id"].to_numpy(np.int64), top["n"].to_numpy(np.int64)), slot_tokens, slot_words)


def score(numbers: DataFrame, model: Model) -> DataFrame:
    """Each numbered row's doc_id and held_out with n_tokens, n_known, train_tokens, base_score and score.

    Rows are scored one by one, equal ones alike; null and blank texts are their end alone. No rows give none.
    """
    w, place = model.weights, (model.slot_tokens + model.slot_words + 1).astype(float)
    sent = numbers.sparkSession.sparkContext.broadcast(((w.tables, w.class_bias, w.place_bias), model.table, model.head, np.log10(place)))  # fixed size
    kind = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("path", pa.float64()), ("shares", pa.float64()), ("known", pa.int64()), ("rare", pa.list_(pa.int64()))])

    def run(batches):
        take_memory("weights")
        parts, table, (ids, counts), log_place = sent.value
        own, known = Weights(*parts), np.log10(counts + 1.0)
        for batch in batches:
            rid, doc_id, out = (batch.column(k) for k in range(3))
            texts, at = _words(batch), 0
            while at < len(texts):
                held, size, start = [], 0, at
                while at < len(texts) and (size < 8 * BATCH):
                    held.append(texts[at])
                    size, at = size + len(held[-1]), at + 1
                yield scored(own, table, ids, known, log_place, held, rid.slice(start, at - start), doc_id.slice(start, at - start), out.slice(start, at - start))

    def scored(own, table, ids, known, log_place, held, rid, doc_id, out):
        line, keep = line_of(held)
        path = np.zeros(len(line))
        for k in range(4, len(line), BATCH):
            end = min(len(line), k + BATCH)
            kinds, places, rows = features(line, table, k, end)
            i = np.arange(len(kinds))
            for z, y in zip(logits(own, kinds, rows), (kinds, places)):
                z -= z.max(1, keepdims=True)
                path[k:end] += z[i, y] - np.log(np.exp(z).sum(1))
        words, path = line[keep], path[keep]
        path = path / np.log(10) - log_place[table[(words >> 5) & (KINDS - 1)].astype(np.int64) * PLACES + (words & (PLACES - 1))]
        sizes = np.array([len(x) for x in held])
        starts = np.cumsum(np.append(0, sizes[:-1]))
        j = np.searchsorted(ids, words)
        j[j == len(ids)] = 0
        here = ids[j] == words if len(ids) else np.zeros(len(words), bool)
        share = np.where(here, known[j], 0.0) if len(ids) else np.zeros(len(words))
        rare = words[~here]
        edges = np.append(0, np.cumsum(np.add.reduceat((~here).astype(np.int32), starts)))
        return pa.RecordBatch.from_arrays([rid, doc_id, out, pa.array(sizes), pa.array(np.add.reduceat(path, starts)), pa.array(np.add.reduceat(share, starts)), pa.array(np.add.reduceat(here.astype(np.int64), starts)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(rare))], schema=kind)

    rows = numbers.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "words")
    rows = staged(in_batches(rows, run, "rid long, doc_id long, held_out boolean, n_tokens long, path double, shares double, known long, rare array<long>"), "scored")
    found = rows.select("rid", F.explode("rare").alias("id")).join(model.vocabulary, "id").groupBy("rid").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("found"))
    rows = rows.drop("rare").join(found, "rid", "left")
    share = F.col("shares") + F.coalesce("more", F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (share - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.words + 1)))).alias("base_score"), (share + F.col("path")).alias("score"),
    )


def learn_and_score(docs: DataFrame, modulus: int = 7, remainder: int = 2, **options) -> DataFrame:
    """Scores all rows of docs with a model of those that aren't held out."""
    rows = numbered(docs.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "text"))
    return score(rows, fit(rows.where(~F.col("held_out")), **options))
