"""Language identification by bit-sliced Bloom filters over character n-grams.

One array of masks is all languages' Bloom filters at once: bit L of slot s says that s is set in language L's filter,
so the AND of an n-gram's slots is the set of all languages that may contain it. A text's n-grams are looked up in
numpy batches; hits are counted for each language and corrected for its filter's rate of false positives.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import held_out, in_batches, take_memory

SIZES, SLOTS, HASHES = (2, 3, 4), 1 << 20, 3
#: The filters are fitted on about this many labelled rows of each language, chosen by a hash of their id and text.
SAMPLE = 4000
#: An n-gram belongs to a language if it has at least this share of the n-gram's highest rate in any language.
SHARE, LEAST = 0.25, 3
_LETTER = re.compile(r"[^\W\d_]")
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(text: str, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Hashes of the n-grams inside the text's lower-cased words, a blank before and after each; none without letters."""
    clean = re.sub(r"[\W\d_]+", " ", text.lower())
    if not clean.strip():
        return np.empty(0, np.uint64)
    c = np.frombuffer(f" {clean.strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = c == 32
    out = []
    for n in sizes:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ c[k : k + m]) * _P1
            h ^= h >> np.uint64(29)
        inside = np.ones(m, bool)
        for k in range(1, n - 1):
            inside &= ~blank[k : k + m]
        if n == 2:
            inside &= ~(blank[:m] & blank[1 : 1 + m])
        out.append(h[inside])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def slots(h: np.ndarray, size: int = SLOTS, hashes: int = HASHES) -> list[np.ndarray]:
    a, b = h & np.uint64(0xFFFFFFFF), (h * _P2) >> np.uint64(32) | np.uint64(1)
    return [((a + np.uint64(k) * b) & np.uint64(size - 1)).astype(np.int64) for k in range(hashes)]


class Filters:
    """The languages and their filters; words of 64 languages each."""

    def __init__(self, langs: list[str], size: int = SLOTS):
        self.langs, self.size = langs, size
        self.masks = np.zeros((max(1, -(-len(langs) // 64)), size), np.uint64)
        self.false = np.zeros(len(langs))

    def add(self, lang: int, h: np.ndarray) -> None:
        for s in slots(h, self.size):
            self.masks[lang // 64][s] |= np.uint64(1 << lang % 64)

    def close(self) -> Filters:
        """Works out the rates of false positives: a filter's share of set bits to the power of the number of hashes."""
        for k in range(len(self.langs)):
            self.false[k] = ((self.masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() ** HASHES
        return self

    def hits(self, texts: list[np.ndarray]) -> np.ndarray:
        """For each text and language, how many of the text's n-grams the language holds, without the expected false ones."""
        sizes = np.array([len(x) for x in texts])
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        h = np.concatenate([texts[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        places = slots(h, self.size)
        for w in range(len(self.masks)):
            held = self.masks[w][places[0]]
            for s in places[1:]:
                held &= self.masks[w][s]
            for k in range(w * 64, min(len(self.langs), w * 64 + 64)):
                out[full, k] = np.add.reduceat(((held >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int32), starts)
        return np.clip((out - sizes[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)), 0, None)


def _count(pdf, sizes):
    """The n-gram counts of a few rows of one language."""
    import pandas as pd

    h = [grams(x, sizes) for x in pdf["text"]]
    u, n = np.unique(np.concatenate(h) if h else np.empty(0, np.uint64), return_counts=True)
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "h": u.view(np.int64), "n": n})


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 1) -> Filters:
    """Filters of the languages of docs (text, lang; rows with a null in either are passed over).

    A bounded sample of about ``sample`` rows of each language: a hash of id and text decides, so reruns agree. Rows of
    a language are counted in 64 groups; the counts of n-grams, bounded by the sample, come to the driver as hashes.
    """
    rows = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit(seed), "doc_id", F.length("text"), F.substring("text", 1, 64)).alias("pick"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters([]).close()
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))])
    picked = rows.where(F.pmod("pick", F.lit(1 << 20)) < share[F.col("lang")] * F.lit(1 << 20))
    counted = picked.groupBy("lang", F.pmod(F.shiftright("pick", 20), F.lit(64)).alias("part")).applyInPandas(lambda pdf: _count(pdf, SIZES), "lang string, h long, n long")
    counts = counted.groupBy("lang", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).toPandas()
    totals = counts.groupby("lang")["n"].sum().to_dict()
    counts["rate"] = counts["n"] / counts["lang"].map(totals)
    counts = counts[counts["rate"] >= SHARE * counts.groupby("h")["rate"].transform("max")]
    # The filters hold the commonest n-grams that keep an eighth of the slots clear of each other's bits.
    out = Filters(langs)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang].sort_values(["n", "h"], ascending=[False, True])["h"].to_numpy()[: SLOTS // (2 * HASHES)]
        out.add(k, own.view(np.uint64))
    return out.close()


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with lang_pred and score; columns of docs with these names are replaced.

    und and 0 if the text is null or has no letter, or if no language was learned. score is the winner's share of all
    languages' corrected hits (ties: the smaller code); a text of which no n-gram is known gets the first language, 0.
    """
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast((filters.langs, filters.size, filters.masks, filters.false))  # fixed size
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        take_memory("language")
        own = Filters.__new__(Filters)
        own.langs, own.size, own.masks, own.false = held.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            pred, score, at = [], [], 0
            while at < len(texts):  # some ten thousand words at once
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < 1 << 16):
                    chars += len(texts[end] or "")
                    end += 1
                part = texts[at:end]
                letters = [x is not None and bool(_LETTER.search(x)) and bool(own.langs) for x in part]
                if own.langs:
                    hits = own.hits([grams(x) if ok else np.empty(0, np.uint64) for x, ok in zip(part, letters)])
                    best, total = hits.argmax(1), hits.sum(1)
                    pred += [own.langs[b] if ok else "und" for b, ok in zip(best, letters)]
                    score += [float(h[b] / t) if ok and t > 0 else 0.0 for h, b, t, ok in zip(hits, best, total, letters)]
                else:
                    pred, score = pred + ["und"] * len(part), score + [0.0] * len(part)
                at = end
            cols = [batch.column(k) for k in range(len(names))] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("_text"))
    return in_batches(rows, run, StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame, modulus: int = 5, **options) -> DataFrame:
    """docs with held_out, lang_pred and score, learned from the labelled rows that aren't held out."""
    out = held_out(F.col("doc_id"), modulus, 0)
    return predict(docs.withColumn("held_out", out), fit(docs.where(~out), **options))


def accepted(docs: DataFrame, modulus: int = 5, lift: float = 1.15, **options) -> DataFrame:
    """The rows of docs whose language can be told: not und, and the winner's share at least ``lift`` times an even one.

    Null texts and texts without letters go; if no row has a language to learn from, all rows stay, and an empty table
    stays empty. Rows are judged one by one, whatever repeats; columns of any name and type come through as they are.
    """
    filters = fit(docs.where(~held_out(F.col("doc_id"), modulus, 0)), **options)
    if not filters.langs:
        return docs
    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(docs.columns)], F.col("text"))  # whatever the columns' names
    found = predict(own, filters).where((F.col("lang_pred") != "und") & (F.col("score") >= min(1.0, lift / len(filters.langs))))
    return found.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(docs.columns)])
