"""Quality rules: a threshold table compiled into one projection of built-in functions, without shuffles.

Lengths, symbols, stop words and repeated lines and word windows of each whole text become columns, and the table's
rows become one boolean over them. Repeated windows come from the sorted hashes of a text's windows, and only texts
that have any are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Characters that count as symbols; fixed by the contract.
SYMBOLS = "#*$%&|<>"
#: Common words of the languages that occur, fixed values.
STOP_WORDS = """
the of and to is in a that it was for on are as with he she they be at this have from or had by not but what all were
le la les de des du et un une en est que qui dans pour sur pas avec ce au aux
der die das und ist in den von zu mit sich auf für ein eine im dem nicht auch es an
el la los las de y que en un una se del por con para su al lo es
""".split()
#: (measure, least, most, fewest words for which it holds); None: no bound.
THRESHOLDS = (
    ("n_words", 10, None, 0),
    ("mean_word_chars", 1.8, 14.0, 20),
    ("symbols_per_word", None, 0.1, 0),
    ("shouts_per_word", None, 0.2, 0),
    ("stop_word_share", 0.02, None, 50),
    ("dup_line_share", None, 0.5, 0),
    ("repeat_word_share", None, 0.2, 0),
)
REPEAT_WINDOW = 5


def _letters_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated(words: Column, width: int = REPEAT_WINDOW) -> Column:
    """How many words lie in windows of width words that occur twice or more, the first included."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))

    def covered(h: Column) -> Column:
        def of(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False)))
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda n, x: n + x))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, of))

    return F.when(F.size(words) < width + 1, 0).otherwise(let(hashes, covered))


def measures(docs: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """docs with the columns of a text's lengths, symbols, stop words, lines and windows; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = sorted({w.lower() for w in stop_words})

    def of(words: Column) -> Column:
        stops = F.size(F.filter(words, lambda w: F.lower(F.translate(w, ".,;:!?", "")).isin(own)))
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated(words).cast("long").alias("n_repeat_words"), stops.cast("long").alias("n_stop_words"))

    rows = docs.withColumn("_m", let(words_of(F.col("text")), of))
    rows = rows.withColumns({k: F.col(f"_m.{k}") for k in ("n_words", "n_repeat_words", "n_stop_words")})
    return rows.withColumns({
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"), "n_symbols": _letters_of(text, SYMBOLS).cast("long"), "n_shouts": _letters_of(text, "!").cast("long"),
        "_l": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
    }).withColumns({"n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.dup")}).drop("_m", "_l")


def verdict(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean over the columns of measures(): true if no rule fails."""
    per = lambda k, n: F.col(k) / F.greatest(F.col(n), F.lit(1))
    values = {"n_words": F.col("n_words"), "mean_word_chars": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "shouts_per_word": per("n_shouts", "n_words"), "stop_word_share": per("n_stop_words", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_word_share": per("n_repeat_words", "n_words")}
    good = F.lit(True)
    for name, least, most, words in thresholds:
        rule = F.lit(True)
        if least is not None:
            rule = rule & (values[name] >= F.lit(least))
        if most is not None:
            rule = rule & (values[name] <= F.lit(most))
        good = good & ((F.col("n_words") < F.lit(words)) | rule)
    return good


def judged(docs: DataFrame, thresholds=THRESHOLDS, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """docs with the measures, base_failed and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated five-word windows. kept: not base_failed and
    within every threshold. Null and blank texts have no words and fail. Rows are judged one by one, whatever repeats;
    no rows give none; columns of docs with the name of a measure are replaced.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, stop_words).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))


def passed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that judged() keeps, with all their columns unchanged, whatever their names."""
    names = list(docs.columns)
    own = docs.select(F.col("text"), *[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(names)])
    return judged(own, **options).where("kept").select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(names)])
