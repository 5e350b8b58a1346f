"""Column functions over text. All offsets and lengths are code points; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scripts that tokens are made of, and how questions end.
RUN = "[0-9A-Za-z一-鿿]{2,}"
CJK_START = "^[一-鿿]"
CJK = "[一-鿿]"
LOW_RUN = "[0-9a-z]{2,}"
APART = r"[一-鿿\u0130\u212a]"
UNIT = "[一-鿿]|[0-9A-Za-z]+"
ASKING = r"(是多少|是多大|是多小|是啥|是什么|怎么样|如何|怎么|为什么|吗|呢|了|啊|呀)+\s*$"


def fields(text: Column) -> Column:
    """Tokens of a text, repeats kept: lower-cased runs of letters, digits and CJK of two or more; a run that begins with CJK gives all its bigrams.

    A text without CJK is lower-cased whole and its runs are taken as they are, unless it has one of the two other letters that a lower case turns into ASCII.
    """
    plain = F.regexp_extract_all(F.lower(text), F.lit(LOW_RUN), F.lit(0))
    return F.when(text.rlike(APART), _fields_by_run(text)).otherwise(plain)


def _fields_by_run(text: Column) -> Column:
    grams = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.lower(F.substring(r, i, F.lit(2))))
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(CJK_START), grams(r)).otherwise(F.array(F.lower(r)))))


def unigrams(text: Column) -> Column:
    """Order-independent fingerprint of a query: distinct single CJK characters and words, sorted by code point."""
    plain = F.regexp_replace(text, ASKING, "")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(UNIT), F.lit(0)), F.lower)))


def topic_key(text: Column) -> Column:
    return F.substring(F.sha2(F.array_join(unigrams(text), "|"), 256), 1, 16)


#: Unicode white space other than the line end, as a regular expression's characters; fixed values.
BLANKS = r" \t\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^[{BLANKS}\\n\\r]+|[{BLANKS}\\n\\r]+$", "")


def normalize(text: Column) -> Column:
    """Without NUL, line ends as \\n, runs of other white space as one space, trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, "\x00", ""), "\r\n?", "\n")
    t = F.regexp_replace(t, f"[{BLANKS}]+", " ")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def extract_html(html: Column) -> Column:
    """Plain text of a page: scripts, styles and comments to a space, breaks and block ends to line ends, other tags dropped, entities decoded with &amp; last."""
    steps = ((r"(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|li|tr|h[1-6]|section|article|blockquote|table)>", "\n"), (r"<[^>]+>", ""))
    t = html
    for pattern, by in steps:
        t = F.regexp_replace(t, pattern, by)
    for entity, by in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(by))
    return trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


#: Fixed values, in the order of decoding.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def share_of(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise(F.round((n - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(n, F.lit(1)), 6))


def textiness(text: Column) -> Column:
    """Share of characters that are letters, digits, punctuation or white space."""
    return share_of(text, r"[\p{L}\p{Nd}\p{P}\s]")


def wordiness(text: Column) -> Column:
    """Share of the non-space characters that stand in runs of two or more."""
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    runs = F.length(F.array_join(F.regexp_extract_all(text, F.lit(r"\S{2,}"), F.lit(0)), ""))
    return F.when(solid == 0, 0.0).otherwise(F.round(runs / F.greatest(solid, F.lit(1)), 6))


def first_script(text: Column) -> Column:
    """zh or en by the first CJK or Latin character; zh if there is none."""
    found = F.regexp_extract(text, "[一-鿿A-Za-z]", 0)
    return F.when(found.rlike("^[A-Za-z]$"), "en").otherwise("zh")


def jaccard_tokens(text: Column) -> Column:
    """Distinct lower-cased white-space tokens, and their CJK characters one by one."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    parts = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit("[一-鿿]|[^一-鿿]+"), F.lit(0))))
    return F.array_distinct(F.concat(tokens, parts))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.greatest(F.length(part), F.lit(1))).cast("int")


def hits(tokens: Column, text: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: F.contains(text, t)))


def coverage(tokens: Column, text: Column) -> Column:
    """Share of the tokens, repeats counted, that the lower-cased text contains."""
    return F.coalesce(F.try_divide(hits(tokens, F.lower(text)).cast("double"), F.size(tokens).cast("double")), F.lit(0.0))


def confidence(mean_score: Column, cover: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * mean_score / 10 + 0.5 * cover)), 3)


def keyword_score(tokens: Column, text: Column) -> Column:
    """0..10 by the share of tokens that the lower-cased text contains, steeper where more are."""
    n, k = F.size(tokens), hits(tokens, F.lower(text))
    d = F.try_divide(k.cast("double"), n.cast("double"))
    return F.when((n == 0) | (k == 0), 0.0).when(d >= 0.8, 8 + 2 * d - 1.6).when(d >= 0.4, 5 + 3 * (d - 0.4) / 0.4).otherwise(1 + 10 * d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without one."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))


def numeric_claim(evidence: Column, content: Column) -> Column:
    """The first number of the evidence, else of the content, else empty."""
    own = F.regexp_extract(evidence, "[0-9]+", 0)
    return F.when(own != "", own).otherwise(F.regexp_extract(content, "[0-9]+", 0))
