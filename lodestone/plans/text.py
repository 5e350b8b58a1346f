"""Registered queries of the text functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ingest, lexicon
from .common import ITEMS, items, read, sources, sql_coverage, sql_fields, sql_hits, sql_keyword_score, sql_unigrams


def normalize_text(spark, d):
    return sources(spark, d).select("doc_id", F.sha2(tx.normalize(F.concat(F.lit(" \r\n"), F.replace("body", F.lit("e"), F.lit("e \t\u3000\u2009 ")))), 256).alias("digest"))


def content_digest(spark, d):
    return sources(spark, d).select("doc_id", tx.digest(F.col("body")).alias("digest"), F.concat(F.lit("src:"), F.substring(tx.digest(F.col("body")), 1, 16)).alias("source_id"))


def html_extract(spark, d):
    p = read(spark, d, "pages").select("page_id", tx.extract_html(F.col("html")).alias("body"))
    return p.select("page_id", F.length("body").cast("long").alias("n"), F.sha2("body", 256).alias("digest"))


#: The rules of extraction written out for SQL: scripts and styles, comments, line breaks, ends of blocks, other tags, entities, blank lines.
_BLANK = " \\t\\n\\r\\x0b\\x0c\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_HTML = r"""regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)[^>]*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""
_HTML = rf"""regexp_replace(regexp_replace(regexp_replace({_HTML}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|li|tr|h1|h2|h3|h4|h5|h6|section|article|blockquote|table)>', chr(10), 'g'), '<[^>]+>', '', 'g')"""
_HTML = f"replace(replace(replace(replace(replace(replace(replace(replace({_HTML}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&#x27;', chr(39)), '&apos;', chr(39)), '&amp;', '&')"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"


def quality(spark, d):
    s = sources(spark, d)
    return s.select("doc_id", tx.textiness(F.col("body")).alias("textiness"), tx.wordiness(F.col("body")).alias("wordiness"))


_SOLID = "length(regexp_replace(text, '\\s', '', 'g'))"
_TEXTINESS = "CASE WHEN length(text) = 0 THEN 0.0 ELSE round((length(text) - length(regexp_replace(text, '[\\p{L}\\p{Nd}\\p{P}\\s]', '', 'g')))::DOUBLE / length(text), 6) END"
_WORDINESS = f"CASE WHEN {_SOLID} = 0 THEN 0.0 ELSE round(length(array_to_string(regexp_extract_all(text, '\\S{{2,}}'), ''))::DOUBLE / {_SOLID}, 6) END"
_TOP_LINES = """l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents),
    c AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY 1, 2), t AS (SELECT doc_id, sum(n) AS lines, max(CASE WHEN line <> '' THEN n ELSE 0 END) AS top FROM c GROUP BY 1),
    top AS (SELECT doc_id, CASE WHEN lines < 32 OR top <= 1 THEN 0.0 ELSE round(top::DOUBLE / lines, 6) END AS top_line_share FROM t)"""


def top_line_share(spark, d):
    return ingest.top_line_share(sources(spark, d), "doc_id", "body")


def quality_gate(spark, d):
    s = sources(spark, d)
    q = s.select("doc_id", tx.textiness(F.col("body")).alias("textiness"), tx.wordiness(F.col("body")).alias("wordiness")).join(ingest.top_line_share(s, "doc_id", "body"), "doc_id")
    return q.where("textiness >= 0.9 and wordiness >= 0.9 and top_line_share <= 0.5").select("doc_id")


def detect_lang(spark, d):
    return sources(spark, d).select("doc_id", tx.first_script(F.col("body")).alias("script"))


def tokenize_fields(spark, d):
    t = sources(spark, d).select("doc_id", tx.fields(F.col("body")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


def unigrams(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(tx.unigrams(F.col("text")), "|").alias("units"))


def topic_key(spark, d):
    return read(spark, d, "benchmark").select("item_id", tx.topic_key(F.col("text")).alias("topic"))


def jaccard_pairs(spark, d):
    return lexicon.jaccard_pairs(read(spark, d, "benchmark"), "item_id", "text", least=0.05)


_JTOK = "list_distinct(list_concat(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> ''), flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> ''), lambda t: regexp_extract_all(t, '[一-鿿]|[^一-鿿]+')))))"


def has_any_token(spark, d):
    probe = F.array(*map(F.lit, ("license", "token", "http", "password")))
    return sources(spark, d).select("doc_id", F.exists(probe, lambda t: F.contains(F.lower("body"), t)).alias("hit"))


def _prefix_pairs(spark, d):
    """Each item beside the documents that hold its whole text: the gold pairs."""
    return lexicon.gold_pairs(items(spark, d), sources(spark, d))


_GOLD = f"{ITEMS}, gold AS (SELECT i.item_id, i.query, i.tokens, d.doc_id, d.text FROM items i JOIN documents d ON contains(d.text, i.query))"


def coverage(spark, d):
    q = items(spark, d).withColumn("turn", F.row_number().over(W.orderBy("item_id")))
    other = q.select((F.col("turn") - 1).alias("turn"), F.col("query").alias("window"))
    return q.join(other, "turn").select("item_id", F.round(tx.coverage(F.col("tokens"), F.col("window")), 6).alias("coverage"))


def keyword_score(spark, d):
    q = items(spark, d).withColumn("turn", F.row_number().over(W.orderBy("item_id")))
    other = q.select((F.col("turn") - 1).alias("turn"), F.col("query").alias("window"))
    return q.join(other, "turn").select("item_id", F.round(tx.keyword_score(F.col("tokens"), F.col("window")), 6).alias("score"))


_NEXT = f"{ITEMS}, n AS (SELECT item_id, tokens, lead(query) OVER (ORDER BY item_id) AS win FROM items)"


def confidence(spark, d):
    g = _prefix_pairs(spark, d)
    s, c = tx.keyword_score(F.col("tokens"), F.col("body")), tx.coverage(F.col("tokens"), F.col("body"))
    return g.select("item_id", "doc_id", tx.confidence(s, c).alias("confidence"))


def numeric_claim(spark, d):
    return sources(spark, d).select("doc_id", tx.numeric_claim(F.substring("body", 1, 200), F.col("body")).alias("claim"))


def vocab_mine(spark, d):
    return lexicon.whole_vocabulary(sources(spark, d), "doc_id", "body", sizes=(2, 3, 4), unit=r"[0-9A-Za-z]+", least_df=2, limit=200)


_VOCAB = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z]+') AS w FROM documents),
    g AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS term FROM w, (SELECT unnest([2, 3, 4]) AS n) s, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) p),
    t AS (SELECT term, n, count(DISTINCT doc_id) AS df, count(*) AS freq FROM g GROUP BY 1, 2),
    k AS (SELECT * FROM t WHERE df >= 2),
    longer AS (SELECT n - 1 AS n, regexp_replace(term, ' [^ ]+$', '') AS part, freq FROM k WHERE n > 2 UNION ALL SELECT n - 1, regexp_replace(term, '^[^ ]+ ', ''), freq FROM k WHERE n > 2),
    top AS (SELECT n, part, max(freq) AS most FROM longer GROUP BY 1, 2)"""


def vocab_nearest(spark, d):
    return lexicon.nearest_terms(read(spark, d, "benchmark"), "item_id", "text", k=3, least=0.3)


def top_vocab(spark, d):
    return lexicon.top_terms(sources(spark, d), "doc_id", "body", 100)


def densest_window(spark, d):
    return lexicon.densest_windows(_prefix_pairs(spark, d), "tokens", "body", 480).select("item_id", "doc_id", "start", "n_hits")


_DENSE = f"""{_GOLD}, pos AS (SELECT item_id, doc_id, text, list_distinct(tokens) AS toks, unnest(range(0, greatest(length(text) - 480, 0) + 1, 120)) AS start FROM gold),
    sc AS (SELECT item_id, doc_id, start, len(list_filter(toks, lambda t: contains(substr(text, (start + 1)::BIGINT, 480), t))) AS n_hits FROM pos)"""

_HASHVEC = f"""u AS (SELECT item_id, unnest({sql_unigrams('text')}) AS term FROM benchmark),
    b AS (SELECT item_id, term, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS bucket FROM u)"""

QUERIES = {
    "normalize_text": (normalize_text, "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(' ' || chr(13) || chr(10) || replace(text, 'e', 'e ' || chr(9) || chr(12288) || chr(8201) || ' '), chr(0), ''), '\\r\\n?', chr(10), 'g'), '[ \\t\\x0b\\x0c\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')) AS digest FROM documents"),
    "content_digest": (content_digest, "SELECT doc_id, sha256(text) AS digest, 'src:' || substr(sha256(text), 1, 16) AS source_id FROM documents"),
    "html_extract": (html_extract, f"SELECT page_id, length(b) AS n, sha256(b) AS digest FROM (SELECT page_id, {_HTML} AS b FROM pages)"),
    "textiness": (lambda s, d: quality(s, d).select("doc_id", "textiness"), f"SELECT doc_id, {_TEXTINESS} AS textiness FROM documents"),
    "wordiness": (lambda s, d: quality(s, d).select("doc_id", "wordiness"), f"SELECT doc_id, {_WORDINESS} AS wordiness FROM documents"),
    "top_line_share": (top_line_share, f"WITH {_TOP_LINES} SELECT doc_id, top_line_share FROM top"),
    "quality_gate": (quality_gate, f"WITH {_TOP_LINES} SELECT doc_id FROM documents JOIN top USING (doc_id) WHERE {_TEXTINESS} >= 0.9 AND {_WORDINESS} >= 0.9 AND top_line_share <= 0.5"),
    "detect_lang": (detect_lang, "SELECT doc_id, CASE WHEN regexp_matches(regexp_extract(text, '[一-鿿A-Za-z]'), '^[A-Za-z]$') THEN 'en' ELSE 'zh' END AS script FROM documents"),
    "tokenize_fields": (tokenize_fields, f"SELECT doc_id, len(t)::INT AS n_tokens, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql_fields('text')} AS t FROM documents)"),
    "unigrams": (unigrams, f"SELECT item_id, array_to_string({sql_unigrams('text')}, '|') AS units FROM benchmark"),
    "topic_key": (topic_key, f"SELECT item_id, substr(sha256(array_to_string({sql_unigrams('text')}, '|')), 1, 16) AS topic FROM benchmark"),
    "jaccard_pairs": (jaccard_pairs, f"""WITH t AS (SELECT item_id, {_JTOK} AS t FROM benchmark),
        p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) AS k, len(a.t) AS na, len(b.t) AS nb FROM t a JOIN t b ON a.item_id < b.item_id)
        SELECT a, b, round(k::DOUBLE / (na + nb - k), 6) AS jaccard FROM p WHERE k > 0 AND k::DOUBLE / (na + nb - k) >= 0.05"""),
    "has_any_token": (has_any_token, "SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'token') OR contains(lower(text), 'http') OR contains(lower(text), 'password') AS hit FROM documents"),
    "coverage": (coverage, f"WITH {_NEXT} SELECT item_id, round({sql_coverage('tokens', 'win')}, 6) AS coverage FROM n WHERE win IS NOT NULL"),
    "keyword_score": (keyword_score, f"WITH {_NEXT} SELECT item_id, round({sql_keyword_score('tokens', 'win')}, 6) AS score FROM n WHERE win IS NOT NULL"),
    "confidence": (confidence, f"WITH {_GOLD} SELECT item_id, doc_id, round(least(1.0, greatest(0.0, 0.5 * ({sql_keyword_score('tokens', 'text')}) / 10 + 0.5 * ({sql_coverage('tokens', 'text')}))), 3) AS confidence FROM gold"),
    "numeric_claim": (numeric_claim, "SELECT doc_id, CASE WHEN regexp_extract(substr(text, 1, 200), '[0-9]+') <> '' THEN regexp_extract(substr(text, 1, 200), '[0-9]+') ELSE regexp_extract(text, '[0-9]+') END AS claim FROM documents"),
    "vocab_mine": (vocab_mine, f"WITH {_VOCAB} SELECT k.term, k.df, k.freq FROM k LEFT JOIN top ON k.n = top.n AND k.term = top.part WHERE most IS NULL OR most < (8 * k.freq) // 10 ORDER BY df DESC, freq DESC, term LIMIT 200"),
    "vocab_nearest": (vocab_nearest, f"""WITH {_HASHVEC}, v AS (SELECT item_id, bucket, count(*)::DOUBLE AS x FROM b GROUP BY 1, 2), m AS (SELECT item_id, sqrt(sum(x * x)) AS len FROM v GROUP BY 1),
        terms AS (SELECT DISTINCT term, bucket FROM b), s AS (SELECT v.item_id, t.term, round(v.x / m.len, 6) AS cosine FROM v JOIN m USING (item_id) JOIN terms t USING (bucket)),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, term) AS rnk FROM s WHERE cosine > 0.3) SELECT item_id, term, cosine, rnk::INT AS rnk FROM r WHERE rnk <= 3"""),
    "top_vocab": (top_vocab, f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql_fields('text')}) AS term FROM documents) GROUP BY 1 ORDER BY df DESC, term LIMIT 100"),
    "densest_window": (densest_window, f"WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY n_hits DESC, start) AS k FROM sc) SELECT item_id, doc_id, start::INT AS start, n_hits::INT AS n_hits FROM r WHERE k = 1"),
}
