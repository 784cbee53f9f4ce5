"""Queries of term mining; ``term_candidates`` is the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioquarry.functions.lexicon import ROMAN, STOP_WORDS
from folioquarry.functions.text import WORD
from folioquarry.operators import mining as M
from folioquarry.session import cut_lineage, small
from folioquarry.sources.tables import table

LANGS = ("en", "fr", "de", "es", "it", "pt", "hi", "th")  # those whose words are set apart by spaces or marks; Han characters have m3


def _segments(spark: SparkSession, folder: str, *langs: str) -> DataFrame:
    books = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), F.col("source_lang").alias("lang")).where(F.col("lang").isin(*langs or LANGS)))
    return table(spark, folder, "segments", "id", "document_id", "ordinal", F.col("source_text").alias("text")).join(books, "document_id")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return M.chunks(M.with_bins(_segments(spark, folder)))


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return M.statistics(M.ngrams(_chunks(spark, folder)))


def m2_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return _stats(spark, folder).select("lang", "key", "n", "frequency", "segments", "books", "bins", "contexts")


def m3_han_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return M.han_ngrams(_segments(spark, folder, "zh", "ja"))


def m6_c_value(spark: SparkSession, folder: str) -> DataFrame:
    return M.c_values(_stats(spark, folder)).select("lang", "key", F.round("c_value", 6).alias("c_value"))


def m7_association(spark: SparkSession, folder: str) -> DataFrame:
    chunked = _chunks(spark, folder)
    return M.associations(M.statistics(M.ngrams(chunked)), M.word_uses(chunked)).select("lang", "key", F.round("association", 6).alias("association"))


def a10_budget(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates a corpus of its size deserves: 20 and 0.45 for each root of its units, from 25 to 70."""
    return _budget(_chunks(spark, folder))


def _budget(chunked: DataFrame) -> DataFrame:
    units = chunked.groupBy("lang").agg(F.sum(F.size("tokens")).alias("units"))
    return units.select("lang", "units", F.least(F.lit(70), F.greatest(F.lit(25), F.bround(20 + 0.45 * F.sqrt("units")).cast("bigint"))).alias("budget"))


def a16_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language whose function words a document holds most of, with at least two of them; the first by name among equals."""
    words = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    lexicon = F.broadcast(spark.createDataFrame([(k, w) for k, ws in STOP_WORDS.items() for w in ws], "lang string, word string"))  # a fixed list
    hits = words.groupBy("doc_id", "word").count().join(lexicon, "word").groupBy("doc_id", "lang").agg(F.sum("count").alias("hits"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "lang"))
    return hits.where("hits >= 2").withColumn("n", first).where("n = 1").select("doc_id", "lang", "hits")


def term_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The best candidates of each language: n-grams by score, without those that only occur inside a longer one."""
    chunked = _chunks(spark, folder)
    counted = cut_lineage(M.statistics(M.ngrams(chunked)))  # read four times below
    stats = M.associations(M.c_values(counted), M.word_uses(chunked))
    gated = M.without_nested(M.scored(stats)).where("(n = 1 AND frequency >= 3 AND length(key) >= 4) OR (n BETWEEN 2 AND 3 AND association >= 0.04 AND segments >= 2)")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("frequency"), "key"))
    budget = small(_budget(chunked).select("lang", "budget"))
    return gated.withColumn("place", place).join(budget, "lang").where(F.col("place") <= F.col("budget")).select("lang", "place", "key", "n", "frequency", "segments", F.round("score", 4).alias("score"))


QUERIES = {f.__name__: f for f in (m2_ngrams, m3_han_ngrams, m6_c_value, m7_association, a10_budget, a16_language, term_candidates)}

_LIST = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_STOP = " OR ".join(f"(lang = '{k}' AND t IN {_LIST(STOP_WORDS[k])})" for k in LANGS if k in STOP_WORDS)
_W = WORD.replace("'", "''")
_CHUNK = M.CHUNK.replace("'", "''")
_STATS = rf"""
    s AS (SELECT s.id, document_id, source_lang AS lang, source_text AS text, least(7, CAST(floor(ordinal * 8 / (max(ordinal) OVER (PARTITION BY document_id) + 1)) AS INT)) AS bin FROM segments s JOIN book_documents b ON b.id = s.document_id WHERE source_lang IN {_LIST(LANGS)}),
    p AS (SELECT *, unnest(string_split_regex(lower(text), '{_CHUNK}')) AS piece FROM s WHERE text <> ''),
    c AS (SELECT id, document_id, lang, bin, row_number() OVER () AS chunk_id, regexp_extract_all(piece, '{_W}') AS tokens FROM p WHERE len(regexp_extract_all(piece, '{_W}')) > 0),
    w AS (SELECT DISTINCT lang, t FROM (SELECT lang, unnest(tokens) AS t FROM c)),
    content AS (SELECT lang, t FROM w WHERE length(t) >= 2 AND NOT ({_STOP}) AND NOT regexp_full_match(t, '[0-9]+') AND NOT regexp_matches(t, '{ROMAN}')),
    sets AS (SELECT lang, list(t) AS ok FROM content GROUP BY lang),
    tok AS (SELECT chunk_id, c.lang, u.pos, u.t, (k.t IS NOT NULL) AS good FROM (SELECT chunk_id, lang, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos FROM c) u JOIN c USING (chunk_id) LEFT JOIN content k ON k.lang = c.lang AND k.t = u.t),
    f AS (SELECT chunk_id, list(good ORDER BY pos) AS flags FROM tok GROUP BY chunk_id),
    g AS (SELECT c.*, flags, unnest(range(1, least(5, len(tokens)) + 1)) AS n FROM c JOIN f USING (chunk_id)),
    h AS (SELECT *, unnest(range(1, len(tokens) - n + 2)) AS i FROM g),
    grams AS (SELECT id, document_id, lang, bin, array_to_string(tokens[i:i+n-1], ' ') AS key, n, coalesce(CASE WHEN i > 1 THEN tokens[i-1] END, '') || '|' || coalesce(CASE WHEN i + n <= len(tokens) THEN tokens[i+n] END, '') AS context
              FROM h WHERE flags[i] AND flags[i+n-1] AND len(list_filter(flags[i:i+n-1], lambda x: NOT x)) <= greatest(1, (n-1)//2)),
    stats AS (SELECT lang, key, CAST(n AS INT) AS n, count(*) AS frequency, count(DISTINCT id) AS segments, count(DISTINCT document_id) AS books, count(DISTINCT bin) AS bins, count(DISTINCT context) AS contexts FROM grams GROUP BY lang, key, n HAVING count(*) >= 2),
    split_ AS (SELECT lang, key, n, frequency, string_split(key, ' ') AS ws FROM stats WHERE n > 1),
    sub AS (SELECT lang, frequency, array_to_string(ws[i:i+m-1], ' ') AS key FROM (SELECT *, unnest(range(1, n - m + 2)) AS i FROM (SELECT *, unnest(range(1, n)) AS m FROM split_))),
    around AS (SELECT lang, key, avg(frequency) AS around FROM sub GROUP BY lang, key),
    cv AS (SELECT stats.*, greatest(0.0, log2(greatest(2, n + 1)) * (frequency - coalesce(around, 0))) AS c_value FROM stats LEFT JOIN around USING (lang, key)),
    uses AS (SELECT lang, t AS word, count(*) AS uses FROM (SELECT lang, unnest(tokens) AS t FROM c) GROUP BY lang, t),
    mean AS (SELECT lang, key, exp(avg(ln(uses))) AS mean FROM (SELECT lang, key, unnest(ws) AS word FROM split_) JOIN uses USING (lang, word) GROUP BY lang, key),
    a AS (SELECT cv.*, CASE WHEN n = 1 THEN 0.35 ELSE least(1.0, frequency / mean) END AS association FROM cv LEFT JOIN mean USING (lang, key))"""
_BUDGET = "SELECT lang, CAST(sum(len(tokens)) AS BIGINT) AS units, least(70, greatest(25, CAST(round_even(20 + 0.45 * sqrt(sum(len(tokens))), 0) AS BIGINT))) AS budget FROM c GROUP BY lang"
ORACLE = {
    "m2_ngrams": f"WITH {_STATS} SELECT * FROM stats",
    "m3_han_ngrams": """WITH r AS (SELECT s.id, unnest(regexp_extract_all(source_text, '[㐀-䶿一-鿿豈-﫿]+')) AS run FROM segments s JOIN book_documents b ON b.id = s.document_id WHERE source_lang IN ('zh', 'ja') AND regexp_matches(source_text, '[㐀-䶿一-鿿豈-﫿]{2}')),
        g AS (SELECT id, substring(run, i, n) AS key, n FROM (SELECT *, unnest(range(1, length(run) - n + 2)) AS i FROM (SELECT *, unnest(range(2, least(6, length(run)) + 1)) AS n FROM r WHERE length(run) >= 2)))
        SELECT key, CAST(n AS INT) AS n, count(*) AS frequency, count(DISTINCT id) AS segments FROM g GROUP BY key, n HAVING count(*) >= 3""",
    "m6_c_value": f"WITH {_STATS} SELECT lang, key, round(c_value, 6) AS c_value FROM cv",
    "m7_association": f"WITH {_STATS} SELECT lang, key, round(association, 6) AS association FROM a",
    "a10_budget": f"WITH {_STATS} {_BUDGET}",
    "a16_language": rf"""WITH l AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{w.replace(chr(39), chr(39) * 2)}')" for k, ws in STOP_WORDS.items() for w in ws)}) AS t(lang, word)), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS word FROM documents),
        h AS (SELECT doc_id, lang, count(*) AS hits FROM w JOIN (SELECT DISTINCT * FROM l) USING (word) GROUP BY ALL HAVING count(*) >= 2) SELECT doc_id, lang, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, lang) AS n FROM h) WHERE n = 1""",
    "term_candidates": f"""WITH {_STATS},
        q AS (SELECT *, round(0.25 * greatest(log2(c_value + 1) / log2(max(c_value) OVER (PARTITION BY lang) + 1), log2(frequency + 1) / log2(max(frequency) OVER (PARTITION BY lang) + 1) * CASE WHEN n = 1 THEN 0.75 ELSE 0.35 END)
                  + 0.22 * log2(frequency + 1) / log2(max(frequency) OVER (PARTITION BY lang) + 1) + 0.17 * (0.65 * bins / 8 + 0.35 * log2(least(32, segments) + 1) / log2(33.0)) + 0.13 * association
                  + 0.12 * least(1.0, greatest(0.0, (length(key) / n - 3) / 9)) + 0.06 * least(1.0, contexts / least(16, greatest(2, 2 * frequency))) + 0.05 * CASE WHEN n > 1 THEN 1 ELSE 0 END, 6) AS score FROM a),
        gated AS (SELECT q.* FROM q WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = q.lang AND sub.key = q.key AND sub.frequency = q.frequency) AND ((n = 1 AND frequency >= 3 AND length(key) >= 4) OR (n BETWEEN 2 AND 3 AND association >= 0.04 AND segments >= 2))),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, frequency DESC, key) AS place FROM gated)
        SELECT lang, place, key, n, frequency, segments, round(score, 4) AS score FROM r JOIN ({_BUDGET}) USING (lang) WHERE place <= budget""",
}
