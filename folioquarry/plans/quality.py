"""Queries over terms and the quality of translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.functions import text as X
from folioquarry.operators import terms as T
from folioquarry.session import small
from folioquarry.sources.tables import table


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    books = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), "project_id"))
    return table(spark, folder, "segments", "id", "document_id", "ordinal", "status", "source_text", *X.LAYERS).join(books, "document_id")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return T.occurrences(_segments(spark, folder), table(spark, folder, "terms"))


def j13_term_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder).select("segment_id", "term_id", "start", "end")


def j14_longest_matches(spark: SparkSession, folder: str) -> DataFrame:
    return T.longest(_spans(spark, folder)).select("segment_id", "term_id", "start", "end")


def j15_competing_senses(spark: SparkSession, folder: str) -> DataFrame:
    return T.competing(_spans(spark, folder)).where("claims > 1").select("segment_id", "term_id", "start", "end", "claims")


def q1_term_classes(spark: SparkSession, folder: str) -> DataFrame:
    return T.classes(_spans(spark, folder)).groupBy("term_id", "class").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("segment_id").alias("segments"))


def u3_source_forms(spark: SparkSession, folder: str) -> DataFrame:
    return T.source_forms(table(spark, folder, "terms")).select("term_id", "project_id", "form")


def q7_term_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Translated segments in which an enforced term's target is missing or one of its forbidden targets is used."""
    enforced = T.classes(_spans(spark, folder)).where("class = 'enforced'").select("segment_id", "term_id").distinct()
    terms = table(spark, folder, "terms", F.col("id").alias("term_id"), F.col("target").alias("term_target"), "forbidden_targets")
    shown = _segments(spark, folder).select(F.col("id").alias("segment_id"), F.lower(X.visible()).alias("shown")).where(~X.blank(F.col("shown")))
    found = enforced.join(small(terms), "term_id").join(shown, "segment_id").select(
        "segment_id", "term_id", (~F.contains("shown", F.lower("term_target"))).alias("missing"), F.exists("forbidden_targets", lambda f: (f != "") & F.contains(F.col("shown"), F.lower(f))).alias("forbidden"))
    return found.where("missing OR forbidden")


def q3_empty_translations(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder).where((F.col("status") != "source") & ~X.blank(F.col("source_text")) & X.blank(X.visible())).select("id", "document_id", "ordinal")


def q4_untranslated(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of at least ten letters and four words whose translation has the same letters and figures."""
    s = _segments(spark, folder).select("id", "source_text", X.visible().alias("t"))
    prose = (F.length(F.regexp_replace("source_text", r"[^\p{L}]", "")) >= 10) & (F.size(F.regexp_extract_all("source_text", F.lit(r"[\p{L}]+"), F.lit(0))) >= 4)
    return s.where(prose & (X.comparable(F.col("source_text")) == X.comparable(F.col("t")))).select("id")


def q6_footnote_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    s = _segments(spark, folder).select("id", X.footnote_marks(F.coalesce("source_text", F.lit(""))).alias("of_source"), X.visible().alias("t")).where(~X.blank(F.col("t")))
    return s.select("id", "of_source", X.footnote_marks(F.col("t")).alias("of_target")).where("of_source <> of_target")


def a19_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    """Figures, addresses, marks and inline code that the translation has more or fewer of than the source, counted as multisets."""
    pattern = r"https?://[^\s]+|`[^`\n]+`|\[\^[^\]]+\]|[0-9]+(?:[.,][0-9]+)*"
    of = lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    s = _segments(spark, folder).select("id", F.coalesce("source_text", F.lit("")).alias("s"), X.visible().alias("t")).where(~X.blank(F.col("t")))
    both = s.select("id", F.explode(of(F.col("s"))).alias("token"), F.lit(1).alias("n")).unionByName(s.select("id", F.explode(of(F.col("t"))).alias("token"), F.lit(-1).alias("n")))
    net = both.groupBy("id", "token").agg(F.sum("n").alias("n"))
    return net.groupBy("id").agg(F.sum(F.greatest("n", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("extra")).where("missing > 0 OR extra > 0")


def n19_unclosed(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder).where(X.unclosed_delimiters(F.coalesce("source_text", F.lit("")))).select("id")


def a7_issue_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of every kind per segment, in one pass over their union."""
    found = None
    for code, q in (("empty", q3_empty_translations), ("untranslated", q4_untranslated), ("footnotes", q6_footnote_mismatch), ("figures", a19_placeholders)):
        own = q(spark, folder).select("id", F.lit(code).alias("code"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("issues"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def n28_truncated(spark: SparkSession, folder: str) -> DataFrame:
    s = _segments(spark, folder).where("source_text IS NOT NULL")
    return s.select("id", X.truncated(F.col("source_text"), 40).alias("head"), X.truncated(F.col("source_text"), 40, True).alias("tail"))


def j18_memory_exact(spark: SparkSession, folder: str) -> DataFrame:
    """For every text without visible translation the latest one of the same normalised source in its project."""
    s = _segments(spark, folder).select("id", "project_id", "document_id", "ordinal", "source_text", X.visible().alias("t"), F.md5(X.identity_form(F.coalesce("source_text", F.lit("")))).alias("key"))
    memory = s.where("t <> ''").groupBy("project_id", "key").agg(F.max_by("t", F.struct("document_id", "ordinal", "id")).alias("match"), F.count(F.lit(1)).alias("entries"))
    return s.where("t = '' AND source_text <> ''").join(memory, ["project_id", "key"]).select("id", "match", "entries")


QUERIES = {f.__name__: f for f in (j13_term_occurrences, j14_longest_matches, j15_competing_senses, q1_term_classes, u3_source_forms, q7_term_checks, q3_empty_translations, q4_untranslated, q6_footnote_mismatch, a19_placeholders, n19_unclosed,
                                   a7_issue_queue, n28_truncated, j18_memory_exact)}

_V = "coalesce(nullif(accepted_translation,''), nullif(reviewed_translation,''), nullif(edited_translation,''), nullif(machine_translation,''), '')"
_FULL = r"regexp_matches({}, '[^\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]')"  # more than white space
_SPANS = r"""
    forms AS (SELECT DISTINCT term_id, project_id, form, enforcement FROM (SELECT id AS term_id, project_id, enforcement, unnest(list_concat([lower(trim(source))], list_transform(aliases, lambda a: lower(trim(a))))) AS form FROM terms WHERE status = 'approved') WHERE form <> ''),
    hit AS (SELECT s.id, source_text, lower(source_text) AS low, f.* FROM segments s JOIN book_documents b ON b.id = s.document_id JOIN forms f ON f.project_id = b.project_id AND contains(lower(s.source_text), f.form)),
    gap AS (SELECT *, string_split(low, form) AS g FROM hit), places AS (SELECT *, unnest(range(1, len(g))) AS k FROM gap),
    at AS (SELECT id, source_text, term_id, form, enforcement, length(array_to_string(g[:k], '')) + (k - 1) * length(form) AS a FROM places),
    spans AS (SELECT DISTINCT id AS segment_id, term_id, CAST(a AS BIGINT) AS start_, CAST(a + length(form) AS BIGINT) AS end_, enforcement FROM at
              WHERE regexp_matches(form, '[㐀-鿿]') OR (NOT (a > 0 AND regexp_matches(substring(source_text, CAST(a AS BIGINT), 1), '^[\p{L}\p{N}_]$')) AND NOT regexp_matches(substring(source_text, CAST(a + length(form) + 1 AS BIGINT), 1), '^[\p{L}\p{N}_]$'))),
    longest AS (SELECT * FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y WHERE y.segment_id = x.segment_id AND (y.enforcement = 'reference') = (x.enforcement = 'reference') AND y.start_ <= x.start_ AND y.end_ >= x.end_ AND y.end_ - y.start_ > x.end_ - x.start_)),
    claimed AS (SELECT x.*, (SELECT count(DISTINCT y.term_id) FROM longest y WHERE y.segment_id = x.segment_id AND y.start_ = x.start_ AND y.end_ = x.end_ AND y.enforcement <> 'reference') AS claims FROM longest x),
    classed AS (SELECT *, CASE WHEN enforcement = 'reference' THEN 'reference' WHEN enforcement = 'contextual' OR claims > 1 THEN 'conditional' ELSE 'enforced' END AS class FROM claimed)"""
_SPANS = _SPANS.replace("    at AS (", "    spot AS (").replace("FROM at\n", "FROM spot\n")
_NOTES = r"array_to_string(list_sort(regexp_extract_all({}, '\[\^[^\]]+\]')), '|')"
_FIG = r"regexp_extract_all({}, 'https?://[^\s]+|`[^`\n]+`|\[\^[^\]]+\]|[0-9]+(?:[.,][0-9]+)*')"
_Q3 = f"SELECT id, document_id, ordinal FROM segments WHERE status <> 'source' AND {_FULL.format("source_text")} AND NOT {_FULL.format(_V)}"
_Q4 = rf"SELECT id FROM segments WHERE length(regexp_replace(source_text, '[^\p{{L}}]', '', 'g')) >= 10 AND len(regexp_extract_all(source_text, '[\p{{L}}]+')) >= 4 AND regexp_replace(lower(source_text), '[^\p{{L}}\p{{N}}]', '', 'g') = regexp_replace(lower({_V}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_Q6 = f"SELECT * FROM (SELECT id, {_NOTES.format("coalesce(source_text,'')")} AS of_source, {_NOTES.format(_V)} AS of_target FROM segments WHERE {_FULL.format(_V)}) WHERE of_source <> of_target"
_A19 = f"""SELECT id, CAST(sum(greatest(n, 0)) AS BIGINT) AS missing, CAST(sum(greatest(-n, 0)) AS BIGINT) AS extra FROM (SELECT id, token, sum(n) AS n FROM
        (SELECT id, unnest({_FIG.format("coalesce(source_text,'')")}) AS token, 1 AS n FROM segments WHERE {_FULL.format(_V)} UNION ALL SELECT id, unnest({_FIG.format(_V)}), -1 FROM segments WHERE {_FULL.format(_V)}) GROUP BY id, token) GROUP BY id HAVING sum(abs(n)) > 0"""
ORACLE = {
    "j13_term_occurrences": f'WITH {_SPANS} SELECT segment_id, term_id, start_ AS "start", end_ AS "end" FROM spans',
    "j14_longest_matches": f'WITH {_SPANS} SELECT segment_id, term_id, start_ AS "start", end_ AS "end" FROM longest',
    "j15_competing_senses": f"""WITH {_SPANS} SELECT x.segment_id, x.term_id, x.start_ AS "start", x.end_ AS "end", c.n AS claims FROM spans x JOIN (SELECT segment_id, start_, end_, count(DISTINCT term_id) FILTER (enforcement <> 'reference') AS n FROM spans GROUP BY ALL) c USING (segment_id, start_, end_) WHERE c.n > 1""",
    "q1_term_classes": f"WITH {_SPANS} SELECT term_id, class, count(*) AS places, count(DISTINCT segment_id) AS segments FROM classed GROUP BY ALL",
    "u3_source_forms": "SELECT DISTINCT term_id, project_id, form FROM (SELECT id AS term_id, project_id, unnest(list_concat([lower(trim(source))], list_transform(aliases, lambda a: lower(trim(a))))) AS form FROM terms) WHERE form <> ''",
    "q7_term_checks": f"""WITH {_SPANS} SELECT * FROM (SELECT DISTINCT c.segment_id, c.term_id, NOT contains(lower({_V}), lower(t.target)) AS missing, len(list_filter(t.forbidden_targets, lambda f: f <> '' AND contains(lower({_V}), lower(f)))) > 0 AS forbidden
        FROM classed c JOIN terms t ON t.id = c.term_id JOIN segments s ON s.id = c.segment_id WHERE class = 'enforced' AND {_FULL.format(_V)}) WHERE missing OR forbidden""",
    "q3_empty_translations": _Q3, "q4_untranslated": _Q4, "q6_footnote_mismatch": _Q6, "a19_placeholders": _A19,
    "n19_unclosed": "SELECT id FROM segments WHERE " + " OR ".join(f"length(replace(source_text, '{a}', '')) < length(replace(source_text, '{b}', ''))" for a, b in ("()", "[]", "{}", "«»", "“”")),
    "a7_issue_queue": f"SELECT id, count(*) AS issues, string_agg(code, ',' ORDER BY code) AS codes FROM (SELECT id, 'empty' AS code FROM ({_Q3}) UNION ALL SELECT id, 'untranslated' FROM ({_Q4}) UNION ALL SELECT id, 'footnotes' FROM ({_Q6}) UNION ALL SELECT id, 'figures' FROM ({_A19})) GROUP BY id",
    "n28_truncated": "SELECT id, CASE WHEN length(source_text) <= 40 THEN source_text ELSE left(source_text, 39) || '…' END AS head, CASE WHEN length(source_text) <= 40 THEN source_text ELSE '…' || right(source_text, 39) END AS tail FROM segments WHERE source_text IS NOT NULL",
    "j18_memory_exact": rf"""WITH s AS (SELECT s.id, project_id, document_id, ordinal, source_text, {_V} AS t, trim(regexp_replace(lower(coalesce(source_text,'')), '[ \t\r\n\x{{00A0}}\x{{3000}}]+', ' ', 'g')) AS k FROM segments s JOIN book_documents b ON b.id = s.document_id)
        SELECT s.id, m.match, m.entries FROM s JOIN (SELECT project_id, k, arg_max(t, (document_id, ordinal, id)) AS match, count(*) AS entries FROM s WHERE t <> '' GROUP BY ALL) m USING (project_id, k) WHERE t = '' AND source_text <> ''""",
}
