"""Queries that look rows up in other tables, pick rows of groups, and test or rewrite single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioquarry.functions import text as X
from folioquarry.functions.glossary import BOILERPLATE
from folioquarry.operators.candidates import is_boilerplate
from folioquarry.session import small
from folioquarry.sources.tables import table

PICKS = 6


def _outputs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "candidates", "id", *columns).dropDuplicates(["id"])


def j7_repairs_of_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with their repair outputs."""
    segments = table(spark, folder, "segments", F.col("id").alias("segment_id"), "document_id", "ordinal")
    return _outputs(spark, folder, "segment_id", "stage").where("stage = 'repair'").join(segments, "segment_id").select(F.col("id").alias("candidate_id"), "segment_id", "document_id", "ordinal")


def j8_terms_in_use(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with whether it occurs anywhere, and the first of its occurrences."""
    seen = table(spark, folder, "term_occurrences", "term_id", "occurrence_id").groupBy("term_id").agg(F.min("occurrence_id").alias("first_occurrence"))
    return table(spark, folder, "terms", F.col("id").alias("term_id"), "status").join(seen, "term_id", "left").withColumn("in_use", F.col("first_occurrence").isNotNull())


def j9_occurrence_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences by segment, book and project, with their term where it still exists."""
    segments = table(spark, folder, "segments", F.col("id").alias("segment_id"), "document_id")
    books = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), "project_id"))
    terms = small(table(spark, folder, "terms", F.col("id").alias("term_id"), "source", "target"))
    return table(spark, folder, "term_occurrences", "occurrence_id", "segment_id", "term_id").join(segments, "segment_id").join(books, "document_id").join(terms, "term_id", "left").select("occurrence_id", "document_id", "project_id", "term_id", "source", "target")


def j10_compared_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments for which any output of a comparison exists."""
    compared = table(spark, folder, "candidates", "segment_id", "stage").where("stage = 'compare'").select(F.col("segment_id").alias("id"))
    return table(spark, folder, "segments", "id", "document_id", "ordinal").join(compared, "id", "left_semi")


def j28_known_references(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the blocks that a segment names are there, and how many aren't."""
    refs = table(spark, folder, "segments", "id", F.explode("source_refs").alias("block_id"))
    blocks = table(spark, folder, "pdf_blocks", "block_id").withColumn("known", F.lit(1))
    return refs.join(blocks, "block_id", "left").groupBy("id").agg(F.count("known").alias("known"), F.count_if(F.col("known").isNull()).alias("unknown"))


def a14_output_review(spark: SparkSession, folder: str) -> DataFrame:
    """Per segment: any model gave a text, all gave one, and how many gave none."""
    given = F.coalesce(F.length("candidate_text") > 0, F.lit(False))
    return _outputs(spark, folder, "segment_id", "candidate_text").groupBy("segment_id").agg(F.bool_or(given).alias("any_text"), F.bool_and(given).alias("all_texts"), F.count_if(~given).alias("without"))


def a4_remaining_time(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds that the open segments of a project will take at the pace of its outputs; null where nothing was measured."""
    books = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), "project_id"))
    s = table(spark, folder, "segments", F.col("id").alias("segment_id"), "document_id", "status").join(books, "document_id")
    left = s.groupBy("project_id").agg(F.count_if(F.col("status") == "source").alias("remaining"))
    done = _outputs(spark, folder, "segment_id", "created_at").join(s, "segment_id").groupBy("project_id").agg(F.count_distinct("segment_id").alias("measured"), (F.unix_seconds(F.max("created_at")) - F.unix_seconds(F.min("created_at"))).alias("elapsed"))
    return left.join(done, "project_id", "left").select("project_id", "remaining", "measured", F.floor(F.col("remaining") * F.col("elapsed") / F.nullif("measured", F.lit(0))).alias("seconds"))


def t7_commonest_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The form in which each term occurs most often; the first one seen among equals."""
    forms = table(spark, folder, "term_occurrences", "term_id", "matched_text", "occurrence_id").groupBy("term_id", "matched_text").agg(F.count(F.lit(1)).alias("n"), F.min("occurrence_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("term_id").orderBy(F.desc("n"), "first"))
    return forms.withColumn("place", place).where("place = 1").select("term_id", F.col("matched_text").alias("form"), "n")


def t8_last_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """The last three outputs of each segment, the latest first."""
    place = F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc("created_at"), F.desc("id")))
    return _outputs(spark, folder, "segment_id", "created_at").withColumn("place", place.cast("bigint")).where("place <= 3").select("segment_id", "place", F.col("id").alias("candidate_id"))


def w9_even_picks(spark: SparkSession, folder: str) -> DataFrame:
    """At most six occurrences of each term, evenly spaced over all of them."""
    w = Window.partitionBy("term_id")
    ranked = table(spark, folder, "term_occurrences", "term_id", "occurrence_id").select("term_id", "occurrence_id", (F.row_number().over(w.orderBy("occurrence_id")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(PICKS - 1)), lambda i: F.least(F.col("n") - 1, F.floor((i + 0.5) * F.col("n") / PICKS)))
    return ranked.where((F.col("n") <= PICKS) | F.array_contains(wanted, F.col("k").cast("bigint"))).select("term_id", "occurrence_id")


def w15_interleaved(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of a book with its kinds interleaved: by the place within the kind over the number of the kind, then by kind."""
    own = Window.partitionBy("document_id", "kind")
    s = table(spark, folder, "segments", "id", "document_id", "ordinal", "kind")
    placed = s.withColumn("key", F.round((F.row_number().over(own.orderBy("ordinal")) - 0.5) / F.count(F.lit(1)).over(own), 9))
    return placed.select("id", F.row_number().over(Window.partitionBy("document_id").orderBy("key", "kind", "ordinal")).cast("bigint").alias("place"))


def f6_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of imprint or contents."""
    return table(spark, folder, "segments", "id", "heading_path", F.col("source_text").alias("text")).where(is_boilerplate(F.col("heading_path"), F.col("text"))).select("id")


def n12_word_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Words, capitalised words, acronyms and Roman numerals of each book's language."""
    books = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), F.col("source_lang").alias("lang")))
    words = table(spark, folder, "segments", "document_id", F.explode(F.regexp_extract_all("source_text", F.lit(X.WORD), F.lit(0))).alias("w")).join(books, "document_id")
    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("w").rlike(r"^\p{Lu}")).alias("capitalised"), F.count_if(F.col("w").rlike("^(?:[A-ZÀ-ÖØ-Þ]\\.?){2,8}$")).alias("acronyms"), F.count_if(F.col("w").rlike("^[IVXLCDMivxlcdm]+$")).alias("roman"))


def n24_unfenced(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs without the fence that holds all of them."""
    return _outputs(spark, folder, "candidate_text").select("id", F.sha2(F.regexp_replace("candidate_text", r"(?s)\A[ \t\r\n]*```[\w-]*[ \t]*\n(.*?)\n?```[ \t\r\n]*\z", "$1"), 256).alias("digest"))


def n30_utf16_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of block texts in code points and in UTF-16 units, and where each begins in its page in such units."""
    b = table(spark, folder, "pdf_blocks", "block_id", "document_id", "page_no", "ordinal", "block_text")
    units = F.length("block_text") + F.length(F.regexp_replace("block_text", r"[^\x{10000}-\x{10FFFF}]", ""))
    order = Window.partitionBy("document_id", "page_no").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("units", units).select("block_id", F.length("block_text").cast("bigint").alias("points"), F.col("units").cast("bigint").alias("units"), F.coalesce(F.sum(F.col("units") + 1).over(order), F.lit(0)).cast("bigint").alias("start_unit"))


def n31_file_names(spark: SparkSession, folder: str) -> DataFrame:
    """A safe file name for the export of every book."""
    name = F.left(F.regexp_replace(F.regexp_replace("title", r"[\x00-\x1f<>:\"/\\|?*]+", "_"), r"^[ ._]+|[ ._]+$", ""), F.lit(120))
    return table(spark, folder, "book_documents", "id", "title").select("id", F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("document")), F.lit(".md")).alias("file_name"))


def n36_source_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of every segment's source, which blank lines divide."""
    parts = table(spark, folder, "segments", "id", F.posexplode(F.split("source_text", r"\n[ \t]*\n+")).alias("at", "block")).where("trim(block) <> ''")
    return parts.groupBy("id").agg(F.count(F.lit(1)).alias("blocks"), F.max(F.length("block")).cast("bigint").alias("longest"))


def k10_notes(spark: SparkSession, folder: str) -> DataFrame:
    """A line of Markdown for every stored occurrence: where it stands and what it says."""
    segments = table(spark, folder, "segments", F.col("id").alias("segment_id"), "ordinal")
    return table(spark, folder, "term_occurrences", "occurrence_id", "segment_id", "matched_text", "sentence").join(segments, "segment_id").select("occurrence_id", F.concat(F.lit("- **"), "matched_text", F.lit("** ("), F.col("ordinal") + 1, F.lit("): "), F.coalesce("sentence", F.lit(""))).alias("note"))


def unique_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of books that should be unique and aren't: (document_id, ordinal) and (document_id, stable_key)."""
    s = table(spark, folder, "segments", "document_id", "ordinal", "stable_key")
    both = s.select("document_id", F.lit("ordinal").alias("key"), F.col("ordinal").cast("string").alias("value")).unionByName(s.select("document_id", F.lit("stable_key").alias("key"), F.col("stable_key").alias("value")))
    return both.groupBy("document_id", "key", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


QUERIES = {f.__name__: f for f in (j7_repairs_of_segments, j8_terms_in_use, j9_occurrence_chain, j10_compared_segments, j28_known_references, a14_output_review, a4_remaining_time, t7_commonest_forms, t8_last_outputs, w9_even_picks, w15_interleaved,
                                   f6_boilerplate, n12_word_shapes, n24_unfenced, n30_utf16_lengths, n31_file_names, n36_source_blocks, k10_notes, unique_keys)}
_C = "(SELECT DISTINCT * FROM candidates)"
_W = X.WORD.replace("'", "''")
_META = BOILERPLATE.replace("'", "''")
ORACLE = {
    "j7_repairs_of_segments": f"SELECT c.id AS candidate_id, c.segment_id, document_id, ordinal FROM {_C} c JOIN segments s ON s.id = c.segment_id WHERE stage = 'repair'",
    "j8_terms_in_use": "SELECT t.id AS term_id, status, min(occurrence_id) AS first_occurrence, count(occurrence_id) > 0 AS in_use FROM terms t LEFT JOIN term_occurrences o ON o.term_id = t.id GROUP BY t.id, status",
    "j9_occurrence_chain": "SELECT occurrence_id, document_id, project_id, o.term_id, t.source, t.target FROM term_occurrences o JOIN segments s ON s.id = o.segment_id JOIN (SELECT id, project_id FROM book_documents) b ON b.id = s.document_id LEFT JOIN (SELECT id, source, target FROM terms) t ON t.id = o.term_id",
    "j10_compared_segments": "SELECT id, document_id, ordinal FROM segments s WHERE EXISTS (SELECT 1 FROM candidates c WHERE c.segment_id = s.id AND stage = 'compare')",
    "j28_known_references": "SELECT id, count(b.block_id) AS known, count(*) FILTER (b.block_id IS NULL) AS unknown FROM (SELECT id, unnest(source_refs) AS ref FROM segments) s LEFT JOIN pdf_blocks b ON b.block_id = s.ref GROUP BY id",
    "a14_output_review": f"SELECT segment_id, bool_or(coalesce(length(candidate_text) > 0, false)) AS any_text, bool_and(coalesce(length(candidate_text) > 0, false)) AS all_texts, count(*) FILTER (NOT coalesce(length(candidate_text) > 0, false)) AS without FROM {_C} GROUP BY segment_id",
    "a4_remaining_time": f"""WITH s AS (SELECT s.id, project_id, status FROM segments s JOIN book_documents b ON b.id = s.document_id), l AS (SELECT project_id, count(*) FILTER (status = 'source') AS remaining FROM s GROUP BY 1),
        d AS (SELECT project_id, count(DISTINCT segment_id) AS measured, CAST(floor(epoch(max(created_at))) - floor(epoch(min(created_at))) AS BIGINT) AS elapsed FROM {_C} c JOIN s ON s.id = c.segment_id GROUP BY 1)
        SELECT project_id, remaining, measured, CAST(floor(remaining * elapsed / nullif(measured, 0)) AS BIGINT) AS seconds FROM l LEFT JOIN d USING (project_id)""",
    "t7_commonest_forms": "SELECT term_id, matched_text AS form, n FROM (SELECT term_id, matched_text, count(*) AS n, row_number() OVER (PARTITION BY term_id ORDER BY count(*) DESC, min(occurrence_id)) AS k FROM term_occurrences GROUP BY term_id, matched_text) WHERE k = 1",
    "t8_last_outputs": f"SELECT segment_id, place, id AS candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY created_at DESC, id DESC) AS place FROM {_C}) WHERE place <= 3",
    "w9_even_picks": """WITH r AS (SELECT term_id, occurrence_id, row_number() OVER (PARTITION BY term_id ORDER BY occurrence_id) - 1 AS k, count(*) OVER (PARTITION BY term_id) AS n FROM term_occurrences)
        SELECT term_id, occurrence_id FROM r WHERE n <= 6 OR list_contains(list_transform(range(6), lambda i: least(n - 1, CAST(floor((i + 0.5) * n / 6) AS BIGINT))), k)""",
    "w15_interleaved": """WITH p AS (SELECT id, document_id, ordinal, kind, round((row_number() OVER (PARTITION BY document_id, kind ORDER BY ordinal) - 0.5) / count(*) OVER (PARTITION BY document_id, kind), 9) AS key FROM segments)
        SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY key, kind, ordinal) AS place FROM p""",
    "f6_boilerplate": f"""WITH h AS (SELECT id, source_text, len(regexp_extract_all(coalesce(heading_path, '') || chr(10) || source_text, '(?i){_META}')) AS hits FROM segments) SELECT id FROM h WHERE hits >= 2 OR (hits = 1 AND length(source_text) < 240)""",
    "n12_word_shapes": rf"""WITH w AS (SELECT source_lang AS lang, unnest(regexp_extract_all(source_text, '{_W}')) AS w FROM segments s JOIN book_documents b ON b.id = s.document_id)
        SELECT lang, count(*) AS words, count(*) FILTER (regexp_matches(w, '^\p{{Lu}}')) AS capitalised, count(*) FILTER (regexp_matches(w, '^(?:[A-ZÀ-ÖØ-Þ]\.?){{2,8}}$')) AS acronyms, count(*) FILTER (regexp_matches(w, '^[IVXLCDMivxlcdm]+$')) AS roman FROM w GROUP BY lang""",
    "n24_unfenced": rf"SELECT id, sha256(regexp_replace(candidate_text, '(?s)\A[ \t\r\n]*```[\w-]*[ \t]*\n(.*?)\n?```[ \t\r\n]*\z', '\1')) AS digest FROM {_C}",
    "n30_utf16_lengths": r"""WITH b AS (SELECT *, length(block_text) + length(regexp_replace(block_text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS u FROM pdf_blocks)
        SELECT block_id, CAST(length(block_text) AS BIGINT) AS points, CAST(u AS BIGINT) AS units, CAST(coalesce(sum(u + 1) OVER (PARTITION BY document_id, page_no ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_unit FROM b""",
    "n31_file_names": r"""SELECT id, coalesce(nullif(left(regexp_replace(regexp_replace(title, '[\x00-\x1f<>:"/\\|?*]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), 120), ''), 'document') || '.md' AS file_name FROM book_documents""",
    "n36_source_blocks": r"SELECT id, count(*) AS blocks, CAST(max(length(block)) AS BIGINT) AS longest FROM (SELECT id, unnest(string_split_regex(source_text, '\n[ \t]*\n+')) AS block FROM segments) WHERE trim(block) <> '' GROUP BY id",
    "k10_notes": "SELECT occurrence_id, '- **' || matched_text || '** (' || (ordinal + 1) || '): ' || coalesce(sentence, '') AS note FROM term_occurrences o JOIN segments s ON s.id = o.segment_id",
    "unique_keys": "SELECT document_id, 'ordinal' AS key, CAST(ordinal AS VARCHAR) AS value, count(*) AS n FROM segments GROUP BY 1, 3 HAVING count(*) > 1 UNION ALL SELECT document_id, 'stable_key', stable_key, count(*) FROM segments GROUP BY 1, 3 HAVING count(*) > 1",
}
