"""Queries of term review, contexts, references and further checks of renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from folioquarry.functions import checks, context, normal, text as X
from folioquarry.functions.arrow import map_batches
from folioquarry.operators import review as V, terms as M
from folioquarry.plans import quality as Q
from folioquarry.session import cut_lineage, small, spread
from folioquarry.sources.tables import table

CONTEXT_CHARS, SAMPLE_CHARS = 1200, 600


def _classes(spark: SparkSession, folder: str) -> DataFrame:
    return M.classes(Q._spans(spark, folder))


def _shown(spark: SparkSession, folder: str) -> DataFrame:
    return Q._segments(spark, folder).select(F.col("id").alias("segment_id"), "project_id", "source_text", X.visible().alias("shown"))


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts as the outputs of models give them: a term's use is consistent if the output has its target. The key holds the output's text."""
    terms = table(spark, folder, "terms", F.col("id").alias("term_id"), "target")
    outputs = table(spark, folder, "candidates", "id", "segment_id", "candidate_text", "created_at").where("candidate_text <> ''").dropDuplicates(["id"])
    uses = cut_lineage(_classes(spark, folder).where("class = 'conditional'").select("segment_id", "term_id").distinct())
    status = F.when(F.contains(F.lower("candidate_text"), F.lower("target")), "consistent").otherwise("inconsistent")
    return outputs.join(uses, "segment_id").join(small(terms), "term_id").select("segment_id", "term_id", F.sha2("candidate_text", 256).alias("shown_hash"), status.alias("status"), "created_at", "id")


def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    items = V.items(_classes(spark, folder), _shown(spark, folder), table(spark, folder, "terms"))
    return V.snapshot(items, _verdicts(spark, folder), ["segment_id", "term_id", "shown_hash"])


def q8_pending_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Conditional terms of each segment by their source form, with how many senses there are."""
    terms = small(table(spark, folder, "terms", F.col("id").alias("term_id"), F.lower(F.trim("source")).alias("source_form")))
    uses = _classes(spark, folder).where("class = 'conditional'").select("segment_id", "term_id").distinct().join(terms, "term_id")
    return uses.groupBy("segment_id", "source_form").agg(F.count(F.lit(1)).alias("senses"))


def q12_review_items(spark: SparkSession, folder: str) -> DataFrame:
    return V.items(_classes(spark, folder), _shown(spark, folder), table(spark, folder, "terms")).drop("shown_hash")


def j12_review_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Every conditional use with the verdict that holds for its present text."""
    return _snapshot(spark, folder).select("segment_id", "term_id", "start", "end", "status")


def a5_review_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _snapshot(spark, folder).groupBy("term_id").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") != "pending").alias("checked"), F.count_distinct(F.when(F.col("status") == "pending", F.col("segment_id"))).alias("pending_segments"))


def q14_findings(spark: SparkSession, folder: str) -> DataFrame:
    return V.findings(_snapshot(spark, folder))


def u1_all_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of the checks and findings of the review, without those that are merely pending."""
    own = Q.a7_issue_queue(spark, folder).select(F.col("id").alias("segment_id"), F.explode(F.split("codes", ",")).alias("code"))
    return own.unionByName(q14_findings(spark, folder).where("code <> 'terminology_pending'").select("segment_id", "code"))


def q15_review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that nobody confirmed and that have issues, in order, with the gravest reason and a number of place in the queue of their book."""
    hard = {"empty", "untranslated", "footnotes"}
    issues = Q.a7_issue_queue(spark, folder).select("id", "issues", F.when(F.arrays_overlap(F.split("codes", ","), F.array(*map(F.lit, sorted(hard)))), "error").otherwise("warning").alias("reason"))
    open_ = Q._segments(spark, folder).where("status <> 'human_confirmed'").select("id", "document_id", "ordinal")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal", "id"))
    return issues.join(open_, "id").select("id", "document_id", "ordinal", "issues", "reason", place.cast("bigint").alias("place"))


def q11_fresh_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs whose text is still the translation of their segment (the SQL coalesce, in which an empty layer hides those below)."""
    outputs = table(spark, folder, "candidates", F.col("id").alias("candidate_id"), "segment_id", F.sha2("candidate_text", 256).alias("h")).dropDuplicates(["candidate_id"])
    now = Q._segments(spark, folder).select(F.col("id").alias("segment_id"), "document_id", F.sha2(X.visible_sql(), 256).alias("h"))
    return outputs.join(now, ["segment_id", "h"]).select("candidate_id", "segment_id", "document_id")


def a15_term_impact(spark: SparkSession, folder: str) -> DataFrame:
    """How many translated segments each approved term stands in, and in how many its target is missing."""
    terms = small(table(spark, folder, "terms", F.col("id").alias("term_id"), F.lower("target").alias("term_target")))
    uses = Q._spans(spark, folder).select("segment_id", "term_id").distinct()
    shown = _shown(spark, folder).where(~X.blank(F.col("shown"))).select("segment_id", F.lower("shown").alias("shown"))
    return uses.join(shown, "segment_id").join(terms, "term_id").groupBy("term_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if(~F.contains("shown", "term_target")).alias("missing"))


def n9_term_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence around every stored occurrence, by sentence marks and line breaks."""
    texts = table(spark, folder, "segments", F.col("id").alias("segment_id"), "source_text")
    o = table(spark, folder, "term_occurrences", "occurrence_id", "segment_id", "start_offset", "end_offset").join(texts, "segment_id")
    before, after = F.left("source_text", F.col("start_offset")), F.substring("source_text", F.col("end_offset") + 1, F.length("source_text"))
    whole = F.concat(F.regexp_extract(before, r"[^.!?。！？\n]*$", 0), F.substring("source_text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")), F.regexp_extract(after, r"^[^.!?。！？\n]*[.!?。！？\n]?", 0))
    return o.select("occurrence_id", F.regexp_replace(whole, r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("sentence"))


def n7_term_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Places of approved terms in compatible form and without case, so that full-width, decomposed and ligature spellings are found."""
    return M.occurrences(Q._segments(spark, folder), table(spark, folder, "terms"), compatible=True).select("segment_id", "term_id", "start", "end")


def n1_identity_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Content keys by compatible form, white space and case folding, numbered within a book."""
    s = table(spark, folder, "segments", "id", "document_id", "ordinal", "kind", "source_text")
    digest = X.content_hash(F.col("document_id"), F.col("kind"), normal.identity_form(F.coalesce("source_text", F.lit(""))))
    place = F.row_number().over(Window.partitionBy("document_id", "digest").orderBy("ordinal", "id")) - 1
    return s.select("id", "document_id", "ordinal", digest.alias("digest")).withColumn("repeat", place.cast("bigint")).select("id", X.content_hash(F.col("digest"), F.col("repeat").cast("string")).alias("key"), "repeat")


def n2_term_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of a project by their form without compatibility differences and case, with how many entries share it."""
    t = table(spark, folder, "terms", "id", "project_id", "source").withColumn("form", normal.term_form(F.col("source")))
    return t.groupBy("project_id", "form").agg(F.count(F.lit(1)).alias("entries"), F.min("id").alias("first_id"))


def n4_memory_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Translated segments by the form in which a memory looks them up; the latest is its entry."""
    s = Q._segments(spark, folder).where(X.visible() != "").withColumn("form", normal.memory_form(F.col("source_text"))).where("form <> ''")
    return s.groupBy("project_id", F.sha2("form", 256).alias("key")).agg(F.count(F.lit(1)).alias("entries"), F.max_by("id", F.struct("document_id", "ordinal", "id")).alias("entry_id"))


def n5_checked_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Footnote marks that differ between source and translation after dashes and compatible forms are made one."""
    s = _shown(spark, folder).where(~X.blank(F.col("shown"))).select("segment_id", normal.checked_form(F.col("source_text")).alias("s"), normal.checked_form(F.col("shown")).alias("t"))
    return s.select("segment_id", X.footnote_marks(F.coalesce("s", F.lit(""))).alias("of_source"), X.footnote_marks(F.col("t")).alias("of_target")).where("of_source <> of_target")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """(segment_id, untranslated, contamination, reference) of every segment in one pass."""
    books = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), "source_lang", "target_lang"))
    s = table(spark, folder, "segments", "id", "document_id", "source_text", *X.LAYERS).join(books, "document_id").select("id", "source_text", X.visible().alias("t"), "source_lang", "target_lang")

    def make():
        def work(*columns):
            for i, s_, t, sl, tl in zip(*columns):
                yield i, bool(t) and checks.is_untranslated(s_, t, sl, tl), checks.contamination(s_, t) if t else [], checks.reference_kind(s_)

        return work

    return map_batches(spread(s), make, "segment_id string, untranslated boolean, contamination array<string>, reference string")


def q4_copied_prose(spark: SparkSession, folder: str) -> DataFrame:
    """Prose that was copied instead of translated, by script; references and protected spans aside."""
    return _judged(spark, folder).where("untranslated").select("segment_id")


def q5_contamination(spark: SparkSession, folder: str) -> DataFrame:
    """Translations with a model's labels or with the source before them."""
    return _judged(spark, folder).select("segment_id", F.explode("contamination").alias("problem"))


def f14_reference_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Bibliographic entries by kind."""
    return _judged(spark, folder).where("reference IS NOT NULL").select("segment_id", "reference")


@F.pandas_udf(T.StringType())
def _context(ordinal, heading, near):
    import pandas as pd

    return pd.Series([context.neighbour_context(int(o), h, [(int(n["ordinal"]), n["source"] or "", n["shown"] or "") for n in ns], CONTEXT_CHARS, True) for o, h, ns in zip(ordinal, heading, near)])


def q16_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The passages around each segment (two on either side) within a budget of characters, shared fairly."""
    s = table(spark, folder, "segments", "id", "document_id", "ordinal", "heading_path", "source_text", *X.LAYERS).select("id", "document_id", "ordinal", "heading_path", "source_text", X.visible().alias("shown"))
    seen = s.select("document_id", F.struct(F.col("ordinal"), F.col("source_text").alias("source"), "shown").alias("n"), F.explode(F.sequence(F.col("ordinal") - 2, F.col("ordinal") + 2)).alias("ordinal"))
    near = seen.groupBy("document_id", "ordinal").agg(F.collect_list("n").alias("near"))  # at most five rows
    made = s.select("id", "document_id", "ordinal", "heading_path").join(near, ["document_id", "ordinal"]).withColumn("context", _context("ordinal", "heading_path", "near"))
    return made.select("id", F.length("context").cast("bigint").alias("chars"), F.sha2("context", 256).alias("digest"))


def w18_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Excerpts spread evenly over every document within a budget of characters."""
    def make():
        def work(ids, texts):
            for i, t in zip(ids, texts):
                joined, n = context.sample(t or "", SAMPLE_CHARS)
                yield i, joined, n, len(t or "")

        return work

    return map_batches(spread(table(spark, folder, "documents", "doc_id", "text")), make, "doc_id bigint, sample string, excerpts int, source_chars bigint")


def q2_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """One text of the terms that bind each segment: enforced ones first, then conditional ones, then references."""
    terms = small(table(spark, folder, "terms", F.col("id").alias("term_id"), "source", "target"))
    uses = _classes(spark, folder).select("segment_id", "term_id", "class").distinct().join(terms, "term_id")
    rank = F.when(F.col("class") == "enforced", 1).when(F.col("class") == "conditional", 2).otherwise(3)
    line = F.concat(F.lit("- "), "source", F.lit(" -> "), "target", F.lit(" ["), F.upper("class"), F.lit("]"))
    return uses.groupBy("segment_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "term_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("constraints"))


def q19_output_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens granted to the answer: twice the characters, at least 512, and more for harder kinds, at most 8,192."""
    extra = F.when(F.col("kind") == "table_cell", 0).when(F.col("kind") == "paragraph", 2048).otherwise(4096)
    return table(spark, folder, "segments", "id", "kind", "source_text").select("id", F.least(F.lit(8192), F.greatest(F.lit(512), 2 * F.length(F.coalesce("source_text", F.lit("")))) + extra).cast("bigint").alias("budget"))


QUERIES = {f.__name__: f for f in (q8_pending_terms, q12_review_items, j12_review_snapshot, a5_review_summary, q14_findings, u1_all_issues, q15_review_queue, q11_fresh_outputs, a15_term_impact, n9_term_sentences, n7_term_spans, n1_identity_keys,
                                   n2_term_forms, n4_memory_forms, n5_checked_notes, q4_copied_prose, q5_contamination, f14_reference_kinds, q16_contexts, w18_samples, q2_constraints, q19_output_budgets)}
_SPANS, _V = Q._SPANS, Q._V
_ITEMS = f"""WITH {_SPANS},
    rules AS (SELECT project_id, sha256(string_agg(concat_ws(chr(30), id, source, target, enforcement), chr(31) ORDER BY id)) AS rules FROM terms WHERE enforcement <> 'reference' GROUP BY project_id),
    items AS (SELECT DISTINCT c.segment_id, c.term_id, start_, end_, sha256({_V}) AS shown_hash, sha256(concat_ws(chr(31), '1', c.segment_id, c.term_id, CAST(start_ AS VARCHAR), CAST(end_ AS VARCHAR), sha256(source_text), sha256({_V}), coalesce(rules, ''))) AS item_id
              FROM classed c JOIN segments s ON s.id = c.segment_id JOIN book_documents b ON b.id = s.document_id LEFT JOIN rules r ON r.project_id = b.project_id WHERE class = 'conditional' AND {_V} <> ''),
    outputs AS (SELECT DISTINCT id, segment_id, candidate_text, created_at FROM candidates WHERE candidate_text <> ''),
    verdicts AS (SELECT o.segment_id, u.term_id, sha256(candidate_text) AS shown_hash, arg_max(CASE WHEN contains(lower(candidate_text), lower(target)) THEN 'consistent' ELSE 'inconsistent' END, (o.created_at, o.id)) AS verdict
                 FROM outputs o JOIN (SELECT DISTINCT segment_id, term_id FROM classed WHERE class = 'conditional') u ON u.segment_id = o.segment_id JOIN terms t ON t.id = u.term_id GROUP BY ALL),
    joined AS (SELECT i.*, verdict, count(verdict) OVER (PARTITION BY i.segment_id, start_, end_) AS n FROM items i LEFT JOIN verdicts v ON v.segment_id = i.segment_id AND v.term_id = i.term_id AND v.shown_hash = i.shown_hash),
    snap AS (SELECT *, CASE WHEN verdict IS NOT NULL AND n > 1 THEN 'uncertain' ELSE coalesce(verdict, 'pending') END AS status FROM joined)"""
_FINDINGS = "SELECT segment_id, 'terminology_' || status AS code, CASE WHEN status = 'pending' THEN 'info' ELSE 'warning' END AS severity, count(*) AS places FROM snap WHERE status <> 'consistent' GROUP BY ALL"
ORACLE = {
    "q8_pending_terms": f"WITH {_SPANS} SELECT segment_id, lower(trim(source)) AS source_form, count(DISTINCT c.term_id) AS senses FROM classed c JOIN terms t ON t.id = c.term_id WHERE class = 'conditional' GROUP BY ALL",
    "q12_review_items": f'{_ITEMS} SELECT item_id, segment_id, term_id, start_ AS "start", end_ AS "end" FROM items',
    "j12_review_snapshot": f'{_ITEMS} SELECT segment_id, term_id, start_ AS "start", end_ AS "end", status FROM snap',
    "a5_review_summary": f"{_ITEMS} SELECT term_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status <> 'pending') AS checked, count(DISTINCT segment_id) FILTER (status = 'pending') AS pending_segments FROM snap GROUP BY term_id",
    "q14_findings": f"{_ITEMS} {_FINDINGS}",
    "u1_all_issues": f"{_ITEMS} SELECT id AS segment_id, unnest(string_split(codes, ',')) AS code FROM ({Q.ORACLE['a7_issue_queue']}) UNION ALL SELECT segment_id, code FROM ({_FINDINGS}) WHERE code <> 'terminology_pending'",
    "q15_review_queue": f"""SELECT q.id, document_id, ordinal, issues, CASE WHEN regexp_matches(codes, 'empty|untranslated|footnotes') THEN 'error' ELSE 'warning' END AS reason, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, q.id) AS place
        FROM ({Q.ORACLE['a7_issue_queue']}) q JOIN segments s ON s.id = q.id WHERE status <> 'human_confirmed'""",
    "q11_fresh_outputs": "SELECT DISTINCT c.id AS candidate_id, c.segment_id, document_id FROM candidates c JOIN segments s ON s.id = c.segment_id WHERE candidate_text = coalesce(accepted_translation, reviewed_translation, edited_translation, machine_translation, '')",
    "a15_term_impact": f"""WITH {_SPANS} SELECT term_id, count(*) AS segments, count(*) FILTER (NOT contains(lower(shown), lower(target))) AS missing
        FROM (SELECT DISTINCT c.segment_id, c.term_id, {_V} AS shown FROM spans c JOIN segments s ON s.id = c.segment_id WHERE {Q._FULL.format(_V)}) x JOIN terms t ON t.id = x.term_id GROUP BY term_id""",
    "n9_term_sentences": r"""SELECT occurrence_id, regexp_replace(regexp_extract(left(source_text, start_offset), '[^.!?。！？\n]*$') || substring(source_text, start_offset + 1, end_offset - start_offset) || regexp_extract(substring(source_text, end_offset + 1), '^[^.!?。！？\n]*[.!?。！？\n]?'),
        '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS sentence FROM term_occurrences o JOIN segments s ON s.id = o.segment_id""",
    "q2_constraints": f"""WITH {_SPANS} SELECT segment_id, string_agg('- ' || source || ' -> ' || target || ' [' || upper(class) || ']', chr(10) ORDER BY CASE class WHEN 'enforced' THEN 1 WHEN 'conditional' THEN 2 ELSE 3 END, term_id) AS constraints
        FROM (SELECT DISTINCT segment_id, term_id, class FROM classed) c JOIN terms t ON t.id = c.term_id GROUP BY segment_id""",
    "q19_output_budgets": "SELECT id, CAST(least(8192, greatest(512, 2 * length(coalesce(source_text, ''))) + CASE kind WHEN 'table_cell' THEN 0 WHEN 'paragraph' THEN 2048 ELSE 4096 END) AS BIGINT) AS budget FROM segments",
}
