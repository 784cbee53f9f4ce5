"""Queries of the stages of term mining over all books; a scope is a source language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.functions import recall as R, text as X
from folioquarry.operators import candidates as C
from folioquarry.session import cut_lineage, small
from folioquarry.sources.tables import table

FEATURES = ("c_value", "f_frequency", "dispersion", "explicit", "boundary", "association", "multiword", "specificity", "context_diversity", "orthographic", "nominal", "derivational", "phrase_structure", "compactness")


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    books = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), F.col("source_lang").alias("scope")))
    rows = table(spark, folder, "segments", "id", "document_id", "ordinal", "kind", "heading_path", F.col("source_text").alias("text"), *X.LAYERS)
    last = small(rows.groupBy("document_id").agg(F.max("ordinal").alias("last")))
    at = F.least(F.lit(C.BINS - 1), F.floor(F.col("ordinal") * C.BINS / (F.col("last") + 1))).cast("int")
    return rows.join(books, "document_id").join(last, "document_id").select("id", "document_id", "ordinal", "heading_path", "scope", C.profile(F.col("scope")).alias("profile"), "text", at.alias("bin"), (F.col("kind") == "heading").alias("heading"), (X.visible() != "").alias("translated"))


def _lexemes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, recalled rows and lexemes, each written once."""
    segments = _segments(spark, folder)
    rows = cut_lineage(C.recalled(segments))
    return segments, rows, cut_lineage(C.families(rows))


def _scored(segments: DataFrame, rows: DataFrame, lexemes: DataFrame) -> DataFrame:
    totals = segments.groupBy("scope").agg(F.count(F.lit(1)).alias("segments_total"))
    few = cut_lineage(C.associated(C.possible(C.nested(lexemes)), lexemes))
    return cut_lineage(C.featured(C.described(few, rows), totals))


def m2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Lexemes and occurrences by language and sign of recall, Han characters included."""
    rows = C.recalled(_segments(spark, folder)).groupBy("scope", "key").agg(F.sum("c").alias("c"), F.bit_or("methods").alias("methods"))
    signs = F.explode(F.filter(F.array(*[F.when(C.has(m), m) for m in R.METHODS]), lambda m: m.isNotNull()))
    return rows.select("scope", "c", signs.alias("method")).groupBy("scope", "method").agg(F.count(F.lit(1)).alias("lexemes"), F.sum("c").alias("occurrences"))


def m5_families(spark: SparkSession, folder: str) -> DataFrame:
    """Lexemes of more than one key, by their common stems."""
    return _lexemes(spark, folder)[2].where("keys > 1").select("scope", "family", "key", "keys", "frequency", "segments")


def m8_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features, type and score of every lexeme that the gate can let through."""
    scored = _scored(*_lexemes(spark, folder))
    return scored.select("scope", "family", "key", "type", *[F.round(c, 6).alias(c) for c in FEATURES], F.round("score", 6).alias("score"))


def m9_gates(spark: SparkSession, folder: str) -> DataFrame:
    """How many lexemes of each language and lane pass the linguistic gate, the least score and the precision gate."""
    scored = _scored(*_lexemes(spark, folder)).withColumn("lane", C.lane())
    good = C.eligible() & (F.col("score") >= C.LEAST_SCORE)
    return scored.groupBy("scope", "lane").agg(F.count(F.lit(1)).alias("lexemes"), F.count_if(C.eligible()).alias("eligible"), F.count_if(good).alias("scored"), F.count_if(good & C.precise()).alias("qualified"))


def mined_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates of every language within its budget, ranked by their lanes."""
    segments, rows, lexemes = _lexemes(spark, folder)
    out = C.selected(_scored(segments, rows, lexemes), C.budgets(segments))
    methods = F.array_sort(F.filter(F.array(*[F.when(C.has(m), m) for m in R.METHODS]), lambda m: m.isNotNull()))
    return out.select("scope", "rank", "key", "form", "lane", "type", "frequency", "segments", F.round("score", 6).alias("score"), methods.alias("methods"), F.size("forms").alias("forms"))


def m16_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Quotations of every candidate, spread over its occurrences."""
    segments, rows, lexemes = _lexemes(spark, folder)
    chosen = C.selected(_scored(segments, rows, lexemes), C.budgets(segments))
    return C.evidence(chosen.select("scope", "family"), rows, segments)


def m16_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What was scanned and how many lexemes each stage left, by language."""
    segments, rows, lexemes = _lexemes(spark, folder)
    scored = _scored(segments, rows, lexemes)
    scanned = segments.groupBy("scope").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("characters"), F.count_if(C.is_boilerplate(F.col("heading_path"), F.col("text"))).alias("boilerplate"))
    raw = rows.groupBy("scope", "key").agg(F.lit(1)).groupBy("scope").agg(F.count(F.lit(1)).alias("raw_lexemes"))
    whole = lexemes.groupBy("scope").agg(F.count(F.lit(1)).alias("families"))
    passed = scored.groupBy("scope").agg(F.count_if(C.eligible()).alias("eligible"), F.count_if(C.eligible() & (F.col("score") >= C.LEAST_SCORE) & C.precise()).alias("qualified"))
    kept = C.selected(scored, C.budgets(segments)).groupBy("scope").agg(F.count(F.lit(1)).alias("retained"))
    out = scanned
    for part in (raw, whole, passed, kept, C.budgets(segments)):
        out = out.join(part, "scope", "left")
    return out


QUERIES = {f.__name__: f for f in (m2_recall, m5_families, m8_features, m9_gates, mined_candidates, m16_evidence, m16_coverage)}
ORACLE: dict[str, str] = {}
