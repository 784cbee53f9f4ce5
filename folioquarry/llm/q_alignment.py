"""Queries of problem 5: lines that translate each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.llm import alignment
from folioquarry.session import small
from folioquarry.sources.tables import table


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, format, sl, tl, s, t): segments with the translation in use."""
    books = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), F.col("source_format").alias("format"), F.col("source_lang").alias("sl"), F.col("target_lang").alias("tl")))
    t = F.coalesce(F.nullif("accepted_translation", F.lit("")), F.col("machine_translation"))
    return table(spark, folder, "segments", "id", "document_id", F.col("source_text").alias("s"), t.alias("t")).where("t <> '' AND s <> ''").join(books, "document_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of lines of the md books that translate each other."""
    pairs = _pairs(spark, folder)
    models = alignment.trained_models(pairs)
    several = pairs.where(F.col("format") == "md").where(F.btrim("s", F.lit(" \t\r\n")).contains("\n"))
    return alignment.aligned_lines(several, models).select(F.col("record_id").alias("segment_id"), "source_no", "target_no").distinct()


QUERIES = {"p5_found": p5_found}
ORACLE: dict[str, str] = {}
