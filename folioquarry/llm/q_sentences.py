"""Queries of problem 2: sentence units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.llm.sentences import split_sentences
from folioquarry.session import small
from folioquarry.sources.tables import table


def _texts(spark: SparkSession, folder: str, formats: tuple[str, ...] | None) -> DataFrame:
    """Segments (of books of the given formats) and the stored sentences of occurrences in them."""
    books = table(spark, folder, "book_documents", "id", "source_lang", "source_format").withColumnRenamed("id", "document_id")
    if formats:
        books = books.where(F.col("source_format").isin(*formats))
    segments = table(spark, folder, "segments", "id", "document_id", "kind", "source_text").join(small(books), "document_id")
    occurrences = table(spark, folder, "term_occurrences", "occurrence_id", "segment_id", "sentence")
    stored = occurrences.join(segments.select(F.col("id").alias("segment_id"), "kind", "source_lang"), "segment_id")
    return segments.select("id", F.col("source_text").alias("text"), "source_lang", "kind").unionByName(
        stored.select(F.col("occurrence_id").alias("id"), F.col("sentence").alias("text"), "source_lang", "kind"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence spans of the txt books and of the occurrences in them."""
    return split_sentences(_texts(spark, folder, ("txt",)), "id", "text", "source_lang", "kind").distinct()


def p2_all_books(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence spans of the segments and occurrences of every book."""
    return split_sentences(_texts(spark, folder, None), "id", "text", "source_lang", "kind")


QUERIES = {"p2_found": p2_found, "p2_all_books": p2_all_books}
ORACLE: dict[str, str] = {}
