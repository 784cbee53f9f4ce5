"""Queries of problem 1: noise of scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.llm import scans
from folioquarry.session import small
from folioquarry.sources.tables import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Segments and blocks of the pdf books; a segment has the sheet of its first block, and its chapter where its own is missing."""
    books = small(table(spark, folder, "book_documents", "id", "title", "source_lang", "source_format").where("source_format = 'pdf'").select(F.col("id").alias("document_id"), "title", F.col("source_lang").alias("lang")))
    blocks = table(spark, folder, "pdf_blocks", "block_id", "document_id", "ordinal", "kind", "page_no", F.col("heading_path").alias("chapter"), F.col("block_text").alias("text"))
    places = blocks.select(F.col("block_id").alias("ref"), "page_no", F.col("chapter").alias("block_chapter"))
    segments = table(spark, folder, "segments", F.col("id").alias("record_id"), "document_id", "ordinal", "kind", F.col("heading_path").alias("own_chapter"), F.col("source_text").alias("text"), F.try_element_at("source_refs", F.lit(1)).alias("ref"))
    segments = segments.join(books, "document_id").join(places, "ref", "left").withColumn("chapter", F.coalesce(F.col("block_chapter"), F.col("own_chapter")))
    blocks = blocks.withColumnRenamed("block_id", "record_id").join(books, "document_id")
    columns = ["record_id", "document_id", "source", "ordinal", "kind", "page_no", "chapter", "text", "title", "lang"]
    return segments.withColumn("source", F.lit("segment")).select(*columns).unionByName(blocks.withColumn("source", F.lit("block")).select(*columns))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with each kind of noise in them."""
    return scans.found_noise(_records(spark, folder)).select("record_id", "noise").distinct()


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous paragraphs of all pdf books."""
    return scans.paragraphs(_records(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs}
ORACLE: dict[str, str] = {}
