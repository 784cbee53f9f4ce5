"""Queries of problem 4: defective answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.llm import defects
from folioquarry.session import small
from folioquarry.sources.tables import table


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    books = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), "source_format", "source_lang", "target_lang"))
    segments = table(spark, folder, "segments", "id", "document_id", "kind", "source_text", "machine_translation", "status").where("status <> 'source'")
    several_lines = (F.col("source_format") == "md") & F.btrim("source_text", F.lit(" \t\r\n")).contains("\n")
    return segments.join(books, "document_id").where(~F.coalesce(several_lines, F.lit(False)))


def _defects(spark: SparkSession, folder: str) -> DataFrame:
    return defects.pair_defects(_pairs(spark, folder), "id", "source_text", "machine_translation", "kind", "source_lang", "target_lang")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with a defective machine translation and its defect."""
    return _defects(spark, folder).select(F.col("record").alias("segment_id"), "defect").distinct()


def p4_all_defects(spark: SparkSession, folder: str) -> DataFrame:
    """The same segments with every defect that was triggered."""
    return _defects(spark, folder).select(F.col("record").alias("segment_id"), F.explode("defects").alias("defect")).distinct()


QUERIES = {"p4_found": p4_found, "p4_all_defects": p4_all_defects}
ORACLE: dict[str, str] = {}
