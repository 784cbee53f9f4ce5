"""Whole-document queries: overview, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.sources.tables import table


def document_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Segments, translated and confirmed segments of each book."""
    s = table(spark, folder, "segments", "document_id", "status")
    return s.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if(F.col("status") != "source").alias("translated"),
        F.count_if(F.col("status") == "human_confirmed").alias("confirmed"),
    )


QUERIES = {"a6_document_overview": document_overview}
ORACLE = {
    "a6_document_overview": """
        SELECT document_id, count(*) AS segments, count(*) FILTER (status <> 'source') AS translated,
               count(*) FILTER (status = 'human_confirmed') AS confirmed
        FROM segments GROUP BY document_id""",
}
