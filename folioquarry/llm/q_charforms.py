"""Queries of problem 3: texts that look the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.llm import charforms
from folioquarry.session import small
from folioquarry.sources.tables import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind, scope, text) of the segments of epub books, the text nodes and the terms."""
    epub = table(spark, folder, "book_documents", "id", "source_format").where("source_format = 'epub'").select(F.col("id").alias("document_id"))
    epub = small(epub)
    segments = table(spark, folder, "segments", "id", "document_id", "source_text").join(epub, "document_id", "left_semi")
    nodes = table(spark, folder, "text_nodes", "node_id", "document_id", "source_text")
    terms = table(spark, folder, "terms", "id", "project_id", "source")
    return (segments.select("id", F.lit("segment").alias("kind"), F.col("document_id").alias("scope"), F.col("source_text").alias("text"))
            .unionByName(nodes.select(F.col("node_id").alias("id"), F.lit("node").alias("kind"), F.col("document_id").alias("scope"), F.col("source_text").alias("text")))
            .unionByName(terms.select("id", F.lit("term").alias("kind"), F.col("project_id").alias("scope"), F.col("source").alias("text"))))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records that look the same but are not made of the same characters."""
    return charforms.look_alike_pairs(_records(spark, folder), "id", ["kind", "scope"], "text")


def p3_consistent_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the consistent form of its text."""
    return charforms.with_consistent_text(_records(spark, folder), "text").select("kind", "id", "consistent_text")


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that looks like one of other characters, with its class and its number of links."""
    return charforms.look_alike_classes(_records(spark, folder), "id", ["kind", "scope"], "text").select("id", "class_id", "members", "links")


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes, "p3_consistent_texts": p3_consistent_texts}
ORACLE: dict[str, str] = {}
