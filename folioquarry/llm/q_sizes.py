"""Queries of problems 6 and 8: containers and pieces by tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.llm import packing, splitting
from folioquarry.sources.tables import table


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document or part of one."""
    return packing.pack_texts(table(spark, folder, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents larger than the limit, by whether they have an unbroken stretch beyond it."""
    pieces = splitting.split_texts(table(spark, folder, "documents", "doc_id", "text"), with_text=False)
    return pieces.where("piece_no = 0").select("doc_id", F.when(F.col("unbroken"), "unbroken").otherwise("divisible").alias("kind")).distinct()


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces with their texts."""
    return splitting.split_texts(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {"p6_containers": p6_containers, "p8_found": p8_found, "p8_pieces": p8_pieces}
ORACLE: dict[str, str] = {}
