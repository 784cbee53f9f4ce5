"""Queries of problem 7: test passages in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioquarry.llm import leaks
from folioquarry.sources.tables import table


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "passage")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the test items that leaked into them."""
    return leaks.leaked_items(*_tables(spark, folder))


def p7_reparameterised(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the wording of test items about other names or figures, by class of items."""
    return leaks.reparameterised_items(*_tables(spark, folder))


def p7_item_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every test item: items that differ only by names and figures."""
    return leaks.item_classes(_tables(spark, folder)[1])


QUERIES = {"p7_found": p7_found, "p7_item_classes": p7_item_classes, "p7_reparameterised": p7_reparameterised}
ORACLE: dict[str, str] = {}
