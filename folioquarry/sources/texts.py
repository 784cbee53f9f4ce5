"""Plain text and Markdown files as ordered blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.operators.segments import scan_blocks


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, block_no, kind, text) of every .txt and .md file under ``path``; doc_id is the file's path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{txt,md}").select(F.col("_metadata.file_path").alias("path"), "value")
    return scan_blocks(files, "path", "value")


def write_markdown(blocks: DataFrame, path: str) -> None:
    """One Markdown text per document (doc_id, block_no, text), in order, written as a column of text files partitioned by document."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]), "\n\n")
    blocks.groupBy("doc_id").agg(joined.alias("value")).write.partitionBy("doc_id").mode("overwrite").text(path)
