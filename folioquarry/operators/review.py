"""Review of term uses: items by what they depend on, verdicts that still hold, contradictions, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folioquarry.functions.text import content_hash

VERSION = "1"


def rules(terms: DataFrame) -> DataFrame:
    """(project_id, rules): one digest of all terms of a project that bind; any change of one changes it."""
    row = F.struct("id", F.concat_ws("\x1e", "id", "source", "target", "enforcement").alias("rule"))
    return terms.where("enforcement <> 'reference'").groupBy("project_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["rule"]), "\x1f"), 256).alias("rules"))


def items(classes: DataFrame, segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_id, segment_id, term_id, start, end, shown_hash): conditional term uses in translated segments.

    The id is a digest of all that a verdict depends on: the place, the source, the visible translation, and the project's rules.
    ``segments``: segment_id, project_id, source_text, shown.
    """
    uses = classes.where("class = 'conditional'").select("segment_id", "term_id", "start", "end").distinct()
    known = segments.where("shown <> ''").join(F.broadcast(rules(terms)), "project_id", "left")  # a row for each project
    digest = content_hash(F.lit(VERSION), F.col("segment_id"), F.col("term_id"), F.col("start").cast("string"), F.col("end").cast("string"), F.sha2("source_text", 256), F.sha2("shown", 256), F.coalesce("rules", F.lit("")))
    return uses.join(known, "segment_id").select(digest.alias("item_id"), "segment_id", "term_id", "start", "end", F.sha2("shown", 256).alias("shown_hash"))


def snapshot(items_: DataFrame, verdicts: DataFrame, on: list[str]) -> DataFrame:
    """``items_`` with ``status``: the latest verdict of the same key, 'pending' without one, 'uncertain' where several terms apply to one place.

    ``verdicts``: the key columns ``on``, status, created_at, id. A verdict on an older text has another key and is ignored.
    """
    latest = verdicts.groupBy(*on).agg(F.max_by("status", F.struct("created_at", "id")).alias("verdict"))
    joined = items_.join(latest, on, "left")
    applies = F.count(F.when(F.col("verdict").isin("consistent", "inconsistent"), 1)).over(Window.partitionBy("segment_id", "start", "end"))
    torn = F.col("verdict").isin("consistent", "inconsistent") & (applies > 1)
    return joined.withColumn("status", F.when(torn, "uncertain").otherwise(F.coalesce("verdict", F.lit("pending")))).drop("verdict")


def findings(snapshot_: DataFrame) -> DataFrame:
    """(segment_id, code, severity, places): what is to be shown for a segment; uses without a verdict are one information."""
    told = snapshot_.where("status IN ('inconsistent', 'uncertain', 'pending')")
    code = F.concat(F.lit("terminology_"), "status")
    return told.groupBy("segment_id", code.alias("code")).agg(F.count(F.lit(1)).alias("places")).withColumn("severity", F.when(F.col("code") == "terminology_pending", "info").otherwise("warning"))
