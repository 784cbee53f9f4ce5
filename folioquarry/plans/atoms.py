"""Queries over text nodes as atoms of markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquarry.operators import atoms as A
from folioquarry.operators.ordered import running_sum
from folioquarry.sources.tables import table


def _atoms(spark: SparkSession, folder: str) -> DataFrame:
    """Text nodes with the kind of their segment; what a container is follows from the path."""
    kinds = table(spark, folder, "segments", F.col("id").alias("segment_id"), "kind", F.col("ordinal").alias("at"))
    nodes = table(spark, folder, "text_nodes", "node_id", "document_id", "segment_id", "spine_path", "dom_path", F.col("ordinal").alias("part"), F.col("source_text").alias("text")).where("text IS NOT NULL")
    none = F.lit("")
    placed = running_sum(nodes.join(kinds, "segment_id"), ["document_id"], ["at", "part"], F.lit(1), "ordinal")
    return placed.select("node_id", "document_id", "ordinal", "kind", "spine_path", F.concat_ws("#", "spine_path", "dom_path").alias("semantic_path"), F.regexp_replace("dom_path", "/[^/]*$", "").alias("parent_path"),
                                                  none.alias("classes"), none.alias("style"), F.lit(False).alias("continues"), F.lit(False).alias("page_break"), "text")


def w11_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every boundary between neighbouring text nodes, and whether they are one block."""
    return A.boundaries(_atoms(spark, folder)).select("node_id", "score", "merges")


def s6_reflowed(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks put together from text nodes."""
    out = A.reflowed(_atoms(spark, folder))
    return out.select("document_id", F.col("block_no").cast("bigint").alias("block_no"), "kind", F.sha2("text", 256).alias("digest"), "atoms", F.round("confidence", 6).alias("confidence"))


QUERIES = {"w11_boundaries": w11_boundaries, "s6_reflowed": s6_reflowed}
_APART = "('list_item', 'table_cell', 'verse', 'footnote')"
_OPEN = " OR ".join(f"length(replace(lt, '{a}', '')) < length(replace(lt, '{b}', ''))" for a, b in ("()", "[]", "{}", "«»", "“”"))
ORACLE = {
    "w11_boundaries": rf"""WITH a AS (SELECT node_id, n.document_id, s.ordinal AS pos, n.ordinal AS part, kind, spine_path, spine_path || '#' || dom_path AS sem, regexp_replace(dom_path, '/[^/]*$', '') AS parent, n.source_text AS text FROM text_nodes n JOIN segments s ON s.id = n.segment_id WHERE n.source_text IS NOT NULL),
        b AS (SELECT *, lag(kind) OVER w AS lk, lag(spine_path) OVER w AS ls, lag(sem) OVER w AS lsem, lag(parent) OVER w AS lp, lag(rtrim(text, ' ')) OVER w AS lt, ltrim(text, ' ') AS here FROM a WINDOW w AS (PARTITION BY document_id ORDER BY pos, part)),
        c AS (SELECT *, CASE WHEN lk IS NULL THEN NULL WHEN lsem = sem THEN 10.0 WHEN lk IN {_APART} OR kind IN {_APART} OR lk <> kind THEN -10.0 WHEN kind = 'heading' THEN CASE WHEN length(lt) + length(text) <= 180 AND ls = spine_path THEN 6.0 ELSE -6.0 END
            ELSE CASE WHEN lp = parent THEN 0.75 ELSE 0 END + CASE WHEN ls <> spine_path THEN -1.0 ELSE 0 END
               + CASE WHEN regexp_matches(lt, '[.!?…。！？]["''”’»)\]]*$') THEN -4.0 WHEN regexp_matches(lt, '[,;:—–]$') THEN 2.5 ELSE 0.75 END
               + CASE WHEN regexp_matches(here, '^\p{{Ll}}') THEN 3.0 WHEN regexp_matches(here, '^\p{{Lu}}') THEN -1.5 ELSE 0 END + CASE WHEN regexp_matches(here, '^(?:[-*•]|[0-9]{{1,3}}[.)]) ') THEN -4.0 ELSE 0 END
               + CASE WHEN {_OPEN} THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(lt, '[-‐‑]$') AND regexp_matches(here, '^\p{{Ll}}') THEN 2.5 ELSE 0 END END AS score FROM b)
        SELECT node_id, CAST(score AS DOUBLE) AS score, coalesce(score >= 6.5 OR (kind = 'heading' AND score = 6.0), false) AS merges FROM c""",
}
