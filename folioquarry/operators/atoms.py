"""Source atoms (pieces of markup with text) put together to blocks, and navigation entries placed on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioquarry.functions.text import unclosed_delimiters
from folioquarry.operators import ordered

MERGE = 6.5  # the score from which two atoms are one block
HEADING_CHARS = 180
ROLES_APART = ("list_item", "table_cell", "verse", "footnote")


def boundaries(atoms: DataFrame) -> DataFrame:
    """``atoms`` with ``score`` and ``merges``: whether an atom goes on with the one before it in its document; null score for the first.

    An atom has document_id, ordinal, kind, spine_path, semantic_path, parent_path, classes, style, continues, page_break and text (classes
    and style '' where none are known). Atoms of one container are one block; list items, cells, verse and notes stand alone; so
    do different kinds; short headings of one file are one. Else marks, case, place and publisher's hints are added up.
    """
    own = ["kind", "spine_path", "semantic_path", "parent_path", "classes", "style", "continues", F.rtrim("text").alias("text")]
    placed = ordered.previous(atoms, ["document_id"], ["ordinal"], F.struct(*own), "left")
    a = lambda c: F.col(f"left.{c}")
    here, one = F.ltrim("text"), lambda c, x: F.when(c, x).otherwise(0.0)
    lower = here.rlike(r"^\p{Ll}")
    total = reduce(lambda x, y: x + y, [
        one(a("parent_path") == F.col("parent_path"), 0.75), one((a("classes") != "") & (a("classes") == F.col("classes")), 0.5), one((a("style") != "") & (a("style") == F.col("style")), 0.25),
        one(a("continues") | F.col("continues"), 2.5), one(F.col("page_break"), 2.0), one(a("spine_path") != F.col("spine_path"), -1.0),
        F.when(a("text").rlike(r"[.!?…。！？][\"'”’»)\]]*$"), -4.0).when(a("text").rlike("[,;:—–]$"), 2.5).otherwise(0.75),
        F.when(lower, 3.0).when(here.rlike(r"^\p{Lu}"), -1.5).otherwise(0.0), one(here.rlike(r"^(?:[-*•]|[0-9]{1,3}[.)]) "), -4.0), one(unclosed_delimiters(a("text")), 2.0), one(a("text").rlike("[-‐‑]$") & lower, 2.5)])
    headings = F.when((F.length(a("text")) + F.length("text") <= HEADING_CHARS) & (a("spine_path") == F.col("spine_path")), 6.0).otherwise(-6.0)
    score = (F.when(F.col("left").isNull(), None).when(a("semantic_path") == F.col("semantic_path"), 10.0).when(a("kind").isin(*ROLES_APART) | F.col("kind").isin(*ROLES_APART) | (a("kind") != F.col("kind")), -10.0)
             .when(F.col("kind") == "heading", headings).otherwise(total))
    merges = F.coalesce((F.col("score") >= MERGE) | ((F.col("kind") == "heading") & (F.col("score") == 6.0)), F.lit(False))
    return placed.withColumn("score", score).withColumn("merges", merges).drop("left")


def reflowed(atoms: DataFrame) -> DataFrame:
    """(document_id, block_no, kind, text, atoms, confidence): the blocks of ``boundaries``; lines of headings and verse stay lines, words cut by a hyphen are joined."""
    marked = boundaries(atoms)
    numbered = ordered.running_sum(marked, ["document_id"], ["ordinal"], F.when(F.col("merges"), 0).otherwise(1), "block_no")
    sure = F.least(F.lit(0.98), 0.55 + F.abs(F.when(F.col("merges"), F.col("score")) - MERGE) / 10)
    blocks = numbered.groupBy("document_id", "block_no").agg(F.min_by("kind", "ordinal").alias("kind"), F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda r: r["text"]).alias("texts"), F.count(F.lit(1)).alias("atoms"), F.coalesce(F.min(sure), F.lit(1.0)).alias("confidence"))

    def join(x: Column, y: Column) -> Column:
        left, right = F.rtrim(x), F.ltrim(y)
        return (F.when(x == "", y).when(y == "", x).when(F.col("kind").isin("heading", "verse"), F.concat(left, F.lit("\n"), right))
                .when(left.rlike("[-‐‑]$") & right.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(left, "[-‐‑]$", ""), right)).otherwise(F.concat_ws(" ", left, right)))

    return blocks.select("document_id", "block_no", "kind", F.aggregate(F.slice("texts", F.lit(2), F.size("texts")), F.element_at("texts", 1), join).alias("text"), "atoms", "confidence")


def placed_entries(entries: DataFrame, anchors: DataFrame, atoms: DataFrame) -> DataFrame:
    """(document_id, entry_no, ordinal): the atom at which each navigation entry (document_id, entry_no, spine_path, fragment) begins.

    An entry's anchor (document_id, spine_path, fragment, ordinal of the next atom) is looked up by its fragment, else it is the first atom
    of its file; entries of unknown files have null.
    """
    first = atoms.groupBy("document_id", "spine_path").agg(F.min("ordinal").alias("first"))
    named = anchors.groupBy("document_id", "spine_path", "fragment").agg(F.min("ordinal").alias("named"))
    out = entries.join(named, ["document_id", "spine_path", "fragment"], "left").join(first, ["document_id", "spine_path"], "left")
    return out.select("document_id", "entry_no", F.coalesce("named", "first").alias("ordinal"))


def chapters_of(atoms: DataFrame, placed: DataFrame) -> DataFrame:
    """(document_id, ordinal, entry_no): the latest navigation entry that begins at or before each atom, the last of several at one place."""
    here = placed.where("ordinal IS NOT NULL").groupBy("document_id", "ordinal").agg(F.max("entry_no").alias("entry_no"))
    rows = atoms.select("document_id", "ordinal").join(here, ["document_id", "ordinal"], "left")
    return ordered.filled(rows, ["document_id"], ["ordinal"], F.col("entry_no"), "chapter").select("document_id", "ordinal", F.col("chapter").alias("entry_no"))
