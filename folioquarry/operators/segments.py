"""Operators on ordered segments: scanning, keys, headings, grouping, ranges, search."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioquarry.functions import text as X
from folioquarry.functions.arrow import map_batches
from folioquarry.operators import ordered
from folioquarry.session import cut_lineage


def scan_blocks(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, block_no, kind, text): the blocks of plain text or Markdown, which blank lines divide.

    Kinds: heading (one line of one to six '#'), footnote ('[^x]:'), blockquote (every line starts with '>'), paragraph.
    """
    folded = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    parts = df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(folded, r"\n[ \t]*(?:\n[ \t]*)+")).alias("at", "raw"))
    block = F.regexp_replace("raw", r"^[ \t\n]+|[ \t\n]+$", "")
    kind = (F.when(F.col("text").rlike(r"^#{1,6} +[^\n]*$"), "heading").when(F.col("text").rlike(r"^\[\^[^\]\n]+\]:"), "footnote")
            .when(~F.col("text").rlike(r"(^|\n)[^>]"), "blockquote").otherwise("paragraph"))
    kept = parts.select("doc_id", "at", block.alias("text")).where("text <> ''")
    return kept.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).cast("bigint").alias("block_no"), kind.alias("kind"), "text")


def stable_keys(segments: DataFrame) -> DataFrame:
    """(id, key, repeat): content keys that don't change when other segments come or go; equal contents of a book are numbered in order."""
    digest = X.content_hash(F.col("document_id"), F.col("kind"), X.identity_form(F.coalesce("source_text", F.lit(""))))
    rows = segments.select("id", "document_id", "ordinal", digest.alias("digest"))
    repeat = (F.row_number().over(Window.partitionBy("document_id", "digest").orderBy("ordinal", "id")) - 1).cast("bigint")
    numbered = rows.withColumn("repeat", repeat)
    return numbered.select("id", X.content_hash(F.col("digest"), F.col("repeat").cast("string")).alias("key"), "repeat")


def dense_order(segments: DataFrame) -> DataFrame:
    """(id, position): ordinals without gaps."""
    rows = ordered.running_sum(segments.select("id", "document_id", "ordinal"), ["document_id"], ["ordinal", "id"], F.lit(1), "n")
    return rows.select("id", (F.col("n") - 1).cast("bigint").alias("position"))


def filled_heading(segments: DataFrame) -> DataFrame:
    """(id, heading): the heading that each segment stands under, itself included; '' before the first."""
    rows = segments.select("id", "document_id", "ordinal", F.when(F.col("kind") == "heading", F.col("source_text")).alias("own"))
    return ordered.filled(rows, ["document_id"], ["ordinal"], F.col("own"), "heading").select("id", F.coalesce("heading", F.lit("")).alias("heading"))


def _folded(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable[..., tuple]) -> DataFrame:
    """One pass over the rows of every group in order: ``step(state, *columns after the key)`` gives the new state and an output row.

    Rows are sorted by Spark (which spills), and a task holds one batch and one state, however large a group is.
    """
    def make():
        held = [None, None]

        def work(keys, *columns):
            for k, *row in zip(keys, *columns):
                if held[1] is None or k != held[0]:
                    held[:] = k, start()
                held[1], out = step(held[1], *row)
                yield (k, *out)

        return work

    return map_batches(df.repartition(F.col(key)).sortWithinPartitions(key, *order), make, schema)


def heading_paths(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no, path): titles from the outermost down to each Markdown heading.

    A title at level n replaces what stands at position n and below of the stack; where levels were skipped the stack is
    shorter than the level says, and a title of the same level then goes below its predecessor.
    """
    heads = blocks.where("kind = 'heading'").select("doc_id", "block_no", F.length(F.regexp_extract("text", r"^#+", 0)).alias("level"), F.regexp_replace("text", r"^#+ +", "").alias("title"))

    def step(stack, block_no, level, title):
        stack = [*stack[: level - 1], title]
        return stack, (block_no, " / ".join(stack))

    return _folded(heads, "doc_id", ["block_no"], f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, block_no bigint, path string", list, step)


def capacity_groups(segments: DataFrame, most: int, most_chars: int, new_group: Column | None = None, chars: Column | None = None) -> DataFrame:
    """(document_id, id, group_no): runs of segments of a book that hold at most ``most`` segments and ``most_chars`` characters.

    A segment that would exceed a limit opens a group, as does one where ``new_group`` is true. ``chars`` is the size of a
    segment, the length of its source unless given. The fold runs over sizes, never over texts.
    """
    size = F.coalesce(F.length("source_text"), F.lit(0)) if chars is None else chars
    rows = segments.select("document_id", "ordinal", "id", size.cast("bigint").alias("n"), F.coalesce(F.lit(False) if new_group is None else new_group, F.lit(False)).alias("cut"))

    def step(state, _, i, n, cut):
        group, held, total = state
        if group < 0 or cut or held >= most or total + n > most_chars:
            group, held, total = group + 1, 0, 0
        return (group, held + 1, total + n), (i, group)

    return _folded(rows, "document_id", ["ordinal", "id"], "document_id string, id string, group_no bigint", lambda: (-1, 0, 0), step)


def neighbours(segments: DataFrame, radius: int) -> DataFrame:
    """(id, neighbour_id, distance): segments of the same book up to ``radius`` ordinals away."""
    a = segments.select("id", "document_id", F.explode(F.expr(f"sequence(ordinal - {radius}, ordinal + {radius})")).alias("ordinal"), F.col("ordinal").alias("own"))
    b = segments.select(F.col("id").alias("neighbour_id"), "document_id", "ordinal")
    return a.join(b, ["document_id", "ordinal"]).where("id <> neighbour_id").select("id", "neighbour_id", (F.col("ordinal") - F.col("own")).cast("bigint").alias("distance"))


def in_ranges(segments: DataFrame, ranges: Iterable[tuple[int, int]]) -> DataFrame:
    """Segments whose ordinal lies in any of the (first, last) ranges."""
    return segments.where(F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges]), lambda r: F.col("ordinal").between(r["a"], r["b"])))


def snippets(df: DataFrame, record: str, text: str, query: str, before: int = 70, after: int = 100) -> DataFrame:
    """(record_id, hit_no, snippet) of every place of a phrase, whatever white space stands between its words, without regard to case."""
    words = [w for w in query.split()]
    pattern = "(?i)" + r"[ \t\r\n]+".join(F_quote(w) for w in words)
    rows = df.select(F.col(record).alias("record_id"), F.col(text).alias("t"))
    pieces = rows.where(F.col("t").rlike(pattern)).select("record_id", "t", F.split("t", pattern).alias("gaps"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("hits"))
    hits = pieces.select("record_id", "t", "gaps", F.posexplode("hits").alias("k", "hit"), F.col("hits"))
    ahead = F.aggregate(F.slice("gaps", F.lit(1), F.col("k") + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("hits", F.lit(1), F.col("k")), F.lit(0), lambda a, g: a + F.length(g))
    start = F.greatest(ahead - before, F.lit(0))
    return hits.select("record_id", F.col("k").cast("bigint").alias("hit_no"), F.substring("t", start + 1, ahead - start + F.length("hit") + after).alias("snippet"))


def F_quote(word: str) -> str:
    """``word`` as a literal of a regular expression."""
    return "".join(c if c.isalnum() else "\\" + c for c in word)


def chapter_ranges(segments: DataFrame) -> DataFrame:
    """(document_id, chapter_no, first_ordinal, last_ordinal, title): each heading with the segments up to the next one."""
    heads = segments.where("kind = 'heading'").select("document_id", "ordinal", F.col("source_text").alias("title"))
    ends = segments.groupBy("document_id").agg(F.max("ordinal").alias("end"))
    order = Window.partitionBy("document_id").orderBy("ordinal")
    return heads.join(ends, "document_id").select("document_id", F.row_number().over(order).cast("bigint").alias("chapter_no"), F.col("ordinal").cast("bigint").alias("first_ordinal"),
                                                  F.coalesce(F.lead("ordinal").over(order) - 1, F.col("end")).cast("bigint").alias("last_ordinal"), "title")


def connected(links: DataFrame, scope: list[str], group: str, member: str) -> DataFrame:
    """(scope, member, component): the least member that each is connected with through groups, by rounds until nothing changes.

    Each round takes the least component within each group and then for each member, so no pairs are made within a group; a
    round follows the jumps of the one before, and its table is written, so that lineage stays short.
    """
    at = [*scope, member]
    links = cut_lineage(links.select(*scope, group, member).distinct())
    own = links.select(*at).distinct().withColumn("component", F.col(member))
    while True:
        own = cut_lineage(own)
        least = links.join(own, at).groupBy(*scope, group).agg(F.min("component").alias("c"))
        reached = links.join(least, [*scope, group]).groupBy(*at).agg(F.min("c").alias("c"))
        jump = own.select(*scope, F.col(member).alias("c"), F.col("component").alias("further"))
        moved = cut_lineage(own.join(reached, at).join(jump, [*scope, "c"], "left").select(*at, "component", F.least("c", "further").alias("new")))
        if moved.where("new < component").isEmpty():
            return own
        own = moved.select(*at, F.col("new").alias("component"))


def bag_alignment(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(left_id, right_id): the n-th left row of each key with its n-th right row, for frames with id, ordinal and ``keys``; rows left over have null."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal", "id"))
    a = left.select(F.col("id").alias("left_id"), *keys, rank.alias("n"))
    b = right.select(F.col("id").alias("right_id"), *keys, rank.alias("n"))
    return a.join(b, [*keys, "n"], "full").select("left_id", "right_id")
