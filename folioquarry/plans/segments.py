"""Queries over segments, blocks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioquarry.functions import text as X
from folioquarry.operators import segments as S
from folioquarry.session import small
from folioquarry.sources.tables import table

PHRASE = "upland parishes"
RANGES = [(0, 4), (9, 12), (30, 31)]


def _segments(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "segments", "id", "document_id", "ordinal", "kind", "source_text", *columns)


def s1_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return S.scan_blocks(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def s2_stable_keys(spark: SparkSession, folder: str) -> DataFrame:
    return S.stable_keys(_segments(spark, folder))


def s15_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents without those that, figures and Roman numerals masked, stand in at least three documents and in 1.5 % of all; documents without any line left count 0."""
    documents = table(spark, folder, "documents", "doc_id", "text")
    lines = documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    masked = lines.withColumn("mask", F.regexp_replace(F.lower(F.trim("line")), "[0-9]+|\\b[ivxlcdm]+\\b", "#"))
    total = documents.agg(F.greatest(F.lit(3.0), 0.015 * F.count_distinct("doc_id")).alias("least"))
    common = masked.groupBy("mask").agg(F.count_distinct("doc_id").alias("n")).join(F.broadcast(total)).where("n >= least").select("mask")  # the total is one row
    kept = masked.join(common, "mask", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))
    return documents.select("doc_id").join(kept, "doc_id", "left").fillna(0, ["lines", "chars"])


def s17_page_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where each block begins in the text of its page, blocks joined by line breaks."""
    order = Window.partitionBy("document_id", "page_no").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    blocks = table(spark, folder, "pdf_blocks", "block_id", "document_id", "page_no", "ordinal", "block_text")
    return blocks.select("block_id", F.coalesce(F.sum(F.length("block_text") + 1).over(order), F.lit(0)).cast("bigint").alias("start_offset"))


def k1_export(spark: SparkSession, folder: str) -> DataFrame:
    """Every book as one text: its current translations in order, blank lines between."""
    s = _segments(spark, folder, *X.LAYERS).select("document_id", "ordinal", X.visible().alias("t")).where("t <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "t"))), lambda p: p["t"]), "\n\n")
    return s.groupBy("document_id").agg(F.sha2(joined, 256).alias("text_hash"), F.length(joined).cast("bigint").alias("chars"))


def k1_export_bilingual(spark: SparkSession, folder: str) -> DataFrame:
    """The same with each source before its translation."""
    s = _segments(spark, folder, *X.LAYERS).select("document_id", "ordinal", F.concat_ws("\n\n", F.nullif("source_text", F.lit("")), F.nullif(X.visible(), F.lit(""))).alias("t")).where("t <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "t"))), lambda p: p["t"]), "\n\n")
    return s.groupBy("document_id").agg(F.sha2(joined, 256).alias("text_hash"), F.length(joined).cast("bigint").alias("chars"))


def f1_visible(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder, *X.LAYERS).select("id", X.visible().alias("visible"), X.visible_sql().alias("visible_sql"))


def f2_search(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with a phrase in the source or any layer, by ASCII-insensitive LIKE with live wildcards."""
    hit = F.lit(False)
    for c in ("source_text", *X.LAYERS):
        hit = hit | F.coalesce(X.like_ascii(F.col(c), " Upl_nd%PARISH "), F.lit(False))
    return _segments(spark, folder, *X.LAYERS).where(hit).select("id", "document_id", "ordinal")


def f3_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return S.snippets(_segments(spark, folder), "id", "source_text", PHRASE)


def f4_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return S.in_ranges(_segments(spark, folder), RANGES).select("id", "document_id", "ordinal")


def f5_open_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments without visible translation that nobody confirmed."""
    return _segments(spark, folder, "status", *X.LAYERS).where((F.col("status") != "human_confirmed") & (X.visible() == "")).select("id", "document_id", "ordinal")


def f14_references(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that are bibliographic references: author, initial, title and a year in brackets."""
    return _segments(spark, folder).where(F.col("source_text").rlike(r"^[\p{Lu}][\p{L}]+, [\p{Lu}]\.,? [^\n]*\([^()\n]*[0-9]{4}\)")).select("id", "document_id", "kind")


def j5_project_of_document(spark: SparkSession, folder: str) -> DataFrame:
    books = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), "project_id", "source_lang", "target_lang"))
    return _segments(spark, folder, "status").join(books, "document_id").groupBy("project_id", "source_lang", "target_lang").agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("document_id").alias("books"))


def j4_nodes_of_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Text nodes with their segments, and whether their characters are part of the segment's."""
    nodes = table(spark, folder, "text_nodes", "node_id", "segment_id", F.col("source_text").alias("node_text"))
    return nodes.join(_segments(spark, folder).select(F.col("id").alias("segment_id"), "ordinal", "source_text"), "segment_id").select("node_id", "segment_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.contains("source_text", "node_text").alias("inside"))


def j17_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return S.neighbours(_segments(spark, folder).select("id", "document_id", "ordinal"), 2)


def j19_duplicate_books(spark: SparkSession, folder: str) -> DataFrame:
    """The first book of each content in a project, and how many there are."""
    b = table(spark, folder, "book_documents", "id", "project_id", "source_hash", "created_at")
    return b.groupBy("project_id", "source_hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def j20_bag_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of pdf books paired with blocks of the same text, each used once."""
    pdf = small(table(spark, folder, "book_documents", F.col("id").alias("document_id"), "source_format").where("source_format = 'pdf'").select("document_id"))
    left = _segments(spark, folder).join(pdf, "document_id").select("id", "ordinal", "document_id", F.md5("source_text").alias("digest"))
    right = table(spark, folder, "pdf_blocks", F.col("block_id").alias("id"), "ordinal", "document_id", F.md5("block_text").alias("digest"))
    return S.bag_alignment(left, right, ["document_id", "digest"])


def j26_chapter_of_block(spark: SparkSession, folder: str) -> DataFrame:
    """The latest heading block at or before each block (a backward as-of join by union and fill)."""
    blocks = table(spark, folder, "pdf_blocks", "block_id", "document_id", "ordinal", "kind", "block_text")
    order = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("block_id", F.last(F.when(F.col("kind") == "heading", F.col("block_id")), ignorenulls=True).over(order).alias("heading_id"))


def j27_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters with their segments, translated and confirmed segments."""
    s = _segments(spark, folder, "status")
    ranges = S.chapter_ranges(s)
    order = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    placed = s.withColumn("chapter_no", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(order))
    counts = placed.groupBy("document_id", "chapter_no").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("status") != "source").alias("translated"), F.count_if(F.col("status") == "human_confirmed").alias("confirmed"))
    return ranges.join(counts, ["document_id", "chapter_no"])


def j22_connected_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The sheets of each book by what connects them: sheets that a segment's blocks stand on belong together, and so do those that share a sheet."""
    refs = table(spark, folder, "segments", "id", "document_id", F.explode("source_refs").alias("block_id"))
    pages = refs.join(table(spark, folder, "pdf_blocks", "block_id", "page_no"), "block_id").select("document_id", "id", "page_no").distinct()
    return S.connected(pages, ["document_id"], "id", "page_no").select("document_id", F.col("page_no").cast("bigint").alias("page_no"), F.col("component").cast("bigint").alias("component"))


def a12_page_medians(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "pdf_blocks", "document_id", "page_no", "block_text")
    return blocks.groupBy("document_id").agg(F.median(F.length("block_text")).alias("median_chars"), F.count_distinct("page_no").alias("pages"))


def a11_dominant_kind(spark: SparkSession, folder: str) -> DataFrame:
    """The kind that holds most characters of each book; the first by name among equals."""
    per = _segments(spark, folder).groupBy("document_id", "kind").agg(F.sum(F.coalesce(F.length("source_text"), F.lit(0))).alias("chars"))
    first = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("chars"), "kind"))
    return per.withColumn("n", first).where("n = 1").select("document_id", "kind", "chars")


def a17_state_hash(spark: SparkSession, folder: str) -> DataFrame:
    """One digest of the visible translations of each book in order."""
    s = _segments(spark, folder, *X.LAYERS).select("document_id", F.struct("ordinal", F.sha2(X.visible(), 256).alias("h")).alias("p"))
    return s.groupBy("document_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["h"]), ""), 256).alias("state"))


def w2_dense_order(spark: SparkSession, folder: str) -> DataFrame:
    return S.dense_order(_segments(spark, folder))


def w3_heading_paths(spark: SparkSession, folder: str) -> DataFrame:
    return S.heading_paths(s1_blocks(spark, folder))


def w4_filled_heading(spark: SparkSession, folder: str) -> DataFrame:
    return S.filled_heading(_segments(spark, folder))


def w6_capacity_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of at most eight segments and 3,000 characters of source and visible translation."""
    g = S.capacity_groups(_segments(spark, folder, *X.LAYERS), 8, 3000, chars=F.coalesce(F.length("source_text"), F.lit(0)) + F.length(X.visible()))
    return g.groupBy("document_id", "group_no").agg(F.count(F.lit(1)).alias("segments"), F.min("id").alias("least_id"))


def w7_cohesion_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of two to eight segments up to 6,000 characters that no heading or change of chapter divides."""
    s = _segments(spark, folder, "heading_path")
    order = Window.partitionBy("document_id").orderBy("ordinal")
    moved = ~F.col("heading_path").eqNullSafe(F.lag("heading_path").over(order))
    marked = s.withColumn("moved", (F.col("kind") == "heading") | (F.lag("kind").over(order) == "heading") | moved)
    groups = S.capacity_groups(marked, 8, 6000, F.col("moved"))
    return groups.groupBy("document_id", "group_no").agg(F.count(F.lit(1)).alias("segments"), F.min("id").alias("least_id")).where("segments >= 2")


def w13_continuations(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that run on over a page: a block without end of sentence and one on the next sheet that begins in lower case are one."""
    order = Window.partitionBy("document_id").orderBy("ordinal")
    b = table(spark, folder, "pdf_blocks", "block_id", "document_id", "ordinal", "page_no", "kind", "block_text").where("kind = 'paragraph'")
    runs_on = F.coalesce(~F.lag("block_text").over(order).rlike(r"[.!?…:;”»)\]]$") & F.col("block_text").rlike(r"^\p{Ll}") & (F.col("page_no") - F.lag("page_no").over(order) <= 1), F.lit(False))
    marked = b.withColumn("starts", F.when(runs_on, 0).otherwise(1))
    numbered = marked.withColumn("paragraph", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("document_id", "paragraph").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("block_text")).alias("chars"))


def t1_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of ten segments over all books in order, with the total."""
    s = _segments(spark, folder)
    total = s.agg(F.count(F.lit(1)).alias("total"))
    return s.orderBy("document_id", "ordinal").offset(20).limit(10).select("id", "document_id").crossJoin(F.broadcast(total))


QUERIES = {f.__name__: f for f in (s1_blocks, s2_stable_keys, s15_repeated_lines, s17_page_offsets, k1_export, k1_export_bilingual, f1_visible, f2_search, f3_snippets, f4_ranges, f5_open_segments, f14_references, j4_nodes_of_segments,
                                   j5_project_of_document, j17_neighbours, j19_duplicate_books, j20_bag_alignment, j22_connected_pages, j26_chapter_of_block, j27_chapters, a11_dominant_kind, a12_page_medians, a17_state_hash, w2_dense_order,
                                   w3_heading_paths, w4_filled_heading, w6_capacity_groups, w7_cohesion_groups, w13_continuations, t1_page)}

_VISIBLE = "coalesce(nullif(accepted_translation,''), nullif(reviewed_translation,''), nullif(edited_translation,''), nullif(machine_translation,''), '')"
_BLOCKS = r"""
    parts AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*(?:\n[ \t]*)+')) AS raw,
                     generate_subscripts(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*(?:\n[ \t]*)+'), 1) AS pos FROM documents),
    kept AS (SELECT doc_id, pos, regexp_replace(raw, '^[ \t\n]+|[ \t\n]+$', '', 'g') AS text FROM parts),
    blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block_no,
                      CASE WHEN regexp_full_match(text, '#{1,6} +[^\n]*') THEN 'heading' WHEN regexp_matches(text, '^\[\^[^\]\n]+\]:') THEN 'footnote'
                           WHEN NOT regexp_matches(text, '(^|\n)[^>]') THEN 'blockquote' ELSE 'paragraph' END AS kind, text FROM kept WHERE text <> '')"""


def _groups(most: int, most_chars: int, cut: str, having: str, size: str = "coalesce(length(source_text),0)") -> str:
    """Groups by capacity as a recursive query over the positions of each book."""
    return f"""
    WITH RECURSIVE m AS (SELECT id, document_id, {size} AS n, {cut} AS cut, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS pos FROM segments),
    f AS (SELECT id, document_id, pos, 0 AS g, 1 AS k, n AS c FROM m WHERE pos = 1
          UNION ALL
          SELECT m.id, m.document_id, m.pos, CASE WHEN m.cut OR f.k >= {most} OR f.c + m.n > {most_chars} THEN f.g + 1 ELSE f.g END,
                 CASE WHEN m.cut OR f.k >= {most} OR f.c + m.n > {most_chars} THEN 1 ELSE f.k + 1 END, CASE WHEN m.cut OR f.k >= {most} OR f.c + m.n > {most_chars} THEN m.n ELSE f.c + m.n END
          FROM f JOIN m ON m.document_id = f.document_id AND m.pos = f.pos + 1)
    SELECT document_id, CAST(g AS BIGINT) AS group_no, count(*) AS segments, min(id) AS least_id FROM f GROUP BY ALL {having}"""


_EXPORT = """SELECT document_id, sha256(string_agg(t, chr(10)||chr(10) ORDER BY ordinal)) AS text_hash, CAST(length(string_agg(t, chr(10)||chr(10) ORDER BY ordinal)) AS BIGINT) AS chars
             FROM (SELECT document_id, ordinal, {} AS t FROM segments) WHERE t <> '' GROUP BY document_id"""
ORACLE = {
    "s1_blocks": f"WITH {_BLOCKS} SELECT * FROM blocks",
    "s2_stable_keys": r"""WITH d AS (SELECT id, document_id, ordinal, sha256(concat_ws(chr(31), document_id, kind, trim(regexp_replace(lower(coalesce(source_text,'')), '[ \t\r\n\x{00A0}\x{3000}]+', ' ', 'g')))) AS digest FROM segments),
        n AS (SELECT *, row_number() OVER (PARTITION BY document_id, digest ORDER BY ordinal, id) - 1 AS repeat FROM d) SELECT id, sha256(concat_ws(chr(31), digest, CAST(repeat AS VARCHAR))) AS key, repeat FROM n""",
    "s15_repeated_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, line, regexp_replace(lower(trim(line)), '[0-9]+|\b[ivxlcdm]+\b', '#', 'g') AS mask FROM l WHERE trim(line) <> ''),
        c AS (SELECT mask FROM m GROUP BY mask HAVING count(DISTINCT doc_id) >= greatest(3.0, 0.015 * (SELECT count(*) FROM documents))), k AS (SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM m WHERE mask NOT IN (SELECT mask FROM c) GROUP BY doc_id)
        SELECT doc_id, coalesce(lines, 0) AS lines, coalesce(chars, 0) AS chars FROM documents LEFT JOIN k USING (doc_id)""",
    "s17_page_offsets": "SELECT block_id, CAST(coalesce(sum(length(block_text)+1) OVER (PARTITION BY document_id, page_no ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM pdf_blocks",
    "k1_export": _EXPORT.format(_VISIBLE),
    "k1_export_bilingual": _EXPORT.format(f"concat_ws(chr(10)||chr(10), nullif(source_text,''), nullif({_VISIBLE},''))"),
    "f1_visible": f"SELECT id, {_VISIBLE} AS visible, coalesce(accepted_translation, reviewed_translation, edited_translation, machine_translation, '') AS visible_sql FROM segments",
    "f2_search": "SELECT id, document_id, ordinal FROM segments WHERE " + " OR ".join(f"coalesce(translate({c}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') LIKE '%UPL_ND%PARISH%', false)" for c in ("source_text", *X.LAYERS)),
    "f3_snippets": r"""WITH RECURSIVE h AS (SELECT id, source_text AS t, regexp_extract_all(source_text, '(?i)upland[ \t\r\n]+parishes') AS hits, string_split_regex(source_text, '(?i)upland[ \t\r\n]+parishes') AS gaps FROM segments WHERE regexp_matches(source_text, '(?i)upland[ \t\r\n]+parishes')),
        e AS (SELECT id, t, k, hits[k] AS hit, length(array_to_string(gaps[:k], '')) + length(array_to_string(hits[:k-1], '')) AS ahead FROM (SELECT *, unnest(range(1, len(hits)+1)) AS k FROM h))
        SELECT id AS record_id, CAST(k - 1 AS BIGINT) AS hit_no, substring(t, greatest(ahead-70, 0) + 1, ahead - greatest(ahead-70, 0) + length(hit) + 100) AS snippet FROM e""",
    "f4_ranges": "SELECT id, document_id, ordinal FROM segments WHERE " + " OR ".join(f"ordinal BETWEEN {a} AND {b}" for a, b in RANGES),
    "f5_open_segments": f"SELECT id, document_id, ordinal FROM segments WHERE status <> 'human_confirmed' AND {_VISIBLE} = ''",
    "f14_references": r"SELECT id, document_id, kind FROM segments WHERE regexp_matches(source_text, '^[\p{Lu}][\p{L}]+, [\p{Lu}]\.,? [^\n]*\([^()\n]*[0-9]{4}\)')",
    "j4_nodes_of_segments": "SELECT node_id, segment_id, CAST(s.ordinal AS BIGINT) AS ordinal, contains(s.source_text, n.source_text) AS inside FROM text_nodes n JOIN segments s ON s.id = n.segment_id",
    "j5_project_of_document": "SELECT project_id, source_lang, target_lang, count(*) AS segments, count(DISTINCT b.id) AS books FROM segments s JOIN book_documents b ON b.id = s.document_id GROUP BY ALL",
    "j17_neighbours": "SELECT a.id, b.id AS neighbour_id, CAST(b.ordinal - a.ordinal AS BIGINT) AS distance FROM segments a JOIN segments b ON a.document_id = b.document_id AND b.ordinal BETWEEN a.ordinal - 2 AND a.ordinal + 2 AND a.id <> b.id",
    "j19_duplicate_books": "SELECT project_id, source_hash, arg_min(id, (created_at, id)) AS first_id, count(*) AS copies FROM book_documents GROUP BY ALL",
    "j20_bag_alignment": """WITH l AS (SELECT s.id, document_id, md5(source_text) AS d, row_number() OVER (PARTITION BY document_id, md5(source_text) ORDER BY ordinal, s.id) AS n FROM segments s JOIN book_documents b ON b.id = s.document_id WHERE source_format = 'pdf'),
        r AS (SELECT block_id, document_id, md5(block_text) AS d, row_number() OVER (PARTITION BY document_id, md5(block_text) ORDER BY ordinal, block_id) AS n FROM pdf_blocks)
        SELECT l.id AS left_id, r.block_id AS right_id FROM l FULL JOIN r ON l.document_id = r.document_id AND l.d = r.d AND l.n = r.n""",
    "j22_connected_pages": """WITH RECURSIVE p AS (SELECT DISTINCT s.document_id, s.id, page_no FROM (SELECT id, document_id, unnest(source_refs) AS block_id FROM segments) s JOIN pdf_blocks USING (block_id)),
        e AS (SELECT DISTINCT a.document_id, a.page_no AS x, b.page_no AS y FROM p a JOIN p b ON a.document_id = b.document_id AND a.id = b.id),
        r AS (SELECT document_id, x, y FROM e UNION SELECT r.document_id, r.x, e.y FROM r JOIN e ON e.document_id = r.document_id AND e.x = r.y)
        SELECT document_id, CAST(x AS BIGINT) AS page_no, CAST(min(y) AS BIGINT) AS component FROM r GROUP BY document_id, x""",
    "j26_chapter_of_block": "SELECT block_id, last_value(CASE WHEN kind = 'heading' THEN block_id END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading_id FROM pdf_blocks",
    "j27_chapters": """WITH h AS (SELECT document_id, ordinal, source_text AS title, row_number() OVER w AS chapter_no, lead(ordinal) OVER w - 1 AS l FROM segments WHERE kind = 'heading' WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)),
        r AS (SELECT h.document_id, chapter_no, CAST(ordinal AS BIGINT) AS first_ordinal, CAST(coalesce(l, e) AS BIGINT) AS last_ordinal, title FROM h JOIN (SELECT document_id, max(ordinal) AS e FROM segments GROUP BY 1) USING (document_id))
        SELECT r.*, count(*) AS segments, count(*) FILTER (status <> 'source') AS translated, count(*) FILTER (status = 'human_confirmed') AS confirmed FROM r JOIN segments s ON s.document_id = r.document_id AND s.ordinal BETWEEN first_ordinal AND last_ordinal GROUP BY ALL""",
    "a11_dominant_kind": "SELECT document_id, kind, chars FROM (SELECT document_id, kind, CAST(sum(coalesce(length(source_text),0)) AS BIGINT) AS chars, row_number() OVER (PARTITION BY document_id ORDER BY sum(coalesce(length(source_text),0)) DESC, kind) AS n FROM segments GROUP BY document_id, kind) WHERE n = 1",
    "a12_page_medians": "SELECT document_id, median(length(block_text)) AS median_chars, count(DISTINCT page_no) AS pages FROM pdf_blocks GROUP BY document_id",
    "a17_state_hash": f"SELECT document_id, sha256(string_agg(sha256({_VISIBLE}), '' ORDER BY ordinal)) AS state FROM segments GROUP BY document_id",
    "w2_dense_order": "SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, id) - 1 AS position FROM segments",
    "w4_filled_heading": "SELECT id, coalesce(last_value(CASE WHEN kind = 'heading' THEN source_text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS heading FROM segments",
    "w6_capacity_groups": _groups(8, 3000, "false", "", f"coalesce(length(source_text),0) + length({_VISIBLE})"),
    "w7_cohesion_groups": _groups(8, 6000, "(kind = 'heading' OR coalesce(lag(kind) OVER (PARTITION BY document_id ORDER BY ordinal) = 'heading', false) OR heading_path IS DISTINCT FROM lag(heading_path) OVER (PARTITION BY document_id ORDER BY ordinal))", "HAVING count(*) >= 2"),
    "w13_continuations": r"""WITH b AS (SELECT *, lag(block_text) OVER w AS p, page_no - lag(page_no) OVER w AS d FROM pdf_blocks WHERE kind = 'paragraph' WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)),
        m AS (SELECT *, CASE WHEN coalesce(NOT regexp_matches(p, '[.!?…:;”»)\]]$') AND regexp_matches(block_text, '^\p{Ll}') AND d <= 1, false) THEN 0 ELSE 1 END AS starts FROM b),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY document_id ORDER BY ordinal) AS paragraph FROM m) SELECT document_id, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS blocks, CAST(sum(length(block_text)) AS BIGINT) AS chars FROM n GROUP BY document_id, paragraph""",
    "t1_page": "SELECT id, document_id, (SELECT count(*) FROM segments) AS total FROM segments ORDER BY document_id, ordinal LIMIT 10 OFFSET 20",
}
