"""Terms in texts: occurrences, longest matches, competing senses, classes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioquarry.functions import normal
from folioquarry.functions.arrow import map_batches
from folioquarry.functions.text import once
from folioquarry.session import cut_lineage, small, spread

HAN = r"[㐀-鿿]"


def source_forms(terms: DataFrame) -> DataFrame:
    """(term_id, project_id, form, ...): the source and aliases of each term, lower case, without repeats, with what resolution needs."""
    forms = F.array_distinct(F.transform(F.concat(F.array("source"), "aliases"), lambda f: F.lower(F.trim(f))))
    return terms.select(F.col("id").alias("term_id"), "project_id", F.explode(forms).alias("form"), "enforcement", "status", "target").where("form <> ''").distinct()


def _keys(text: Column) -> Column:
    """What a form in ``text`` must begin with: each of its words, and each character and pair of characters that begins with a Han character."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    pairs = F.when(text.rlike(HAN), F.regexp_extract_all(text, F.lit(rf"(?s)(?=({HAN}.?))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs, F.transform(pairs, lambda p: F.left(p, F.lit(1)))))


def _first_key(form: Column) -> Column:
    """The key under which a form is looked for; forms that begin with a mark are found by their first word or Han characters."""
    word = F.regexp_extract(form, r"[\p{L}\p{M}\p{N}_]+", 0)
    return F.when(form.rlike(HAN), F.regexp_extract(form, rf"(?s){HAN}.?", 0)).otherwise(word)


def _lower_spans(text: str, form: str) -> Iterator[tuple[int, int]]:
    """Places of ``form`` in the lower-case text; a form of letters must not touch another letter or figure."""
    low, han, at = text.lower(), re.search(HAN, form) is not None, 0
    while (at := low.find(form, at)) >= 0:
        end = at + len(form)
        if han or not (at and normal.is_word(text[at - 1 : at]) or normal.is_word(text[end : end + 1])):
            yield at, end
        at = end


def occurrences(segments: DataFrame, terms: DataFrame, compatible: bool = False) -> DataFrame:
    """(segment_id, term_id, form, start, end, enforcement): places of term forms of the same project in the source.

    ``segments`` has id, project_id, source_text. Forms are looked for in lower case, or with ``compatible`` in compatible form
    without case (full-width, decomposed and ligature spellings match), with offsets into the text as it is. A form joins
    the texts that hold its first word or Han characters, whatever its length; texts don't take part in that join but are brought once.
    Null and empty texts have no places; a form without any word or Han character is not found; repeated rows give one row.
    """
    text = normal.term_form(F.col("source_text")) if compatible else F.lower("source_text")
    forms = source_forms(terms.where("status = 'approved'"))
    if compatible:
        forms = forms.withColumn("form", normal.term_form(F.col("form"))).where("form <> ''").distinct()
    forms = small(forms.withColumn("key", _first_key(F.col("form"))).where("key <> ''"))
    rows = segments.where(F.col("source_text") != "").select("id", "project_id", "source_text")
    keyed = spread(rows).select("id", "project_id", once(_keys(text)).alias("keys")).select("id", "project_id", F.explode("keys").alias("key"))
    wanted = keyed.join(forms, ["project_id", "key"]).groupBy("id", "project_id").agg(F.sort_array(F.collect_set(F.struct("form", "term_id", "enforcement"))).alias("wanted"))
    spans_of: Callable = normal.term_spans if compatible else _lower_spans

    def make():
        def work(ids, texts, wants):
            for i, t, want in zip(ids, texts, wants):
                found: dict[str, list[tuple[int, int]]] = {}
                for w in want:
                    spans = found.get(w["form"])
                    if spans is None:
                        spans = found[w["form"]] = list(spans_of(t, w["form"]))
                    for a, b in spans:
                        yield i, w["term_id"], w["form"], a, b, w["enforcement"]

        return work

    placed = map_batches(rows.join(wanted, ["id", "project_id"]).select("id", "source_text", "wanted"), make, "segment_id string, term_id string, form string, start bigint, end bigint, enforcement string")
    return placed.distinct()


def longest(spans: DataFrame) -> DataFrame:
    """Spans that no strictly longer span of the same class (reference or not) of the segment contains.

    In order of start, then of falling end, a span lies inside an earlier one if one of those reaches its end: one window a segment.
    """
    kind = F.when(F.col("enforcement") == "reference", 1).otherwise(0)
    own = Window.partitionBy("segment_id", "class").orderBy("start", F.desc("end"))
    places = spans.select("segment_id", kind.alias("class"), "start", "end").distinct()
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    free = places.withColumn("reach", reach).where("reach IS NULL OR reach < end").drop("reach")
    return spans.withColumn("class", kind).join(free, ["segment_id", "class", "start", "end"], "left_semi").drop("class").select(*spans.columns)


def competing(spans: DataFrame) -> DataFrame:
    """Spans with how many different terms that aren't references claim exactly the same place."""
    claims = F.size(F.collect_set(F.when(F.col("enforcement") != "reference", F.col("term_id"))).over(Window.partitionBy("segment_id", "start", "end"))).cast("bigint")
    return spans.withColumn("claims", claims)


def classes(spans: DataFrame) -> DataFrame:
    """Longest spans as reference, conditional (depends on context, or other terms compete) or enforced."""
    kind = F.when(F.col("enforcement") == "reference", "reference").when((F.col("enforcement") == "contextual") | (F.col("claims") > 1), "conditional").otherwise("enforced")
    return competing(longest(cut_lineage(spans))).withColumn("class", kind)
