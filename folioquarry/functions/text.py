"""Column expressions over texts. Classes of characters are spelled out, so that every engine reads them alike."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LAYERS = ("accepted_translation", "reviewed_translation", "edited_translation", "machine_translation")
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:[-’'][\p{L}\p{Nl}\p{No}]+)*"


def visible(*layers: str) -> Column:
    """The first layer that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in layers or LAYERS], F.lit(""))


def visible_sql(*layers: str) -> Column:
    """The first layer that is not null, though it be empty, else ''."""
    return F.coalesce(*[F.col(c) for c in layers or LAYERS], F.lit(""))


def blank(text: Column) -> Column:
    """Whether nothing but white space is in ``text``, of whatever kind; null stays null."""
    return ~text.rlike(r"[^\s\p{Z}\x0B\x1C-\x1F\x85]")


def ascii_upper(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def like_ascii(text: Column, query: str) -> Column:
    """LIKE '%query%' without regard to the case of ASCII letters; % and _ of the query are wildcards."""
    return ascii_upper(text).like("%" + query.strip().translate({ord(c): c.upper() for c in "abcdefghijklmnopqrstuvwxyz"}) + "%")


def identity_form(text: Column) -> Column:
    """White space collapsed and lower case, by which equal contents are told."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n 　]+", " "))


def comparable(text: Column) -> Column:
    """Letters and figures only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def footnote_marks(text: Column) -> Column:
    """All footnote marks in order of the text's sort, as one string: equal strings are equal multisets."""
    return F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(r"\[\^[^\]]+\]"), F.lit(0))), "|")


def unclosed_delimiters(text: Column) -> Column:
    """Whether any opener occurs more often than its closer."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    pairs = [("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"), ("“", "”")]
    out = F.lit(False)
    for a, b in pairs:
        out = out | (count(a) > count(b))
    return out


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def truncated(text: Column, limit: int, tail: bool = False) -> Column:
    """At most ``limit`` characters, the last (or with ``tail`` the first) an ellipsis where something was left out."""
    cut = F.concat(F.lit("…"), F.right(text, F.lit(limit - 1))) if tail else F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def once(value: Column) -> Column:
    """``value`` as a generated column, which is computed once a row; a projected one would be computed again at each use inside a lambda."""
    return F.explode(F.array(value))
