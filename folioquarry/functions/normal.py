"""Normal forms of texts, and places in a text found through them. JVM functions have no NFKC and no case folding, so these run in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Dashes and minus signs that quality checks read as one hyphen.
DASHES = "−–—﹣"
_DASHES = str.maketrans(DASHES, "-" * len(DASHES))


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def identity(text: str) -> str:
    """Compatible form, white space collapsed, without case: equal contents have equal identity."""
    return " ".join(nfkc(text).split()).casefold()


def term(text: str) -> str:
    """Compatible form without case, trimmed."""
    return nfkc(text).casefold().strip()


def lexeme(text: str) -> str:
    """Compatible form in lower case, white space collapsed; ß stays apart from ss."""
    return " ".join(nfkc(text).split()).lower()


def memory(text: str) -> str:
    """The words of the compatible form without case, joined by spaces."""
    return " ".join(re.findall(r"\w+", nfkc(text).casefold()))


def checked(text: str) -> str:
    """Compatible form with one kind of dash."""
    return nfkc(text).translate(_DASHES)


def _column(function: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run


identity_form, term_form, lexeme_form, memory_form, checked_form = map(_column, (identity, term, lexeme, memory, checked))


def is_word(c: str) -> bool:
    """A letter, figure or underscore; '' is none."""
    return bool(c) and (c == "_" or unicodedata.category(c)[0] in "LN")


@lru_cache(4096)
def western(c: str) -> bool:
    """A figure or a character of a script that sets its words apart: Latin, Greek, Cyrillic."""
    return c.isdigit() or any(s in unicodedata.name(c, "") for s in ("LATIN", "GREEK", "CYRILLIC"))


def expanded(text: str) -> tuple[str, list[int] | range]:
    """The compatible form of each character without case, and for each character of the result its place in ``text``."""
    if text.isascii():
        return text.lower(), range(len(text))
    pieces = [unicodedata.normalize("NFKC", c).casefold() for c in text]
    return "".join(pieces), [k for k, p in enumerate(pieces) for _ in p]


def term_spans(text: str, form: str) -> Iterator[tuple[int, int]]:
    """(start, end) in ``text`` of every place of ``form``, in compatible form and without case.

    A western character at the end of a form must not touch another one or an underscore. A place that begins or ends
    inside what one character stands for is none.
    """
    needle = term(form)
    if not needle:
        return
    low, places = expanded(text)
    seen: set[tuple[int, int]] = set()
    at = low.find(needle)
    while at >= 0:
        end = at + len(needle)
        bound = lambda mine, other: western(mine) and (western(other) or other == "_")
        free = not (at and bound(needle[0], low[at - 1])) and not (end < len(low) and bound(needle[-1], low[end]))
        if free:
            span = places[at], places[end - 1] + 1
            if span not in seen and term(text[span[0] : span[1]]) == needle:
                seen.add(span)
                yield span
        at = low.find(needle, end)


_STOPS = re.compile(r"[.!?。！？\n]")


def enclosing_sentence(text: str, start: int, end: int) -> str:
    """What stands between the sentence marks or line breaks around a place, its closing mark included."""
    left = max(text.rfind(c, 0, start) for c in ".!?。！？\n") + 1
    right = _STOPS.search(text, end)
    return text[left : right.end() if right else len(text)].strip()
