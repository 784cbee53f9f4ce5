"""Where a text holds possible terms, and by which sign each was recalled. One pass over the words of a segment."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from folioquarry.functions import glossary as G
from folioquarry.functions.lexicon import STOP_WORDS
from folioquarry.functions.normal import lexeme

#: Signs by which a term is recalled, as bits.
METHODS = ("unigram", "acronym", "hyphenated", "capitalized_token", "phrase", "connector_phrase", "noun_phrase", "coordination_phrase", "proper_name", "rhetorical_boundary", "quoted", "heading", "definition_cue", "cjk_ngram", "morphological_family")
BIT = {m: 1 << k for k, m in enumerate(METHODS)}
LONGEST_FORM, REACH = 120, 80  # characters of a form, and of the text around it that its neighbours are looked for in

_form = lru_cache(100_000)(lexeme)
_WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
_ACRONYM = re.compile(r"(?:[A-ZÀ-ÖØ-Þ]\.?){2,8}")
_ROMAN = re.compile(r"[ivxlcdm]+")
_ELISION = re.compile(r"(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu)[’'](.+)", re.IGNORECASE)
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]{2,}")
_END = re.compile(r"\s*(?:[.!?…]|$)")


class Word(NamedTuple):
    text: str
    form: str
    start: int
    end: int
    content: bool
    capital: bool


class Found(NamedTuple):
    """A place of a possible term: its words in normal form, where it stands, the signs, and the words before and after."""

    tokens: tuple[str, ...]
    start: int
    end: int
    methods: int
    left: str | None
    right: str | None


def is_content(form: str, stop: frozenset[str]) -> bool:
    return len(form) >= 2 and form not in stop and not form.isdigit() and not _ROMAN.fullmatch(form)


def words(text: str, lang: str, stop: frozenset[str]) -> list[Word]:
    """The words of a text; a French elided word before another is left out."""
    out = []
    for m in _WORD.finditer(text):
        value, start = m[0], m.start()
        if lang == "fr" and (cut := _ELISION.fullmatch(value)):
            value, start = cut[1], m.end() - len(cut[1])
        form = _form(value)
        out.append(Word(value, form, start, m.end(), is_content(form, stop), value[0].isupper() or bool(_ACRONYM.fullmatch(value))))
    return out


def _runs(text: str, found: list[Word]) -> Iterator[list[Word]]:
    """Words that only white space divides."""
    run: list[Word] = []
    for w in found:
        if run and not text[run[-1].end : w.start].isspace():
            yield run
            run = []
        run.append(w)
    if run:
        yield run


def _names(run: list[Word], connectors: frozenset[str]) -> Iterator[list[Word]]:
    """Names of several capitalised words with connectors between, each whole and by every two capitals that only connectors part."""
    at = 0
    while at < len(run):
        if not (run[at].capital and run[at].content):
            at += 1
            continue
        capitals, k = [at], at + 1
        while k < len(run) and (run[k].capital or run[k].form in connectors and k + 1 < len(run) and run[k + 1].capital):
            capitals += [k] * run[k].capital
            k += 1
        if len(capitals) > 1:
            yield run[at : capitals[-1] + 1]
            for a, b in zip(capitals, capitals[1:]):
                if all(w.form in connectors for w in run[a + 1 : b]):
                    yield run[a : b + 1]
        at = capitals[-1] + 1


def western(text: str, lang: str, heading: bool) -> Iterator[tuple[tuple[str, ...], int, int, str]]:
    """(words, start, end, method) of every possible term in order of sight; a place may come more than once, with another method."""
    stop, connectors, joiners = frozenset(STOP_WORDS.get(lang, STOP_WORDS["en"])), G.CONNECTORS.get(lang, frozenset()), G.COORDINATORS.get(lang, frozenset())
    found = words(text, lang, stop)
    place = lambda part, method: (tuple(w.form for w in part), part[0].start, part[-1].end, method)
    for run in _runs(text, found):
        for a, b, c in zip(run, run[1:], run[2:]):
            if b.form in joiners and a.capital and c.capital:
                yield place([a, b, c], "coordination_phrase")
        for w in run:
            if w.content:
                yield place([w], "hyphenated" if "-" in w.text or "–" in w.text else "acronym" if _ACRONYM.fullmatch(w.text) else "unigram")
                before = text[: w.start].rstrip()[-1:] if lang != "de" and w.capital else ""
                if before and before not in ".!?…":
                    yield place([w], "capitalized_token")
        for i, first in enumerate(run):
            if not first.content:
                continue
            weak = 0
            for size in range(2, min(5, len(run) - i) + 1):
                last = run[i + size - 1]
                if size > 2:
                    weak += run[i + size - 2].form in stop
                if not last.content or weak > max(1, (size - 1) // 2):
                    continue
                part = run[i : i + size]
                yield place(part, "phrase")
                if any(w.form in connectors for w in part[1:-1]):
                    yield place(part, "connector_phrase")
                if lang == "de" and last.capital:
                    yield place(part, "noun_phrase")
        for part in _names(run, connectors):
            yield place(part, "proper_name")
            if any(w.form in connectors for w in part[1:-1]):
                yield place(part, "connector_phrase")
            if _END.match(text, part[-1].end):
                yield place(part, "rhetorical_boundary")
    for start, value in quoted(text):
        inner = words(value, lang, stop)
        if 1 <= sum(w.content for w in inner) <= 6:
            yield tuple(w.form for w in inner), start, start + len(value), "quoted"
    if heading and 1 <= sum(w.content for w in found) <= 10:
        yield place(found, "heading")
    for cue in G.CUES.get(lang, G.CUES["en"]).finditer(text):
        tail = [w for w in found if w.end <= cue.start()][-3:]
        while tail and tail[0].form in stop:
            tail = tail[1:]
        while tail and tail[-1].form in stop:
            tail = tail[:-1]
        if tail:
            yield place(tail, "definition_cue")


def quoted(text: str) -> Iterator[tuple[int, str]]:
    """(start, content) of every quotation, trimmed."""
    for pattern in G.QUOTES:
        for m in pattern.finditer(text):
            value = m[1].strip()
            yield text.find(value, m.start(), m.end()), value


def han(text: str) -> Iterator[tuple[tuple[str, ...], int, int, str]]:
    """The same for texts in Han characters: runs of two to six of them, and quotations of 2 to 20 characters."""
    for m in _HAN.finditer(text):
        for size in range(2, min(6, len(m[0])) + 1):
            for a in range(m.start(), m.end() - size + 1):
                yield (text[a : a + size],), a, a + size, "cjk_ngram"
    for start, value in quoted(text):
        if 2 <= len(value) <= 20:
            yield (value,), start, start + len(value), "quoted"


def recalled(text: str, lang: str, heading: bool) -> list[tuple[str, Found]]:
    """(key, place) of every distinct place of a key in a text, in order of sight, with all its signs."""
    places: dict[tuple[str, int, int], list] = {}
    all_words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in all_words], [b for _, b in all_words]
    for tokens, start, end, method in (han(text) if lang == "cjk" else western(text, lang, heading)):
        value = text[start:end]
        key = _form(value) if len(tokens) == 1 else lexeme(value)
        if key and len(value) <= LONGEST_FORM:
            places.setdefault((key, start, end), [tokens, 0])[1] |= BIT[method]
    out = []
    for (key, start, end), (tokens, methods) in places.items():
        # Words that the window of REACH characters or the place itself cuts count with what is left of them.
        k = bisect.bisect_left(starts, start) - 1
        a, b = (max(starts[k], start - REACH), min(ends[k], start)) if k >= 0 else (0, 0)
        left = _form(text[a:b]) if k >= 0 and a < b else None
        k = bisect.bisect_right(ends, end)
        a, b = (max(starts[k], end), min(ends[k], end + REACH)) if k < len(starts) else (0, 0)
        right = _form(text[a:b]) if a < b else None
        out.append((key, Found(tokens, start, end, methods, left or None, right or None)))
    return out
