"""Pieces of at most a given number of tokens from texts that are larger.

Method: recursive bisection. A text is cut at the strongest boundary near its middle (heading, paragraph, line,
sentence, clause, word, character) and so is each half that exceeds the limit less the overlap; then each piece after
the first gets the end of the one before it, in whole sentences where they fit.

All cuts but those inside a word fall where the tokenizer cuts too (before white space, or between a mark and a
letter), so token counts of units add up and each text is tokenized once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import tiktoken
from pyspark.sql import DataFrame, functions as F

from folioquarry.functions.arrow import map_batches
from folioquarry.llm import tokens
from folioquarry.session import spread

LIMIT, OVERLAP = 1024, 128
CHARACTER, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH, HEADING = range(-1, 6)
NAMES = {CHARACTER: "character", WORD: "word", CLAUSE: "clause", SENTENCE: "sentence", LINE: "line", PARAGRAPH: "paragraph", HEADING: "heading", 9: "start"}
# Marks that end a sentence, and marks that may follow them.
ENDS, CLOSERS = ".!?…。！？", "\"'”’»)]」』）》〉*_"

_NATURAL = re.compile(rf"(?P<b>[ \t]*\n\s*)(?P<h>#{{1,6}} )?|[{ENDS}।॥]+[{re.escape(CLOSERS)}]*(?:\[\^?\w{{1,8}}\])*(?:(?=[ \t\xa0　]+[^\sa-zà-ÿ])|(?<=[。！？」』）》”])(?=[^\W_]))")
_WORDS = re.compile(r"(?P<c>[,;:—，、；：])?(?:(?=\s)|(?<=[，、；：])(?=[^\W_]))")
_STRETCH = re.compile(rf"[^\n{ENDS}]+")


def _cuts(text: str) -> Iterator[tuple[int, int]]:
    """(offset, strength) of the natural boundaries inside ``text``, in order."""
    for m in _NATURAL.finditer(text):
        if m["b"] is None:
            at, strength = m.end(), SENTENCE
        else:
            at, strength = m.start(), HEADING if m["h"] else PARAGRAPH if m["b"].count("\n") > 1 else LINE
        if 0 < at < len(text):
            yield at, strength


def _halved(text: str, start: int, limit: int, enc: tiktoken.Encoding) -> Iterator[tuple[int, int]]:
    """(offset, tokens) of parts of a stretch without any boundary, cut in the middle until each fits."""
    n = len(enc.encode_ordinary(text))
    if n <= limit or len(text) < 2:
        yield start, n
    else:
        middle = len(text) // 2
        yield from _halved(text[:middle], start, limit, enc)
        yield from _halved(text[middle:], start + middle, limit, enc)


def units(text: str, limit: int, enc: tiktoken.Encoding) -> tuple[list[int], list[int], list[int]]:
    """Starts, strengths of the boundary at the start, and tokens of units that each fit ``limit``."""
    cuts = [(0, 9)]
    cuts += [c for c in _cuts(text) if c[0] > 0]
    starts, strengths, sizes = [], [], []
    for k, (at, strength) in enumerate(cuts):
        end = cuts[k + 1][0] if k + 1 < len(cuts) else len(text)
        if end == at:
            continue
        n = len(enc.encode_ordinary(text[at:end]))
        if n <= limit:
            starts.append(at), strengths.append(strength), sizes.append(n)
            continue
        inner = [(at, strength)] + [(m.end(), CLAUSE if m["c"] else WORD) for m in _WORDS.finditer(text, at, end) if at < m.end() < end and not (m["c"] is None and text[m.end() - 1].isspace())]
        for j, (a, s) in enumerate(inner):
            b = inner[j + 1][0] if j + 1 < len(inner) else end
            if b == a:
                continue
            for i, (place, size) in enumerate(_halved(text[a:b], a, limit, enc)):
                starts.append(place), strengths.append(CHARACTER if i else s), sizes.append(size)
    return starts, strengths, sizes


def bisect(strengths: list[int], sums: list[int], a: int, b: int, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of units, each within ``limit`` tokens; ``sums`` are the tokens before each unit."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        total = sums[b] - sums[a]
        if total <= limit or b - a == 1:
            yield a, b
            continue
        middle = (sums[a] + sums[b]) / 2
        near = [k for k in range(a + 1, b) if abs(sums[k] - middle) <= total / 4] or range(a + 1, b)
        cut = max(near, key=lambda k: (strengths[k], -abs(sums[k] - middle)))
        todo += [(cut, b), (a, cut)]


def _overlap(text: str, a: int, b: int, starts: list[int], sums: list[int], strengths: list[int], end: int, most: int, enc: tiktoken.Encoding) -> tuple[int, int]:
    """Start and tokens of what a piece repeats of units a to b: whole sentences if any fit, else words."""
    best = words = None
    for k in range(b - 1, a - 1, -1):
        if sums[b] - sums[k] > most:
            break
        words = k
        if strengths[k] >= SENTENCE:
            best = k
    chosen = words if best is None else best
    if chosen is not None:
        return starts[chosen], sums[b] - sums[chosen]
    # No unit fits: the longest end of the last one that does, from a space, else a clause, else any character.
    tail = text[starts[b - 1] : end]
    for pattern in (r"(?=\s\S)", r"(?<=[，、；：,;:])", r"(?s)(?=.)"):
        at = [m.start() for m in re.finditer(pattern, tail) if 0 < m.start() < len(tail)][-4 * most :]  # longer ends seldom fit
        fits = lambda k: len(enc.encode_ordinary(tail[at[k] :])) <= most
        low, high = 0, len(at)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if fits(middle) else (middle + 1, high)
        if low < len(at):
            return starts[b - 1] + at[low], len(enc.encode_ordinary(tail[at[low] :]))
    return end, 0


def split(text: str, enc: tiktoken.Encoding, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str, bool]]:
    """(start with overlap, start, end, tokens, kind of cut, unbroken) of each piece; one piece if the text fits ``limit``."""
    starts, strengths, sizes = units(text, limit - overlap, enc)
    sums = [0, *accumulate(sizes)]
    ends = [*starts[1:], len(text)]
    if sums[-1] <= limit:
        return [(0, 0, len(text), sums[-1], NAMES[9], False)]
    # A token has at least one byte, so only a stretch of more bytes than the limit can exceed it.
    unbroken = any(len(m[0]) * 4 > limit and len(m[0].encode()) > limit and len(enc.encode_ordinary(m[0])) > limit for m in _STRETCH.finditer(text))
    out, before = [], None
    for a, b in bisect(strengths, sums, 0, len(starts), limit - overlap):
        at, extra = (starts[a], 0) if before is None else _overlap(text, *before, starts, sums, strengths, starts[a], overlap, enc)
        n = sums[b] - sums[a] + extra
        if strengths[a] == CHARACTER and extra:  # inside a word counts need not add up
            n = len(enc.encode_ordinary(text[at : ends[b - 1]]))
            while n > limit:
                at += max(1, (starts[a] - at) // 2)
                n = len(enc.encode_ordinary(text[at : ends[b - 1]]))
        out.append((at, starts[a], ends[b - 1], n, NAMES[strengths[a]], unbroken))
        before = (a, b)
    return out


SCHEMA = "doc_id bigint, piece_no int, overlap_start bigint, start_offset bigint, end_offset bigint, n_tokens int, cut string, unbroken boolean, piece string"


def split_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, vocabulary: str | None = None) -> DataFrame:
    """Pieces of every text larger than ``limit`` tokens, as ``SCHEMA``. The spans start_offset to end_offset add up to the text.

    Smaller, null and empty texts give no rows. A null id is kept as null; repeated rows give repeated pieces. ``unbroken``:
    the text has a stretch without line break or sentence mark that is larger than the limit.
    """
    file = tokens.vocabulary(df.sparkSession, vocabulary)

    def make():
        enc = tokens.encoding(file)

        def work(ids, texts):
            for i, t in zip(ids, texts):
                pieces = split(t, enc, limit, overlap)
                if len(pieces) > 1:
                    for k, p in enumerate(pieces):
                        yield i, k, *p, t[p[0] : p[2]] if with_text else None

        return work

    # A token has at least one byte, so fewer bytes than the limit can't exceed it.
    large = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    return map_batches(spread(large), make, SCHEMA, chunk=128)
