"""Held-out test passages inside corpus texts.

Method: template canonicalisation. A text becomes a row of words in one form (case, punctuation, marks of Markdown and
footnotes, spacing and line wraps gone); figures, units and names become typed placeholders, the words so replaced its
slots. All windows of 13 words (25 for Han characters and figures) of items and texts are joined on the hash of their
template; a pair of windows is a leak where all slots agree, and a re-parameterised item where its slots differ by a
consistent renaming. Equal windows always have equal templates, so the join loses nothing.

Windows of fewer than ``LITERALS`` words outside slots would be too common as templates and are joined on their words.
Windows of texts first pass a bitmap of the items' templates, whose size is fixed, so it is sent to all tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioquarry.functions.arrow import map_batches
from folioquarry.llm import charforms
from folioquarry.session import cut_lineage, small, spread

WORDS, HAN, LITERALS = 13, 25, 4
BITS = (22, 26)  # of the bitmap: 512 KB for up to 100,000 windows of items, 8 MB at most
# Units of measure and money.
UNITS = frozenset("km m cm mm kg g mg l ml ha mile miles mile foot feet inch inches pound pounds ounce ounces ton tons shilling shillings crown crowns mark taler franc francs real reales livre livres percent prozent".split())

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WRAP = re.compile(r"[-‐­¬]\s*\n[\s>]*(?=\w)")
_NOTE = re.compile(r"\[\^[^\]\s]{1,12}\]|\[\d{1,4}\]")
_INNER = re.compile(r"(?<=[^\W\d_])[-'’](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿0-9]+")
_IDEOGRAPH = re.compile(r"[㐀-䶿一-鿿豈-﫿]")


@cache
def _unstable() -> dict[int, str]:
    """Characters to replace before canonical composition: those that aren't only composed letters."""
    return {ord(r[0]): r[2] for r in charforms.code_points() if unicodedata.normalize("NFC", r[2]) != r[0]} | {0x200C: "", 0x200D: ""}


def plain(text: str) -> str:
    """``text`` without notes, wraps and Markdown marks, in one character form and case."""
    if "\n" in text:
        text = _WRAP.sub("", text)
    if "[" in text:
        text = _NOTE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(_unstable()))
    for mark in "*`":
        if mark in text:
            text = text.replace(mark, "")
    return _INNER.sub("", text) if "-" in text or "'" in text or "’" in text else text


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text).lower())


class _Codes(dict):
    """token -> place in the arrays of template and word codes, filled as tokens come."""

    def __init__(self, ordinary: frozenset[str]):
        self.ordinary, self.template, self.word, self.literal = ordinary, [], [], []

    def __missing__(self, token: str) -> int:
        kind = "<figure>" if token.isdigit() else "<unit>" if token in UNITS else token if len(token) == 1 or token in self.ordinary else "<name>"
        self.template.append(xxhash.xxh64_intdigest(kind))
        self.word.append(xxhash.xxh64_intdigest(token, 1))
        self.literal.append(kind is token)
        self[token] = len(self.word) - 1
        return self[token]


def _tokens(text: str, han: bool) -> list[str]:
    """Words of a plain text, or the Han characters and figures of one that has any ideograph."""
    return list("".join(_HAN.findall(text))) if han and _IDEOGRAPH.search(text) else [] if han else _WORD.findall(text.lower())


def _windows(texts: list[str], codes: _Codes, han: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text number, template hash) of every window of plain texts, and all tokens; the place of a window in the first two is that of its first token."""
    size, tokens, counts = (HAN if han else WORDS), [], []
    for t in texts:
        own = _tokens(t, han) if len(t) >= size else []
        own = own if len(own) >= size else []
        tokens += own
        counts.append(len(own))
    of = np.repeat(np.arange(len(texts)), counts)
    if len(tokens) < size:
        return of[:0], np.zeros(0, np.uint64), tokens
    at = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    template, word, literal = np.array(codes.template, np.uint64)[at], np.array(codes.word, np.uint64)[at], np.array(codes.literal)[at]
    n = len(tokens) - size + 1
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(size):
        a = a * _MULTIPLIER + template[j : j + n]
        b = b * _MULTIPLIER + word[j : j + n]
    total = np.concatenate([[0], np.cumsum(literal)])
    common = total[size:] - total[:n] < LITERALS
    hashes = np.where(common, b, a)
    hashes ^= hashes >> np.uint64(29)
    return np.where(of[:n] == of[size - 1 :], of[:n], -1), hashes, tokens


_SCHEMA = "id bigint, han boolean, template bigint, at int, words string"


def _window_rows(df: DataFrame, ordinary: frozenset[str], bitmap: np.ndarray | None) -> DataFrame:
    """Windows of (id, text) rows with their place in the text; with a bitmap only those whose template is in it."""
    seen = None if bitmap is None else df.sparkSession.sparkContext.broadcast(bitmap)

    def make():
        codes, bits = _Codes(ordinary), None if seen is None else seen.value.view(np.uint8)

        def work(ids: list, texts: list):
            if len(codes) > 1_000_000:
                codes.clear(), codes.template.clear(), codes.word.clear(), codes.literal.clear()
            plains = [plain(t) if t else "" for t in texts]
            for han in (False, True):
                of, hashes, tokens = _windows(plains, codes, han)
                keep = of >= 0
                if bits is not None and len(of):
                    slot = hashes & np.uint64(len(bits) * 8 - 1)
                    keep &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                size = HAN if han else WORDS
                if not keep.any():
                    continue
                begin = np.maximum.accumulate(np.where(np.diff(of, prepend=-2) != 0, np.arange(len(of)), 0))
                for k in np.flatnonzero(keep).tolist():
                    yield ids[of[k]], han, int(hashes[k].view(np.int64)), k - int(begin[k]), " ".join(tokens[k : k + size])

        return work

    return map_batches(df, make, _SCHEMA)


def _lexicon(items: DataFrame, text: str) -> frozenset[str]:
    """Ordinary words: all that are written in lower case anywhere in the items. The driver and the tasks hold each once."""
    found = items.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{M}\p{N}])\p{Ll}[\p{L}\p{M}]*"), F.lit(0))).alias("w")).distinct().toPandas()["w"]
    return frozenset(w for x in found for w in words(x))


def _bitmap(of_items: DataFrame) -> np.ndarray:
    """Which templates occur, by their lowest bits; the size follows the number of windows up to a bound."""
    bits = min(BITS[1], max(BITS[0], (of_items.count() * 40).bit_length()))
    slots = of_items.select(F.col("template").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot"))
    found = slots.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits")).toPandas()  # at most 2**bits / 64 rows
    out = np.zeros((1 << bits) // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _both(documents: DataFrame, items: DataFrame, ordinary: frozenset[str], names: tuple[str, str, str, str]) -> tuple[DataFrame, DataFrame]:
    """Windows of the items, and those of the documents that may have an item's template."""
    doc_id, text, item_id, passage = names
    of_items = cut_lineage(_window_rows(items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("id"), F.col(passage).alias("text")), ordinary, None))
    long = documents.where(F.col(doc_id).isNotNull() & (F.length(text) >= HAN)).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return of_items, _window_rows(spread(long), ordinary, _bitmap(of_items))


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id): documents that hold at least 13 consecutive words (25 Han characters and figures) of an item.

    Rows with a null id or text match nothing; repeated rows count once. A window of Han characters has at least one ideograph in its text.
    """
    of_items, of_docs = _both(documents, items, _lexicon(items, passage), (doc_id, text, item_id, passage))
    at = ["han", "template", "words"]
    pairs = of_docs.select(F.col("id").alias("doc_id"), *at).join(of_items.select(F.col("id").alias("item_id"), *at).distinct(), at)
    return pairs.select("doc_id", "item_id").distinct()


def item_classes(items: DataFrame, item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(item_id, class_id, members): items that differ only by a consistent renaming of their slots form one class, named by its least id.

    Which words are slots is told by the lexicon of all items. Null ids and null or empty passages are left out; repeated rows
    count once.
    """
    ordinary = _lexicon(items, passage)

    def make():
        def work(ids, texts):
            for i, t in zip(ids, texts):
                yield i, xxhash.xxh3_128_hexdigest("\x1f".join(_numbered(t, ordinary)))

        return work

    rows = items.where(F.col(item_id).isNotNull() & (F.col(passage) != "")).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(passage).alias("passage"))
    forms = cut_lineage(map_batches(rows, make, "item_id bigint, form string").distinct())
    whole = forms.groupBy("form").agg(F.min("item_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    return forms.join(whole, "form").select("item_id", "class_id", "members")


def _numbered(text: str, ordinary: frozenset[str]) -> list[str]:
    """The tokens of a passage, each slot as its type and its number by first use: equal rows differ by a consistent renaming only."""
    text, slots = plain(text), {}
    codes = _Codes(ordinary)
    tokens = _tokens(text, True) if _IDEOGRAPH.search(text) else _tokens(text, False)
    return [t if codes.literal[codes[t]] else f"<{codes.template[codes[t]]:x}:{slots.setdefault(t, len(slots))}>" for t in tokens]


def reparameterised_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, class_id, windows, classes, items): one row for each document with the wording of items about other names or figures.

    ``class_id`` is the class of items (see ``item_classes``) shown by most consecutive windows, ``windows`` their number, ``classes``
    and ``items`` how many classes and items the document is linked to.

    Documents are compared with the first item of each class only. Windows that follow one another in both texts are one run;
    within it every slot value of the item must stand for one value of the document and the other way round. A class whose
    longest run has the first item's own values counts for its other members only.
    """
    classes = cut_lineage(item_classes(items, item_id, passage))
    first = classes.where("item_id = class_id").select("class_id", "members")
    keyed = items.withColumn("_fq_id", F.col(item_id).cast("bigint"))
    chosen = keyed.join(first.select(F.col("class_id").alias("_fq_id")), "_fq_id", "left_semi").select(F.col("_fq_id").alias("item"), F.col(passage).alias("passage")).dropDuplicates(["item"])
    of_items, of_docs = _both(documents, chosen, _lexicon(items, passage), (doc_id, text, "item", "passage"))
    at = ["han", "template"]
    pairs = of_docs.select(F.col("id").alias("doc_id"), *at, "at", "words").join(small(of_items.select(F.col("id").alias("class_id"), *at, F.col("at").alias("item_at"), F.col("words").alias("item_words"))), at)
    cut = lambda w: F.when(F.col("han"), F.regexp_extract_all(w, F.lit("[^ ]"), F.lit(0))).otherwise(F.split(w, " "))
    run = ["doc_id", "class_id", "han", "shift"]
    slots = pairs.select(*run[:3], (F.col("at") - F.col("item_at")).alias("shift"), "item_at", F.explode(F.arrays_zip(cut(F.col("item_words")).alias("i"), cut(F.col("words")).alias("d"))).alias("p"))
    told = slots.groupBy(*run, "p.i", "p.d").agg(F.min("item_at").alias("a"), F.max("item_at").alias("z"))
    fit = told.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i").alias("ni"), F.count_distinct("d").alias("nd"), F.bool_and(F.col("i") == F.col("d")).alias("verbatim"), (F.max("z") - F.min("a") + 1).alias("windows"))
    links = fit.where("n = ni AND n = nd").groupBy("doc_id", "class_id").agg(F.max_by("verbatim", F.struct("windows", "shift")).alias("verbatim"), F.max("windows").cast("bigint").alias("windows"))
    counted = links.join(small(first), "class_id").withColumn("items", F.col("members") - F.col("verbatim").cast("int")).where("items > 0")
    return counted.groupBy("doc_id").agg(F.max_by("class_id", F.struct("windows", -F.col("class_id"))).alias("class_id"), F.max("windows").alias("windows"), F.count(F.lit(1)).alias("classes"), F.sum("items").alias("items"))
