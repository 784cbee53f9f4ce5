"""Spans that must survive a rewriting of the text: masked by numbered tokens and put back after it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T

# What is protected, tried in this order.
KINDS = {
    "code": r"```.*?```|`[^`\n]+`", "tag": r"</?[A-Za-z][^<>]*>", "link": r"!?\[[^\]\n]*\]\([^()\n]*\)", "url": r"https?://[^\s<>\"）)]+", "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "footnote": r"\[\^[^\]\s]+\]", "math": r"\$[^$\n]+\$", "variable": r"\{\{[^{}]*\}\}|\{[A-Za-z_]\w*\}|%[sd]",
    "doi": r"(?i:\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b)", "citation": r"\([^()\n]{0,100}\b(?:1[5-9]|20)\d{2}[a-z]?[^()\n]{0,60}\)", "reference": r"\[\d{1,4}(?:\s*[-,;]\s*\d{1,4})*\]",
}
_TOKEN = "⟦{}⟧"
_SPAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()) + r"|(?P<literal>⟦\d+⟧)", re.DOTALL)
_MARK = re.compile(r"⟦(\d+)⟧")


def mask(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(masked text, [(kind, span)]); the n-th span stands as token n. Tokens already in the text are spans too."""
    spans: list[tuple[str, str]] = []

    def put(m: re.Match) -> str:
        spans.append((m.lastgroup, m[0]))
        return _TOKEN.format(len(spans) - 1)

    return _SPAN.sub(put, text), spans


def restore(text: str, spans: list[str]) -> str | None:
    """``text`` with its spans put back; None where a token is unknown, missing or repeated."""
    seen = [int(x) for x in _MARK.findall(text)]
    if sorted(seen) != list(range(len(spans))):
        return None
    return _MARK.sub(lambda m: spans[int(m[1])], text)


_MASKED = T.StructType([T.StructField("masked", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StringType()))])


@F.pandas_udf(_MASKED)
def masked(texts: pd.Series) -> pd.DataFrame:
    """``mask`` as a column; null gives nulls."""
    rows = [(None, None, None) if t is None else (m[0], [k for k, _ in m[1]], [s for _, s in m[1]]) for t in texts for m in [mask(t) if t is not None else None]]
    return pd.DataFrame(rows, columns=["masked", "kinds", "spans"])


@F.pandas_udf(T.StringType())
def restored(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or s is None else restore(t, list(s)) for t, s in zip(texts, spans)])
