"""Token counts of a public byte-level tokenizer; its vocabulary file is a parameter and is never copied."""

from __future__ import annotations

import base64
from functools import lru_cache

import tiktoken
from pyspark.sql import SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which this family of vocabularies cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(spark: SparkSession, path: str | None = None) -> bytes:
    """The vocabulary file (under 1 MB), read by the driver and sent along with tasks, so executors need no copy of it.

    ``path``, else the session's ``spark.folioquarry.vocabulary``, else ``VOCABULARY``.
    """
    with open(path or spark.conf.get("spark.folioquarry.vocabulary", VOCABULARY), "rb") as f:
        return f.read()


@lru_cache(2)
def encoding(file: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
