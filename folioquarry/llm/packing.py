"""Containers of fixed capacity filled with texts.

Method: best-two-fit. A container is filled greedily with the largest text that fits; then its smallest text makes way
for two unpacked ones that fill the gap better, for as long as that helps. Texts are dealt at random (by hash) to shards
of about ``SHARD_TOKENS`` tokens that are packed side by side; a shard leaves at most one container partly filled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, functions as F

from folioquarry.functions.arrow import map_batches
from folioquarry.llm import tokens
from folioquarry.session import spread

CAPACITY = 2048
SHARD_TOKENS, SHARD_ROWS = 2_000_000, 50_000
REPEATS = 10_000  # equal rows that are numbered at a time


def _at_most(sizes: int, x: int) -> int:
    """The largest size of the bit set ``sizes`` that is at most ``x``; 0 if none."""
    return max(0, (sizes & ((2 << x) - 1)).bit_length() - 1) if x > 0 else 0


def best_two_fit(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The container of each item. Sizes are 0 to ``capacity``; items of size 0 go into container 0."""
    of = [0] * len(sizes)
    free: dict[int, list[int]] = {}
    for k in range(len(sizes) - 1, -1, -1):
        if sizes[k]:
            free.setdefault(sizes[k], []).append(k)
    have = sum(1 << s for s in free)
    bin_no = 0

    def take(s: int) -> int:
        nonlocal have
        k = free[s].pop()
        if not free[s]:
            have ^= 1 << s
        return k

    def give(s: int, k: int) -> None:
        nonlocal have
        free[s].append(k)
        have |= 1 << s

    while have:
        inside, gap = [], capacity
        while s := _at_most(have, gap):
            inside.append((s, take(s)))
            gap -= s
        while gap and inside:
            small, item = min(inside)
            room, best = gap + small, (small, 0, 0)
            a = _at_most(have, room - 1)
            while a * 2 > best[0] and a:  # b is at most a, so smaller a can't win any more
                b = _at_most(have, min(a, room - a))
                if b == a and len(free[a]) < 2:
                    b = _at_most(have, a - 1)
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = _at_most(have, a - 1)
            if not best[1]:
                break
            inside.remove((small, item))
            inside += [(best[1], take(best[1])), (best[2], take(best[2]))]
            give(small, item)
            gap = room - best[0]
        for _, k in inside:
            of[k] = bin_no
        bin_no += 1
    return of


def cut_by_capacity(text: str, ids: list[int], lengths: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of the parts of a text whose tokens exceed ``capacity``: full ones, then the rest; no character is divided."""
    raw = text.encode()
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])
    a = start = 0
    while a < len(ids):
        b = min(a + capacity, len(ids))
        while b > a + 1 and b < len(ids) and raw[ends[b]] & 0xC0 == 0x80:
            b -= 1
        end = start + len(raw[ends[a] : ends[b]].decode("utf-8", "ignore"))
        yield start, end if b < len(ids) else len(text), b - a
        a, start = b, end


def _lengths(enc: tiktoken.Encoding) -> np.ndarray:
    out = np.zeros(enc.n_vocab, np.int64)
    for b in enc.token_byte_values():
        out[enc.encode_single_token(b)] = len(b)
    return out


def pack_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece_no, start_offset, end_offset, n_tokens, container_id): the container of every text, or of each part of a text above capacity.

    Null and empty texts have 0 tokens and take no room. Null ids are kept; every row of ``df``, repeated or not, is placed.
    """
    file = tokens.vocabulary(df.sparkSession, vocabulary)
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # About 3.5 bytes a token; the number of shards only has to keep them of bounded size.
    shards = max(1, math.ceil(size[1] / (3.5 * SHARD_TOKENS)), math.ceil(size[0] / SHARD_ROWS))

    def make():
        enc = tokens.encoding(file)
        lengths = _lengths(enc)

        def work(ids, texts):
            for i, t in zip(ids, texts):
                codes = enc.encode_ordinary(t) if t else []
                if len(codes) <= capacity:
                    yield i, 0, 0, len(t or ""), len(codes)
                else:
                    for k, (a, b, n) in enumerate(cut_by_capacity(t, codes, lengths, capacity)):
                        yield i, k, a, b, n

        return work

    sized = map_batches(spread(rows), make, "doc_id bigint, piece_no int, start_offset bigint, end_offset bigint, n_tokens int")

    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n_tokens", "doc_id", "piece_no", "start_offset", "end_offset"], kind="stable")
        return items.assign(container_id=np.array(best_two_fit(items["n_tokens"].tolist(), capacity), np.int64) + (key[0] << 32))[[*items.columns[:-1], "container_id"]]

    # Rows are dealt by what they hold and by their number among equal rows, which are interchangeable: a task that runs again
    # deals alike, one id with many rows fills no shard, and containers are the same in every run.
    columns = ["doc_id", "piece_no", "start_offset", "end_offset", "n_tokens"]
    counted = sized.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEATS).cast("bigint"))))
    each = blocks.withColumn("k", F.explode(F.sequence(F.col("block") * REPEATS, F.least(F.col("n"), (F.col("block") + 1) * REPEATS) - 1)))
    dealt = each.select(*columns, F.pmod(F.xxhash64(*columns, "k"), F.lit(shards)).cast("bigint").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(pack, "doc_id bigint, piece_no int, start_offset bigint, end_offset bigint, n_tokens int, container_id bigint")
