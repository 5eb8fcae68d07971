"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import fresh, numbered

ROUNDS = 6
PRIME = (1 << 31) - 1


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each round, below the prime, from a fixed congruence."""
    keys, x = [], seed * 2654435761 % PRIME + 1
    for _ in range(ROUNDS):
        x = x * 48271 % PRIME
        y = x * 48271 % PRIME
        keys.append((x | 1, y))
        x = y
    return keys


def _half_bits(total: int) -> tuple[int, int]:
    bits = max(2, (max(total, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _mix(value: np.ndarray, key: tuple[int, int], bits: int) -> np.ndarray:
    x = (value * key[0] + key[1]) % PRIME
    x = (x ^ (x >> 15)) * 739982445 % PRIME
    return (x ^ (x >> 13)) & ((1 << bits) - 1)


def _once(values: np.ndarray, low: int, high: int, keys, back: bool) -> np.ndarray:
    """One pass of the network over numbers of ``low + high`` bits; the halves alternate."""
    left, right = values >> low, values & ((1 << low) - 1)
    for i, key in reversed(list(enumerate(keys))) if back else enumerate(keys):
        if i % 2 == 0:
            left = left ^ _mix(right, key, high)
        else:
            right = right ^ _mix(left, key, low)
    return left << low | right


def permute(values: np.ndarray, total: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """A permutation of 0..total-1: the network, walked until the number is below ``total``.

    The domain is less than twice ``total``, so a walk takes under two steps on average,
    and it ends since every number lies on a cycle that starts below ``total``.
    """
    low, high = _half_bits(total)
    if high > 31:
        raise ValueError("more than 2^62 rows")
    keys = round_keys(seed)
    out = _once(values.astype(np.int64), low, high, keys, back)
    while (outside := out >= total).any():
        out[outside] = _once(out[outside], low, high, keys, back)
    return out


def locate(row_no: int, total: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number, without looking at any data."""
    at = int(permute(np.array([row_no]), total, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, total: int, shards: int, seed: int = 0) -> int:
    """The row number that stands at a slot of a shard: the inverse of :func:`locate`."""
    return int(permute(np.array([slot * shards + shard]), total, seed, back=True)[0])


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Adds ``row_no``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Rows are numbered in the order of ``order``; shard sizes differ by one row at most.
    Equal rows are counted before the sort and get a copy number, so that no group of
    them has to stay together. Nulls come first; an empty table stays empty. Columns of
    ``df`` may have any names but those three, which are refused.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    columns = df.columns
    if taken := {"row_no", "shard", "slot"} & {c.lower() for c in columns}:
        raise ValueError(f"columns already there: {sorted(taken)}")
    copy = fresh(df, "_copy")
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(copy))
    spread = counted.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))))
    keys = [*order, *[c for c in columns if c not in order], copy]
    rows, total = numbered(spread, [F.col(f"`{c}`").asc_nulls_first() for c in keys])

    @F.pandas_udf("long")
    def place(row_no: pd.Series) -> pd.Series:
        return pd.Series(permute(row_no.to_numpy(), total, seed))

    at = fresh(rows, "_place")
    placed = rows.withColumn(at, place("row_no"))
    return placed.select(
        *[F.col(f"`{c}`") for c in columns],
        "row_no",
        (F.col(at) % shards).cast("int").alias("shard"),
        F.expr(f"`{at}` div {shards}").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text (null: none) plus 8. The law is ``rows``. Rows
    with the same doc_id are ordered by size and checksum, full ties are interchangeable.
    Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    return shard_rows(narrow, ["doc_id"], shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
