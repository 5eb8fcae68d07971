"""Join sides of a checked size."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE_ROWS = 10_000
INLINE_BYTES = 8 << 20
FIRST_LOOK = 64
SIDE_ROWS = 1 << 18


def small_rows(df: DataFrame, max_rows: int = INLINE_ROWS, max_bytes: int = INLINE_BYTES) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows`` of at most ``max_bytes`` bytes, else None.

    A few rows are fetched first; more only if rows of their size would stay within the
    limit.
    """
    look = min(FIRST_LOOK, max_rows + 1)
    rows = df.take(look)
    if len(rows) == look:
        each = len(pickle.dumps(rows)) / len(rows)
        if each * look > max_bytes:
            return None
        max_rows = min(max_rows, int(max_bytes / each) + look)
        rows = df.take(max_rows + 1)
    return None if len(rows) > max_rows or len(pickle.dumps(rows)) > max_bytes else rows


def inline_if_small(df: DataFrame, max_rows: int = INLINE_ROWS, max_bytes: int = INLINE_BYTES) -> DataFrame:
    """``df`` as a broadcast local table if it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    A larger side comes back as it was, without a hint, so the join shuffles and
    adaptive execution splits any skewed partition.
    """
    rows = small_rows(df, max_rows, max_bytes)
    return df if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join, whatever size Spark believes either side has.

    Spark's choice goes by the bytes of files and by the types of columns: a list counts as one
    value, so a side looks too small after an explode, and a broadcast takes several times the
    bytes of a compressed file in the driver.
    """
    return df.hint("merge")


def side_of(df: DataFrame, max_rows: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """How ``df``, stored and narrow, and tables of as many rows go into a join: broadcast if there
    are at most ``max_rows`` rows (None: ``SIDE_ROWS``, some 30 MB of pairs of numbers in the
    driver), else :func:`shuffled`."""
    max_rows = SIDE_ROWS if max_rows is None else max_rows
    return F.broadcast if df.limit(max_rows + 1).count() <= max_rows else shuffled


def sized(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``df`` as a join side by its number of rows, see :func:`side_of`."""
    return side_of(df, max_rows)(df)
