"""Keeping chosen rows of a wide table by narrow keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import fresh, null_safe
from issuelens.operators.small import shuffled, sized
from issuelens.session import materialize

KEYS = ("id_key", "text_key")
BITS = 1 << 24


def row_keys() -> list[Column]:
    """A row's id (nulls first, never null) and a digest of its text."""
    return [null_safe("doc_id").alias("id_key"), F.xxhash64("text", F.octet_length("text")).alias("text_key")]


def sifted(rows: DataFrame, names: Sequence[str], keys: DataFrame, write: Callable, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is surely not in ``keys``, and the others, each in its scan.

    Both are told apart by a bitmap of the keys' hashes, sent as a table of ``bits`` / 64
    rows at most. A full bitmap only puts more rows in the second part; it is for the
    caller to look at those exactly.
    """
    word, held = fresh(rows, "__word"), fresh(rows, "__held")

    def slot(frame: DataFrame) -> Column:
        return F.pmod(F.xxhash64(*[frame[f"`{n}`"] for n in names]), F.lit(bits))

    def mask(frame: DataFrame) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), slot(frame).bitwiseAND(63).cast("int"))

    table = keys.select(F.shiftright(slot(keys), 6).alias(word), mask(keys).alias(held))
    table = write(table.groupBy(word).agg(F.bit_or(held).alias(held)), "sift")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    hit = F.coalesce(F.col(held).bitwiseAND(mask(rows)) != 0, F.lit(False))
    met = rows.withColumn(word, F.shiftright(slot(rows), 6)).join(F.broadcast(table), word, "left")
    return met.where(~hit).select(*columns), met.where(hit).select(*columns)


def keep_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each key pair in ``chosen``, all columns as they were.

    Rows that go, and rows that repeat an id and a text, are found on the narrow keys.
    Most other rows stay in the scan; only what the bitmap of those keys holds is joined.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = [fresh(docs, f"__{k}") for k in KEYS]
    keyed = docs.select(*columns, *[c.alias(n) for c, n in zip(row_keys(), names)])
    chosen = chosen.select(*[F.col(k).alias(n) for k, n in zip(KEYS, names)]).distinct().withColumn("kept", F.lit(True))
    rows = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).join(shuffled(chosen), names, "left")
    touched = materialize(rows.where("kept IS NULL OR n > 1").select(*names, F.expr("kept IS NOT NULL AS kept")), "touched")
    alone, others = sifted(keyed, names, touched.select(*names), materialize)
    kept = alone.unionByName(others.join(sized(touched.select(*names)), names, "left_anti"))
    repeated = touched.where("kept").select(*names)
    if not repeated.isEmpty():
        kept = kept.unionByName(others.join(sized(repeated), names, "left_semi").dropDuplicates(names))
    return kept.select(*columns)
