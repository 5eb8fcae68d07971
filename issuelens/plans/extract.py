"""Issue bodies to a clean text table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from issuelens.functions.text import text_hash, with_clean_text
from issuelens.operators.relational import (
    drop_null_rows,
    keep_first_by_text,
    keep_min_length,
    project_text,
    require_columns,
)
from issuelens.session import materialize

DIGEST = "__digest"


def extract_texts(
    issues: DataFrame,
    body: str = "body",
    key_cols: Sequence[str] = ("number",),
    min_length: int = 20,
    drop_duplicates: bool = True,
    keep: Sequence[str] = ("number", "title"),
    counters: dict[str, Observation] | None = None,
) -> DataFrame:
    """Null filter, cleaning, length filter, de-duplication and projection.

    Only needed columns are read. For the de-duplication the cleaned texts are written once
    with their digests, so cleaning runs once and no text is shuffled. ``counters`` may hold observations named ``read``, ``cleaned`` and
    ``kept``; they count rows while the job runs, without a job of their own.
    Observe in a session that trains no models afterwards (``newSession()``): Spark keeps
    a manager there that ML closures fail to serialize.
    """
    require_columns(issues, body, *key_cols)
    needed = dict.fromkeys([*key_cols, *[c for c in keep if c in issues.columns], body])
    rows = _observe(issues.select(*needed), "read", counters)
    cleaned = with_clean_text(drop_null_rows(rows, body), body, "text")
    cleaned = cleaned.drop(*[c for c in (body,) if c != "text"])
    long_enough = _observe(keep_min_length(cleaned, "text", min_length), "cleaned", counters)
    if drop_duplicates:
        written = materialize(long_enough.withColumn(DIGEST, text_hash(F.col("text"))), "cleaned")
        long_enough = keep_first_by_text(written, "text", key_cols, DIGEST).drop(DIGEST)
        long_enough = _observe(long_enough, "kept", counters)
    return project_text(long_enough, "text", keep)


def _observe(df: DataFrame, name: str, counters: dict[str, Observation] | None) -> DataFrame:
    if not counters or name not in counters:
        return df
    return df.observe(counters[name], F.count(F.lit(1)).alias("rows"))
