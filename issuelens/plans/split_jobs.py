"""Whole split jobs: hold-out group, balancing, stratified split and top-up together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.operators.labels import encode_detected
from issuelens.operators.sampling import (
    HOLDOUT,
    TEST,
    TRAIN,
    _over_classes,
    _split_quota,
    mark_top_groups,
    rank_bands,
    stratified_split,
    top_groups_balanced,
)


def split_job(
    df: DataFrame,
    key_cols: Sequence[str],
    label: str = "label",
    group: str | None = None,
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` without leaks between hold-out, train and test.

    The top group's rows are the hold-out. The rest is balanced to the smaller class and
    split by class; test negatives then top the hold-out up if it has more positives than
    negatives and test has enough. All three cuts come from one ranking, so the table is
    read by key columns for the cut points and once more to write the result. Rows
    dropped by the balancing are left out. ``label`` is 0/1.
    """
    held = "__held"
    marked = (
        df.withColumn(held, F.lit(False))
        if group is None
        else mark_top_groups(df, group, label, 1, 1, held)
    )

    def cuts(totals: DataFrame) -> DataFrame:
        def held_rows(code: int):
            match = F.col(held) & (F.col(label) == code)
            return F.coalesce(F.sum(F.when(match, F.col("n"))).over(_over_classes()), F.lit(0))

        gap = held_rows(1) - held_rows(0)
        open_rows = F.when(~F.col(held), F.col("n"))
        sized = totals.withColumn(
            "__balanced", F.when(F.col(held), F.lit(0)).otherwise(F.min(open_rows).over(_over_classes()))
        )
        quota = _split_quota(sized, label, "__balanced", test_size, "__test")
        movable = (F.col(label) == 0) & (gap > 0) & (gap <= F.col("__test"))
        moved = F.when(movable, gap).otherwise(0)
        return quota.withColumns({"rank_0": moved, "rank_1": F.col("__test"), "rank_2": F.col("__balanced")})

    banded = rank_bands(marked, key_cols, [held, label], cuts, 3, seed, "__band")
    split = (
        F.when(F.col(held) | (F.col("__band") == 0), HOLDOUT)
        .when(F.col("__band") == 1, TEST)
        .when(F.col("__band") == 2, TRAIN)
    )
    return banded.withColumn("split", split).filter(F.col("split").isNotNull()).drop(held, "__band")


def split_job_overlapping(
    df: DataFrame,
    key_cols: Sequence[str],
    label: str = "label",
    group: str | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    n_groups: int = 10,
    numeric_labels: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """``(rows with split, top-group rows)``: the split covers all rows unbalanced.

    The balanced rows of the top groups are a second table, and also sit in the split.
    """
    encoded = df if numeric_labels else encode_detected(df, label)
    divided = stratified_split(encoded, key_cols, label, test_size, seed)
    if group is None:
        return divided, None
    return divided, top_groups_balanced(encoded, group, key_cols, label, n_groups, seed)
