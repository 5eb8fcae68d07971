"""Label encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.operators.small import inline_if_small

NEGATIVE_PREFIX = "non_"


@dataclass(frozen=True)
class LabelPair:
    negative: str
    positive: str

    def encode(self, label: Column) -> Column:
        """Name to 0/1; anything else becomes null."""
        return F.when(label == self.negative, 0).when(label == self.positive, 1)

    def decode(self, code: Column) -> Column:
        """0/1 to name."""
        return F.when(code == 0, self.negative).when(code == 1, self.positive)


def numeric_label(label: Column) -> Column:
    """Numeric labels as int; text that is no number raises."""
    return label.cast("int")


def one_vs_rest_label(label: Column, positive: str | None) -> Column:
    """1 for the positive category, 0 for all else and for null."""
    if positive is None:
        raise ValueError("a positive category is needed for text labels")
    return F.coalesce((label == positive).cast("int"), F.lit(0))


def detect_pair(df: DataFrame, label: str = "label") -> LabelPair:
    """Which of exactly two label names is the negative one.

    The one starting with ``non_``; if that decides nothing, the first in sort order.
    """
    found = df.select(label).filter(F.col(label).isNotNull()).distinct().limit(3).toArrow()
    names = sorted(str(v) for v in found.column(0).to_pylist())
    if len(names) != 2:
        raise ValueError("Binary classification requires exactly 2 unique labels")
    prefixed = [n for n in names if n.startswith(NEGATIVE_PREFIX)]
    if len(prefixed) == 1:
        names.sort(key=lambda n: n != prefixed[0])
    return LabelPair(*names)


def encode_detected(df: DataFrame, label: str = "label", target: str | None = None) -> DataFrame:
    """Encode the label column with the detected pair."""
    return df.withColumn(target or label, detect_pair(df, label).encode(F.col(label)))


def ordinal_codes(df: DataFrame, label: str, order_col: str) -> DataFrame:
    """``(label, code)`` with codes in order of first appearance by ``order_col``.

    The window runs over the distinct labels, after aggregation.
    """
    firsts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min(order_col).alias("__first"))
    by_first = Window.partitionBy(F.lit(0)).orderBy("__first", label)
    return firsts.select(label, (F.row_number().over(by_first) - 1).alias("code"))


def encode_ordinal(df: DataFrame, label: str, order_col: str, target: str = "label_idx") -> DataFrame:
    codes = inline_if_small(ordinal_codes(df, label, order_col)).withColumnRenamed("code", target)
    return df.join(codes, label, "left")


def label_map(df: DataFrame, name: str, code: str) -> DataFrame:
    """The ``(code, name)`` table to save next to a split."""
    return df.select(F.col(code).alias("code"), F.col(name).alias("name")).distinct()


def class_names(codes: Column, names: dict[int, str]) -> Column:
    """Index to category name through a literal map; unknown indexes give null."""
    entries = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), codes)
