"""Array expressions over logits and class probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(col: Column) -> Column:
    """``col`` as it is, in a form that no filter or later column repeats.

    A column that depends on the partition stays in its projection; otherwise a filter on
    what is made of it is moved below and computes it again for each of its uses.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def softmax(logits: Column) -> Column:
    """Max-shifted softmax of an array of doubles."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(probabilities: Column) -> Column:
    """Zero-based position of the largest entry, the first one on ties."""
    position = F.array_position(probabilities, F.array_max(probabilities)) - 1
    return position.cast("int")


def round_half_even(probabilities: Column, digits: int = 3) -> Column:
    return F.transform(probabilities, lambda p: F.bround(p, digits))


def mean_arrays(arrays: Sequence[Column]) -> Column:
    """Element-wise mean of arrays of equal length."""
    return weighted_mean_arrays(arrays, [1.0] * len(arrays))


def weighted_mean_arrays(arrays: Sequence[Column], weights: Sequence[float]) -> Column:
    """Element-wise weighted mean over the arrays that are not null.

    Weights are renormalised over the arrays present in each row; the result is
    null where none is.
    """
    present = [F.when(a.isNotNull(), F.lit(float(w))).otherwise(0.0) for a, w in zip(arrays, weights)]
    weight_sum = reduce(lambda x, y: x + y, present)

    def combine(_, i):
        parts = [F.coalesce(F.get(a, i), F.lit(0.0)) * w for a, w in zip(arrays, present)]
        return reduce(lambda x, y: x + y, parts) / weight_sum

    return F.transform(F.coalesce(*arrays), combine)


def settled_means(arrays: Sequence[Column]) -> Column:
    """:func:`mean_arrays` of doubles, in which entries that rounding alone keeps apart from the largest equal it.

    A mean may be off by one rounding of every number in it, one of every sum and one of
    the quotient; a smaller distance says nothing, and its sign depends on the order of
    the arrays.
    """
    added = reduce(lambda x, y: x + y, [F.when(a.isNotNull(), 1.0).otherwise(0.0) for a in arrays])

    def entry(mean, i):
        sizes = reduce(lambda x, y: x + y, [F.abs(F.coalesce(F.get(a, i), F.lit(0.0))) for a in arrays])
        return F.struct(mean.alias("mean"), (sizes * (added + 1) / added * 2.0**-53).alias("slack"))

    entries = F.transform(mean_arrays(arrays), entry)
    best = F.array_max(entries)
    return F.transform(
        entries,
        lambda e: F.when(best["mean"] - e["mean"] < best["slack"] + e["slack"], best["mean"]).otherwise(e["mean"]),
    )


def top_classes(probabilities: Column, n: int) -> Column:
    """The ``n`` best ``(prob, idx)`` structs, best first; ties by class index."""
    ranked = F.transform(
        probabilities, lambda p, i: F.struct((-p).alias("neg"), i.alias("idx"))
    )
    return F.transform(
        F.slice(F.array_sort(ranked), 1, n),
        lambda s: F.struct((-s["neg"]).alias("prob"), s["idx"].alias("idx")),
    )
