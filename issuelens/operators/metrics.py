"""Evaluation of predictions against truth.

Counts come from one aggregation; all ratios are arithmetic on them. Curves need
running totals over ordered scores. Those run per score range, with the totals of
lower ranges added from a small per-range table, so no task sees all scores.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.functions.arrays import argmax
from issuelens.operators.labels import detect_pair

SCORE_RANGES = 1024
LEAST_PROBABILITY = 1e-15


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0.0 for a zero denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def confusion_counts(
    df: DataFrame, label: str = "label", predicted: str = "predicted_class", by: Sequence[str] = ()
) -> DataFrame:
    """tn, fp, fn, tp per group; rows without truth or prediction do not count."""

    def cell(truth: int, guess: int, name: str) -> Column:
        return F.count(F.when((F.col(label) == truth) & (F.col(predicted) == guess), 1)).alias(name)

    return df.groupBy(*by).agg(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))


def binary_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, MCC and the matrix from a counts table."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "mcc": _ratio(tp * tn - fp * fn, spread),
            "confusion_matrix": matrix,
        }
    ).drop("tn", "fp", "fn", "tp")


def align_encodings(df: DataFrame, label: str = "label", predicted: str = "predicted_class") -> DataFrame:
    """Bring text labels and predictions to 0/1 whichever side is text."""
    types = dict(df.dtypes)
    named = [c for c in (label, predicted) if types[c] == "string"]
    if not named:
        return df
    pair = detect_pair(df, named[0])
    return df.withColumns({c: pair.encode(F.col(c)) for c in named})


def _score_splits(df: DataFrame, score: str, ranges: int) -> list[float]:
    """Range limits that hold about equally many rows each; at most ``ranges`` + 1 numbers."""
    steps = [i / ranges for i in range(1, ranges)]
    limits = df.approxQuantile(score, steps, 1.0 / (2 * ranges))
    inner = sorted({x for x in limits if math.isfinite(x)})
    return [-math.inf, *inner, math.inf]


def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str], ranges: int) -> DataFrame:
    """(by, score, pos, neg, __range) with running in-range totals tp and fp, high to low.

    Equal scores collapse before the first shuffle; each window holds one score range.
    Rows with a missing or NaN score, or a label other than 0 and 1, do not count.
    """
    rows = df.select(*by, F.col(label).alias("__y"), F.col(score).cast("double").alias(score))
    rows = rows.filter(F.col("__y").isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score))
    splits = _score_splits(rows, score, ranges)
    counts = rows.groupBy(*by, score).agg(
        F.count(F.when(F.col("__y") == 1, 1)).alias("pos"),
        F.count(F.when(F.col("__y") == 0, 1)).alias("neg"),
    )
    if len(splits) > 2:
        counts = Bucketizer(splits=splits, inputCol=score, outputCol="__range").transform(counts)
    else:
        counts = counts.withColumn("__range", F.lit(0.0))
    inside = Window.partitionBy(*by, "__range").orderBy(F.desc(score))
    return counts.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)})


def _higher_ranges(by: Sequence[str]):
    """Windows over per-range tables: the ranges from the top down, and all of them."""
    group = list(by) or [F.lit(0)]
    return Window.partitionBy(*group).orderBy(F.desc("__range")), Window.partitionBy(*group)


def score_curve(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    ranges: int = SCORE_RANGES,
) -> DataFrame:
    """Per distinct score, high to low: positives and negatives at and above it.

    Columns: ``by``, score, pos, neg (at this score), tp, fp (at this score or
    higher), n_pos, n_neg (all).
    """
    counts = _score_counts(df, label, score, by, ranges)
    above, whole = _higher_ranges(by)
    per_range = (
        counts.groupBy(*by, "__range")
        .agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))
        .select(
            *by,
            "__range",
            (F.sum("__pos").over(above) - F.col("__pos")).alias("__tp"),
            (F.sum("__neg").over(above) - F.col("__neg")).alias("__fp"),
            F.sum("__pos").over(whole).alias("n_pos"),
            F.sum("__neg").over(whole).alias("n_neg"),
        )
    )
    # Null-safe on the grouping columns, so a null group keeps its curve.
    left, right = counts.alias("c"), per_range.alias("r")
    same = F.col("c.__range") == F.col("r.__range")
    for g in by:
        same = same & F.col(f"c.{g}").eqNullSafe(F.col(f"r.{g}"))
    return left.join(right, same).select(
        *[F.col(f"c.{g}").alias(g) for g in by],
        score,
        "pos",
        "neg",
        (F.col("tp") + F.col("__tp")).alias("tp"),
        (F.col("fp") + F.col("__fp")).alias("fp"),
        "n_pos",
        "n_neg",
    )


def roc_auc(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    ranges: int = SCORE_RANGES,
) -> DataFrame:
    """Area under the ROC curve, ties counting half; null where one class is missing.

    Every negative counts the positives above it: those in its own range, and all of the
    higher ranges'. The second part needs the per-range sums only, so nothing is joined.
    """
    counts = _score_counts(df, label, score, by, ranges)
    above, _ = _higher_ranges(by)
    own = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0))
    per_range = counts.groupBy(*by, "__range").agg(
        own.alias("__own"), F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg")
    )
    higher = (F.sum("__pos").over(above) - F.col("__pos")).cast("double")
    wins = per_range.withColumn("__wins", F.col("__own") + F.col("__neg") * higher)
    pairs = F.sum("__pos").cast("double") * F.sum("__neg").cast("double")
    return wins.groupBy(*by).agg(F.try_divide(F.sum("__wins"), pairs).alias("roc_auc"))


def _with_end_point(curve: DataFrame, by: Sequence[str], point: Mapping, end: Mapping) -> DataFrame:
    """Curve points, plus the end point next to each group's highest score."""
    is_highest = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    own = F.struct(*[value.alias(name) for name, value in point.items()])
    extra = F.struct(*[F.lit(value).cast("double").alias(name) for name, value in end.items()])
    return curve.select(*by, F.inline(F.when(is_highest, F.array(extra, own)).otherwise(F.array(own))))


def roc_curve(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    ranges: int = SCORE_RANGES,
) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score and the start point (null, 0, 0)."""
    point = {
        "threshold": F.col(score),
        "fpr": F.try_divide(F.col("fp").cast("double"), F.col("n_neg")),
        "tpr": F.try_divide(F.col("tp").cast("double"), F.col("n_pos")),
    }
    curve = score_curve(df, label, score, by, ranges)
    return _with_end_point(curve, by, point, {"threshold": None, "fpr": 0.0, "tpr": 0.0})


def pr_curve(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    ranges: int = SCORE_RANGES,
) -> DataFrame:
    """(threshold, precision, recall) and the end point (null, 1, 0)."""
    point = {
        "threshold": F.col(score),
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
        "recall": F.try_divide(F.col("tp").cast("double"), F.col("n_pos")),
    }
    curve = score_curve(df, label, score, by, ranges)
    return _with_end_point(curve, by, point, {"threshold": None, "precision": 1.0, "recall": 0.0})


def pr_auc(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    ranges: int = SCORE_RANGES,
) -> DataFrame:
    """Trapezoid area under the precision-recall curve.

    A point's predecessor is its own running count minus its own rows, so no
    neighbour lookup is needed.
    """
    curve = score_curve(df, label, score, by, ranges)
    tp, seen = F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")
    before_tp = tp - F.col("pos")
    before_seen = seen - F.col("pos") - F.col("neg")
    before = F.when(before_seen > 0, F.try_divide(before_tp, before_seen)).otherwise(1.0)
    slice_area = F.col("pos") * (tp / seen + before) / 2.0
    return curve.groupBy(*by).agg(
        F.try_divide(F.sum(slice_area), F.max("n_pos").cast("double")).alias("pr_auc")
    )


def explode_classes(
    df: DataFrame, label: str = "label", probabilities: str = "class_probabilities", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per class: (class, y, score), y = 1 where the class is the truth."""
    return df.select(*keep, F.col(label).alias("__truth"), F.posexplode(probabilities).alias("class", "score")).select(
        *keep, "class", (F.col("__truth") == F.col("class")).cast("int").alias("y"), "score"
    )


def one_vs_rest_auc(
    df: DataFrame, label: str = "label", probabilities: str = "class_probabilities"
) -> DataFrame:
    return roc_auc(explode_classes(df, label, probabilities), "y", "score", by=["class"])


def one_vs_rest_roc(
    df: DataFrame, label: str = "label", probabilities: str = "class_probabilities"
) -> DataFrame:
    return roc_curve(explode_classes(df, label, probabilities), "y", "score", by=["class"])


def confusion_matrix(
    df: DataFrame, label: str = "label", predicted: str = "predicted_class", n_classes: int | None = None
) -> DataFrame:
    """(label, predicted, n) cells, dense over ``n_classes`` if given."""
    cells = (
        df.select(F.col(label).cast("int").alias("label"), F.col(predicted).cast("int").alias("predicted"))
        .dropna()
        .groupBy("label", "predicted")
        .agg(F.count("*").alias("n"))
    )
    if n_classes is None:
        return cells
    codes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    grid = (
        df.sparkSession.range(1)
        .select(F.explode(codes).alias("label"))
        .select("label", F.explode(codes).alias("predicted"))
    )
    return grid.join(cells, ["label", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def confusion_from_probabilities(
    df: DataFrame, n_classes: int, label: str = "label", probabilities: str = "class_probabilities"
) -> DataFrame:
    return confusion_matrix(df.withColumn("__p", argmax(F.col(probabilities))), label, "__p", n_classes)


def compute_metrics(
    df: DataFrame,
    label: str = "label",
    predicted: str = "predicted_class",
    probabilities: str | None = "class_probabilities",
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per group: accuracy, precision, recall, f1, mcc, confusion_matrix, roc_auc.

    ``roc_auc`` uses the positive-class probability and is there when the
    probability column is.
    """
    aligned = align_encodings(df, label, predicted)
    scores = binary_scores(confusion_counts(aligned, label, predicted, by))
    if probabilities is None or probabilities not in df.columns:
        return scores
    scored = aligned.withColumn("__score", F.get(probabilities, F.lit(1)))
    areas = roc_auc(scored, label, "__score", by)
    if not by:
        return scores.withColumn("roc_auc", areas.scalar())
    left, right = scores.alias("s"), areas.alias("a")
    same = F.lit(True)
    for g in by:
        same = same & F.col(f"s.{g}").eqNullSafe(F.col(f"a.{g}"))
    return left.join(right, same, "left").select("s.*", "a.roc_auc")


def classification_report(
    df: DataFrame, label: str = "label", predicted: str = "predicted_class", digits: int = 3
) -> DataFrame:
    """Per class precision, recall, f1 and support, then accuracy, macro and weighted rows.

    The accuracy row repeats the accuracy in every column, as the usual report does.
    """
    cells = confusion_matrix(df, label, predicted)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("code"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("guessed")),
        F.struct(F.col("predicted").alias("code"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("guessed")),
    )
    per_class = (
        cells.select(F.inline(sides))
        .groupBy("code")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed"))
        .select(
            F.col("code").cast("string").alias("class"),
            _ratio(F.col("tp"), F.col("guessed")).alias("precision"),
            _ratio(F.col("tp"), F.col("support")).alias("recall"),
            _ratio(2 * F.col("tp"), F.col("guessed") + F.col("support")).alias("f1_score"),
            F.col("support").cast("double").alias("support"),
            "tp",
        )
    )
    scores = ["precision", "recall", "f1_score"]
    total = F.sum("support")
    accuracy = F.sum("tp") / total
    summary = per_class.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(c) for c in scores], accuracy.alias("support")),
            F.struct(
                F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in scores], total.alias("support")
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in scores],
                total.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    report = per_class.drop("tp").unionByName(summary)
    return report.withColumns({c: F.bround(c, digits) for c in [*scores, "support"]})


def t_critical(confidence: float, freedom: int) -> float:
    """Two-sided critical value of Student's t distribution.

    With t = sqrt(freedom) * tan(a) the density turns into cos(a)**(freedom - 1) on a
    finite interval, integrated by Simpson's rule and inverted by bisection.
    """

    def area(limit: float, steps: int = 400) -> float:
        h = limit / steps
        values = [math.cos(i * h) ** (freedom - 1) for i in range(steps + 1)]
        return h / 3 * (values[0] + values[-1] + 4 * sum(values[1:-1:2]) + 2 * sum(values[2:-1:2]))

    goal = confidence / 2 * math.exp(math.lgamma(freedom / 2) - math.lgamma((freedom + 1) / 2)) * math.sqrt(math.pi)
    low, high = 0.0, math.pi / 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if area(middle) < goal else (low, middle)
    return math.sqrt(freedom) * math.tan(low)


def kfold_summary(
    metrics: DataFrame, n_folds: int, confidence: float = 0.95, sample_std: bool = False
) -> DataFrame:
    """(metric, mean, std, ci_lower, ci_upper) from (fold, metric, value) rows.

    ``std`` is the population figure unless ``sample_std`` is set.
    """
    spread = F.stddev_samp("value") if sample_std else F.stddev_pop("value")
    half = F.lit(t_critical(confidence, n_folds - 1)) * F.col("std") / F.sqrt(F.lit(float(n_folds)))
    return (
        metrics.groupBy("metric")
        .agg(F.avg("value").alias("mean"), spread.alias("std"))
        .withColumns({"ci_lower": F.col("mean") - half, "ci_upper": F.col("mean") + half})
    )


def long_metrics(scores: DataFrame, fold: str = "fold") -> DataFrame:
    """Per-fold metric columns to (fold, metric, value) rows."""
    names = [c for c in ("accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "loss") if c in scores.columns]
    return scores.unpivot(fold, names, "metric", "value")


def weighted_log_loss(
    df: DataFrame,
    label: str = "label",
    probabilities: str = "class_probabilities",
    class_weights: Mapping[int, float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Class-weighted mean of -log p(truth); a plain mean without weights.

    A probability of zero counts as 1e-15, so a wrong certain answer costs much but not
    everything. Rows without a label, or without a probability for it, do not count.
    """
    p = F.get(probabilities, F.col(label))
    nll = -F.log(F.greatest(p, F.lit(LEAST_PROBABILITY)))
    weight = F.lit(1.0)
    if class_weights is not None:
        entries = [F.lit(x) for c, w in class_weights.items() for x in (c, float(w))]
        weight = F.try_element_at(F.create_map(*entries), F.col(label))
    weight = F.when(p.isNotNull(), weight)
    return df.groupBy(*by).agg(F.try_divide(F.sum(weight * nll), F.sum(weight)).alias("loss"))
