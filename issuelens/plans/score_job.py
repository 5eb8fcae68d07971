"""Score a table and, where truth is known, evaluate it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.functions.text import null_to_empty
from issuelens.operators.metrics import compute_metrics
from issuelens.operators.relational import require_columns
from issuelens.operators.scoring import add_prediction
from issuelens.session import materialize


def predict_table(df: DataFrame, score: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """The original columns plus predicted_class, predicted_probability, class_probabilities.

    ``score`` adds ``class_probabilities`` to a frame, as the scoring operators do.
    """
    require_columns(df, text)
    filled = df.withColumn(text, null_to_empty(F.col(text)))
    return add_prediction(score(filled))


def predict_and_evaluate(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], text: str = "text", label: str = "label"
) -> tuple[DataFrame, DataFrame | None]:
    """``(predictions, metrics)``; metrics is None without a label column.

    Predictions are written once, so evaluating them does not score twice.
    """
    predictions = materialize(predict_table(df, score, text), "predictions")
    return predictions, compute_metrics(predictions, label) if label in df.columns else None
