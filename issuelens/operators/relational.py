"""Filters, projections, exact de-duplication and debt reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.functions.text import text_hash, word_count
from issuelens.operators.small import inline_if_small
from issuelens.session import materialize


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df


def drop_null_rows(df: DataFrame, column: str | None = None) -> DataFrame:
    """Drop rows where ``column`` is null, or where any column is; NaN counts as null.

    Plain null checks, so that the scan can apply them.
    """
    types = dict(df.dtypes)
    for name in df.columns if column is None else [column]:
        df = df.filter(F.col(f"`{name}`").isNotNull())
        if types[name] in ("float", "double"):
            df = df.filter(~F.isnan(f"`{name}`"))
    return df


def drop_stray_index(df: DataFrame) -> DataFrame:
    """Drop the unnamed index column that spreadsheet exports leave behind."""
    return df.drop("Unnamed: 0")


def keep_min_length(df: DataFrame, text: str = "text", min_length: int = 20) -> DataFrame:
    return df.filter(F.length(text) >= min_length)


def keep_min_words(df: DataFrame, text: str = "text", min_words: int = 45) -> DataFrame:
    return df.filter(word_count(F.col(text)) >= min_words)


def repeated_texts(df: DataFrame, digest: Column, order_cols: Sequence[str]) -> DataFrame:
    """Digest, smallest key and whether two rows have it, of every text that occurs again.

    Only digests and keys move; texts stay in the scan.
    """
    key = F.col(f"`{order_cols[0]}`") if len(order_cols) == 1 else F.struct(*order_cols)
    rows = df.select(digest.alias("__text"), key.alias("__key")).groupBy("__text", "__key").agg(F.count(F.lit(1)).alias("__n"))
    groups = rows.groupBy("__text").agg(
        F.min("__key").alias("__first"), F.sum("__n").alias("__rows"), F.max("__n").alias("__equal")
    )
    return groups.where("__rows > 1").select("__text", "__first", (F.col("__equal") > 1).alias("__tied"))


def keep_first_by_text(
    df: DataFrame, text: str, order_cols: Sequence[str], digest: str | None = None
) -> DataFrame:
    """One row per distinct text, the one with the smallest ``order_cols``; null keys come last.

    In two phases: the texts that occur again are found on digests and keys alone, then
    rows that are not the first of theirs leave in the scan, by a join with a side of
    checked size. So no text is shuffled or sorted, and copies of a hot text merge in the
    map tasks. If more texts repeat than may be sent to every task, the join shuffles the
    rows by digest, once. Rows that share a text and a key keep one of them.

    ``df`` is evaluated twice: write an expensive one first, with its ``digest`` column.
    """
    own = F.col(f"`{digest}`") if digest else text_hash(F.col(f"`{text}`"))
    groups = materialize(repeated_texts(df, own, order_cols), "repeated")
    tied = not groups.where("__tied").isEmpty()
    key = F.col(f"`{order_cols[0]}`") if len(order_cols) == 1 else F.struct(*order_cols)
    columns = [F.col(f"`{c}`") for c in df.columns]
    joined = df.select(*columns, own.alias("__text"), key.alias("__key")).join(inline_if_small(groups), "__text", "left")
    kept = joined.where(F.col("__tied").isNull() | F.col("__key").eqNullSafe(F.col("__first")))
    if not tied:
        return kept.select(*columns)
    again = kept.where("__tied").groupBy("__text").agg(F.first(F.struct(*columns)).alias("__row")).select("__row.*")
    return kept.where("__tied IS NULL OR NOT __tied").select(*columns).unionByName(again)


def project_text(df: DataFrame, text: str = "text", keep: Sequence[str] = ("number", "title")):
    """The text column followed by those of ``keep`` that exist."""
    return df.select(text, *[c for c in keep if c in df.columns])


def debt_density(
    df: DataFrame, dims: Sequence[str | Column], predicted: str = "predicted_class"
) -> DataFrame:
    """Rows, debt rows and debt share per group."""
    return df.groupBy(*dims).agg(*density_measures(predicted))


def debt_rollup(
    df: DataFrame, dims: Sequence[str], predicted: str = "predicted_class"
) -> DataFrame:
    """Density for every prefix of ``dims``; ``level`` counts the dims rolled away."""
    return df.rollup(*dims).agg(F.grouping_id().alias("level"), *density_measures(predicted))


def debt_cube(df: DataFrame, dims: Sequence[str], predicted: str = "predicted_class") -> DataFrame:
    """Density for every combination of ``dims``."""
    return df.cube(*dims).agg(F.grouping_id().alias("level"), *density_measures(predicted))


def density_measures(predicted: str) -> list[Column]:
    return [
        F.count("*").alias("n_rows"),
        F.sum(F.col(predicted).cast("long")).alias("n_debt"),
        F.avg(F.col(predicted).cast("double")).alias("density"),
    ]


def flag_debt(
    df: DataFrame,
    predicted: str = "predicted_class",
    probability: str = "predicted_probability",
    min_probability: float = 0.0,
) -> DataFrame:
    """Only the rows predicted as debt, at or above a confidence."""
    return df.filter((F.col(predicted) == 1) & (F.col(probability) >= min_probability))


def most_confident_first(df: DataFrame, probability: str, key_cols: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(probability).desc(), *key_cols)


def scan_report(
    df: DataFrame,
    group: str,
    predicted: str = "predicted_class",
    probability: str = "predicted_probability",
) -> DataFrame:
    """Per group: rows of each predicted class and the mean winning probability."""
    is_debt = F.col(predicted) == 1
    return df.groupBy(group).agg(
        F.count(F.when(~is_debt, 1)).alias("n_clean"),
        F.count(F.when(is_debt, 1)).alias("n_debt"),
        F.avg(F.when(is_debt, F.col(probability))).alias("debt_confidence"),
        F.avg(probability).alias("mean_confidence"),
    )


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per label; the total is taken from the per-label counts."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n_rows") / total)
