"""Writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and doubled quotes; arrays become ``[a, b]`` text."""
    flat = df.select(*[_as_cell(df, name, kind) for name, kind in df.dtypes])
    (
        flat.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", True)
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def _as_cell(df: DataFrame, name: str, kind: str):
    column = df[name]
    if name == "labels" and kind == "array<string>":
        return F.array_join(column, ",").alias(name)
    if kind == "array<string>":
        return F.to_json(column).alias(name)
    if kind.startswith("array<"):
        return F.concat(F.lit("["), F.array_join(column.cast("array<string>"), ", "), F.lit("]")).alias(name)
    if kind.startswith(("struct<", "map<")):
        return F.to_json(column).alias(name)
    return column


def write_columnar(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet, optionally partitioned by one low-cardinality column."""
    writer = df.write.mode(mode)
    (writer if by is None else writer.partitionBy(by)).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """All splits in one pass, one partition folder each."""
    write_columnar(df, path, split, mode)


def write_splits_csv(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    flat = df.select(*[_as_cell(df, name, kind) for name, kind in df.dtypes])
    (
        flat.write.mode(mode)
        .partitionBy(split)
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small result table (metrics, fold summary, label map) as JSON lines."""
    df.write.mode(mode).json(path)


def append_predictions(df: DataFrame, path: str, run_id: str, source: str) -> None:
    """Put one run's predictions into a table partitioned by run; a repeated run replaces its own rows."""
    tagged = df.withColumns({"source": F.lit(source), "run_id": F.lit(run_id)})
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch of a stream as a partition of its own, so that a retry replaces it."""
    writer = df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
