"""Reading tables: CSV, JSON documents, JSON lines, Parquet, catalog tables, split folders."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that count as missing, as the usual CSV readers have it.
NA_VALUES = (
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def _existing(read, path: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from error
        raise


def spread(df: DataFrame, per_slot: int = 4) -> DataFrame:
    """Even out a scan of fewer files than cores before per-row work that is heavy.

    A table with plenty of splits comes back unchanged, so at scale this adds nothing.
    For scans and what narrow operators make of them; after a join or aggregation,
    asking for the partition count would run that part of the plan.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= per_slot * slots or len(df.inputFiles()) >= slots:
        return df
    return df.repartition(slots)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    na_values: Sequence[str] = NA_VALUES,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes.

    Give a schema for large inputs: inference reads the data once more. Files with
    quoted line breaks cannot be split; where there are none, ``multi_line=False`` lets
    many tasks read one file.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is None:
        text = _clear_missing(_existing(reader.csv, path), na_values)
        wanted = _guess_types(text)
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])
        text = _clear_missing(_existing(reader.schema(as_text).csv, path), na_values)
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def _clear_missing(text: DataFrame, na_values: Sequence[str]) -> DataFrame:
    if not na_values:
        return text
    cells = {c: F.col(f"`{c}`") for c in text.columns}
    return text.select(*[F.when(~cell.isin(*na_values), cell).alias(c) for c, cell in cells.items()])


def _guess_types(text: DataFrame) -> T.StructType:
    """Whole numbers, numbers, booleans, else text; from all cells, in one aggregation."""
    tests = {
        "long": lambda c: c.try_cast("long").isNotNull(),
        "double": lambda c: c.try_cast("double").isNotNull(),
        "boolean": lambda c: F.lower(c).isin("true", "false"),
    }
    checks = []
    for i, name in enumerate(text.columns):
        cell = F.col(f"`{name}`")
        for kind, test in tests.items():
            all_fit = F.bool_and(F.when(cell.isNotNull(), test(cell)))
            checks.append(F.coalesce(all_fit, F.lit(False)).alias(f"{i}_{kind}"))
    fits = text.agg(*checks).first()
    kinds = [next((k for k in tests if fits[f"{i}_{k}"]), "string") for i in range(len(text.columns))]
    return T.StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in zip(text.columns, kinds)))


def read_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON object per line; splittable."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return _existing(reader.json, path)


def read_json_records(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Files that each hold one JSON array of records (or one record)."""
    reader = spark.read.option("multiLine", True)
    return _existing((reader if schema is None else reader.schema(schema)).json, path)


def _whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # As an argument: PySpark lets the default of the argument win over the option.
    return _existing(lambda p: spark.read.text(p, wholetext=True), path)


def read_json_columns(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that each hold ``{"column": {"row": value}}``.

    The cells are spread as (file, row, column, value) and regrouped by row, so a file
    is parsed by one task but its rows are built by many.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    files = _whole_files(spark, path)
    return spread_json_columns(files.select(F.input_file_name().alias("file"), "value"), "file", "value", wanted)


def spread_json_columns(documents: DataFrame, key: str, value: str, schema: T.StructType) -> DataFrame:
    """Rows of column-oriented JSON texts; ``key`` tells the texts apart."""
    cells = (
        documents.select(key, F.from_json(value, "map<string,map<string,string>>").alias("__doc"))
        .select(key, F.explode("__doc").alias("__name", "__cells"))
        .select(key, "__name", F.explode("__cells").alias("__row", "__cell"))
    )
    picked = [F.max(F.when(F.col("__name") == f.name, F.col("__cell"))).cast(f.dataType).alias(f.name) for f in schema]
    return cells.groupBy(key, "__row").agg(*picked).drop(key, "__row")


def _json_layout(text: Column) -> Column:
    """What a whole JSON file holds: ``lines``, ``columns`` or ``records`` (an array or one record)."""
    body = F.ltrim(text)
    lines = F.rlike(body, F.lit(r"^\{[^\n]*\}[ \t\r]*\n\s*\{"))
    cells = F.map_values(F.from_json(body, "map<string,string>"))
    nested = F.startswith(body, F.lit("{")) & F.forall(cells, lambda v: F.startswith(F.ltrim(v), F.lit("{")))
    return F.when(lines, "lines").when(nested, "columns").otherwise("records")


def read_json(spark: SparkSession, path: str, schema=None, orient: str | None = None) -> DataFrame:
    """JSON files of any layout; ``orient`` is ``records``, ``lines`` or ``columns``.

    Without it every file is looked at: an array of records, one record, one record a
    line, or columns of cells (an object whose values are all objects). A folder may hold
    files of several layouts; their rows are put together by column name. Looking reads
    each file whole, so give ``orient`` for large ones.
    """
    if orient is not None:
        return _read_json_layout(spark, path, schema, orient)
    files = _whole_files(spark, path)
    found = files.select(F.col("_metadata.file_path").alias("file"), _json_layout(F.col("value")).alias("layout"))
    layouts = sorted(r["layout"] for r in found.select("layout").distinct().collect())
    if len(layouts) <= 1:
        return _read_json_layout(spark, path, schema, layouts[0] if layouts else "records")
    parts = []
    for layout in layouts:  # a folder of mixed files: the list of their names is what comes to the driver
        names = [r["file"] for r in found.where(F.col("layout") == layout).select("file").collect()]
        parts.append(_read_json_layout(spark, names, schema, layout))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _read_json_layout(spark: SparkSession, path: str | list[str], schema, orient: str) -> DataFrame:
    if orient == "lines":
        return read_json_lines(spark, path, schema)
    if orient == "records":
        return read_json_records(spark, path, schema)
    if schema is None:
        names = (
            _whole_files(spark, path)
            .select(F.explode(F.json_object_keys("value")).alias("name"))
            .distinct()
            .toArrow()
        )
        schema = T.StructType([T.StructField(n, T.StringType()) for n in sorted(names.column(0).to_pylist())])
    return read_json_columns(spark, path, schema)


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a file by its suffix: .csv, .json, .jsonl or .parquet."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return read_csv(spark, path, schema)
    if suffix == ".json":
        return read_json(spark, path, schema)
    if suffix == ".jsonl":
        return read_json_lines(spark, path, schema)
    if suffix == ".parquet":
        return _existing(spark.read.parquet, path)
    raise ValueError(f"Unsupported file format: {path}")


def load_split(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """One split of a table partitioned by ``split``; other partitions are not read."""
    return _existing(spark.read.parquet, path).filter(F.col("split") == split).drop("split")


def load_dataset(spark: SparkSession, source: str, split: str = "train", schema=None) -> DataFrame:
    """A catalog table, a file by its suffix, or a folder of splits.

    A table with a ``split`` column is filtered on it.
    """
    if re.fullmatch(r"\w+(\.\w+){0,2}", source) and spark.catalog.tableExists(source):
        found = spark.table(source)
        return found.filter(F.col("split") == split).drop("split") if "split" in found.columns else found
    if os.path.splitext(source.rstrip("/"))[1]:
        return load_table(spark, source, schema)
    return load_split(spark, source, split)
