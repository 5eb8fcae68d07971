"""Small helpers that several of the operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.session import materialize, scratch_path

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark, rows: int = 2000, megabytes: int = 8) -> None:
    """Bound what one Arrow batch of texts may take in a Python worker."""
    spark.conf.set(BATCH_ROWS, str(rows))
    spark.conf.set(BATCH_BYTES, f"{megabytes}m")


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in a row and the start of each value; null is empty."""
    column = column.fill_null("").cast(pa.large_string()) if column.type != pa.large_string() else column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), starts - starts[0]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def text_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``most`` bytes of text in ``column``; a longer text is alone."""
    ends = strings(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


class Scratch:
    """Tables written on the way to a result, in the shared folder; removed when it is written."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def null_safe(column: str | Column) -> Column:
    """A key column that sorts and joins with nulls first and equal to each other."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(-(2**63)))


def numbered(df: DataFrame, order: list, name: str = "row_no") -> tuple[DataFrame, int]:
    """``df`` with gapless numbers from 0 in the given order, and the number of rows.

    Rows are sorted by range once and written with their partition and place; what then
    remains is one count per partition. Pass narrow frames: all columns are written.
    """
    part, at, first = (fresh(df, n) for n in ("_part", "_at", "_first"))
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    placed = materialize(placed, "numbered")
    counts = sorted(tuple(r) for r in placed.groupBy(part).count().collect())  # a row per partition
    starts, total = [], 0
    for number_of, n in counts:
        starts.append((number_of, total))
        total += n
    firsts = F.broadcast(df.sparkSession.createDataFrame(starts, f"{part} int, {first} long"))
    number = (F.col(first) + F.col(at)).alias(name)
    return placed.join(firsts, part).select(*[F.col(f"`{c}`") for c in df.columns], number), total
