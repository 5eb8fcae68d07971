"""Streaming forms of the cleaning, scoring, de-duplication and density operators."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from issuelens.functions.text import text_hash, with_clean_text
from issuelens.operators.metrics import binary_scores
from issuelens.operators.relational import density_measures, keep_min_length
from issuelens.sources.sinks import write_batch

CLOSING_TIME = "9000-01-01 00:00:00"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Counting the rows of the state would look every key up before it is written.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def clean_stream(stream: DataFrame, body: str = "body", min_length: int = 20) -> DataFrame:
    """Clean incoming bodies and drop short ones; stateless."""
    cleaned = with_clean_text(stream.filter(F.col(body).isNotNull()), body, "text")
    return keep_min_length(cleaned, "text", min_length)


@contextmanager
def durable_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, outside the heap, and write only
    its changes to the checkpoint. The session's own settings come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def dedup_stream(stream: DataFrame, event_time: str, delay: str, text: str = "text") -> DataFrame:
    """Drop repeats of a text that arrive within ``delay``, some days as a rule.

    One operator on the text's digest; a digest leaves the state once the watermark is
    ``delay`` past its first row, so the state follows the rate of new texts and not the
    age of the stream. Start it under :func:`durable_state`.
    """
    hashed = stream.withColumn("text_hash", text_hash(F.col(text)))
    return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["text_hash"])


def _density(stream: DataFrame, span: Column, dims: Sequence[str], predicted: str) -> DataFrame:
    return stream.groupBy(span.alias("window"), *dims).agg(*density_measures(predicted)).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *dims,
        "n_rows",
        "n_debt",
        "density",
    )


def density_tumbling(
    stream: DataFrame,
    event_time: str,
    dims: Sequence[str],
    width: str = "1 day",
    delay: str = "1 hour",
    predicted: str = "predicted_class",
) -> DataFrame:
    """Debt share per fixed window and group."""
    timed = stream.withWatermark(event_time, delay)
    return _density(timed, F.window(event_time, width), dims, predicted)


def density_sliding(
    stream: DataFrame,
    event_time: str,
    dims: Sequence[str],
    width: str = "7 days",
    slide: str = "1 day",
    delay: str = "1 hour",
    predicted: str = "predicted_class",
) -> DataFrame:
    """Debt share per overlapping window and group."""
    timed = stream.withWatermark(event_time, delay)
    return _density(timed, F.window(event_time, width, slide), dims, predicted)


def debt_bursts(
    stream: DataFrame, event_time: str, dims: Sequence[str], gap: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Runs of debt rows per group with pauses shorter than ``gap``."""
    timed = stream.withWatermark(event_time, delay)
    return (
        timed.groupBy(F.session_window(event_time, gap).alias("burst"), *dims)
        .agg(F.count("*").alias("n_rows"))
        .select(
            F.col("burst.start").alias("burst_start"), F.col("burst.end").alias("burst_end"), *dims, "n_rows"
        )
    )


def live_balance(stream: DataFrame, label: str = "label") -> DataFrame:
    """Running row count per class, for update or complete mode."""
    return stream.groupBy(label).agg(F.count("*").alias("n_rows"))


def join_late_labels(
    predictions: DataFrame,
    labels: DataFrame,
    key: str,
    predicted_at: str,
    labelled_at: str,
    max_wait: str = "7 days",
    delay: str = "1 hour",
    label_delay: str | None = None,
) -> DataFrame:
    """Predictions with the labels that arrive up to ``max_wait`` later.

    Either stream has a watermark of its own; both bound the state of the join, and what
    follows the join sees rows no older than ``max_wait`` before the slower one.
    """
    left = predictions.withWatermark(predicted_at, delay).alias("p")
    right = labels.withWatermark(labelled_at, label_delay or delay).alias("l")
    in_time = F.expr(
        f"l.{key} = p.{key} AND l.{labelled_at} >= p.{predicted_at} "
        f"AND l.{labelled_at} <= p.{predicted_at} + INTERVAL {max_wait}"
    )
    extra = [f"l.{c}" for c in labels.columns if c != key]
    return left.join(right, in_time).select("p.*", *extra)


def rolling_counts(
    joined: DataFrame, event_time: str, width: str = "1 day", label: str = "label", predicted: str = "predicted_class"
) -> DataFrame:
    """Confusion counts per window of a labelled stream."""

    def cell(truth: int, guess: int, name: str) -> Column:
        return F.count(F.when((F.col(label) == truth) & (F.col(predicted) == guess), 1)).alias(name)

    return (
        joined.groupBy(F.window(event_time, width).alias("window"))
        .agg(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))
        .select(F.col("window.start").alias("window_start"), "tn", "fp", "fn", "tp")
    )


def rolling_quality(counts: DataFrame) -> DataFrame:
    """Metrics per window; plain arithmetic, so batch and stream alike."""
    return binary_scores(counts)


def start_quality_sink(joined: DataFrame, event_time: str, path: str, checkpoint: str, width: str = "1 day", available_now: bool = False) -> StreamingQuery:
    """Metrics per window of a stream of labelled predictions, into a table.

    The windows are counted by the query itself, after the join of ``joined``: a window
    is emitted once, when neither stream can bring rows of it any more. A batch's metrics
    are a partition of their own, so a batch that runs again replaces what it wrote.
    """
    counts = rolling_counts(joined, event_time, width)

    def report(batch: DataFrame, batch_id: int) -> None:
        write_batch(rolling_quality(batch), path, batch_id)

    with durable_state(joined.sparkSession):
        return start_batch_sink(counts, report, checkpoint, "append", available_now)


def start_table_sink(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, interval: str = "1 minute"
) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once through its checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start(path)


def start_batch_sink(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "update",
    available_now: bool = False,
) -> StreamingQuery:
    """Hand every micro-batch to ``handle``, for upserts and reports."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def with_closing_row(stream: DataFrame, event_time: str, folder: str, values: Mapping | None = None) -> DataFrame:
    """A bounded stream followed by one row far in the future, for drains that must be complete.

    The row moves the watermark past all windows of the stream, so they are emitted; its
    own window stays open and is never written. ``folder`` is an unused place for it.
    Other columns are null unless ``values`` has them: a key that is joined on needs one
    that no row has, since rows without a key are dropped before the watermark sees them.
    """
    spark = stream.sparkSession
    values = values or {}
    end = F.to_timestamp(F.lit(CLOSING_TIME)).cast(stream.schema[event_time].dataType)
    row = [(end if f.name == event_time else F.lit(values.get(f.name)).cast(f.dataType)).alias(f.name) for f in stream.schema]
    spark.range(1).select(*row).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder))


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Drain what the source has now into ``path`` and return the written table.

    Windows that the watermark has not passed stay in the state; see :func:`with_closing_row`.
    """
    query = start_table_sink(stream, path, f"{path}_checkpoint", available_now=True)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


LATE_ROWS = "query_id string, batch_id long, operator string, place int, watermark string, n_input long, n_dropped long"


class LateRowLog(StreamingQueryListener):
    """Keeps a table of the rows each batch dropped because they came after the watermark.

    A row per batch and stateful operator, written as a partition of its own: a batch that
    runs again after a restart replaces its rows. After an aggregation the engine counts
    groups, elsewhere rows. A driver lost between a batch and its report loses that report.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.running: set[str] = set()
        self.failure: Exception | None = None
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        report = event.progress
        mark = report.eventTime.get("watermark")
        rows = [
            (str(report.id), report.batchId, o.operatorName, i, mark, report.numInputRows, o.numRowsDroppedByWatermark)
            for i, o in enumerate(report.stateOperators)
        ]
        if not report.numInputRows or not rows:
            return
        try:
            table = self.spark.createDataFrame(rows, LATE_ROWS).coalesce(1)
            writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("query_id", "batch_id").parquet(self.path)
        except Exception as error:  # the engine swallows what a listener raises
            self.failure = error

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.running.discard(str(event.runId))
            self.changed.notify_all()


@contextmanager
def logged_late_rows(spark: SparkSession, path: str, patience: float = 60.0) -> Iterator[LateRowLog]:
    """The session's queries report late rows to the table at ``path``.

    Leaving waits until the queries started inside have ended and their reports are
    written; reports come on a thread of their own, later than the batches.
    """
    log = LateRowLog(spark, path)
    spark.streams.addListener(log)
    try:
        yield log
        with log.changed:
            if not log.changed.wait_for(lambda: not log.running, patience):
                raise TimeoutError(f"queries still run or report: {sorted(log.running)}")
        if log.failure:
            raise log.failure
    finally:
        spark.streams.removeListener(log)


def late_rows_dropped(query: StreamingQuery) -> int:
    """Rows that came after the watermark in the batches the query still reports on."""
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )
