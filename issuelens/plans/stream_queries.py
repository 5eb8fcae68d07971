"""Streaming queries: each drains a file stream into a table and returns it.

The given tables end, so windowed queries add a row far in the future, which closes the
last windows too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens.functions.text import text_hash
from issuelens.operators import metrics as M
from issuelens.operators import scoring as I
from issuelens.plans.io_queries import FLAT, raw_issues
from issuelens.plans.metric_queries import SCORES, SCORES_SQL, counts_sql, rounded
from issuelens.plans.registry import query, r6, table
from issuelens.plans.scoring_queries import BIAS, linear_sql, token_weights
from issuelens.plans.text_queries import EVENTS_AS_DEBT, sql_clean
from issuelens.session import scratch_path
from issuelens.sources import issues as G
from issuelens.streaming import jobs as J


def stream_table(spark, folder, name):
    """The table as a file stream, whether it is one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def debt_events(spark, folder):
    is_debt = (F.col("event_type") == "error").cast("int")
    return stream_table(spark, folder, "events").select("ts", "user_id", "event_type", is_debt.alias("predicted_class"))


def written(stream, name):
    return J.run_to_table(stream, scratch_path(stream.sparkSession, name))


def stamped(frame, *names):
    return frame.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


@query(
    f"""WITH cleaned AS (SELECT doc_id, {sql_clean('text')} AS text FROM documents WHERE text IS NOT NULL),
      kept AS (SELECT * FROM cleaned WHERE length(text) >= 20), {linear_sql('kept', 'doc_id', 'text')}
    SELECT doc_id, length(text) AS clean_chars, predicted_class, round(p1, 6) AS p1 FROM kept JOIN probs USING (doc_id)"""
)
def stream_clean_score(spark, folder):
    """Clean, keep and score incoming texts in one append query without state."""
    stream = stream_table(spark, folder, "documents").select("doc_id", F.col("text").alias("body"))
    cleaned = J.clean_stream(stream).select("doc_id", "text", F.length("text").cast("long").alias("clean_chars"))
    logits = I.linear_logits(cleaned, ["doc_id", "clean_chars"], "text", token_weights(spark, folder), BIAS)
    scored = I.predict_logits(logits)
    p1 = r6(F.get("class_probabilities", F.lit(1))).alias("p1")
    return written(scored.select("doc_id", "clean_chars", "predicted_class", p1), "stream-scores")


@query("SELECT DISTINCT sha256(text) AS text_hash FROM documents")
def stream_dedup(spark, folder):
    # Well after the epoch, where watermarks start and earlier rows would count as late.
    arrival = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    stream = stream_table(spark, folder, "documents").select("doc_id", "text", arrival.alias("created_at"))
    with J.durable_state(spark):
        return written(J.dedup_stream(stream, "created_at", "365 days"), "stream-dedup").select("text_hash")


def closed(stream, **values):
    return J.with_closing_row(stream, "ts", scratch_path(stream.sparkSession, "closing"), values)


@query(
    f"""WITH {EVENTS_AS_DEBT}, windows AS (SELECT date_trunc('day', ts) AS s, user_id, count(*) AS n_rows,
        CAST(sum(predicted_class) AS BIGINT) AS n_debt, round(avg(predicted_class), 6) AS density FROM debt GROUP BY ALL)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
      user_id, n_rows, n_debt, density FROM windows"""
)
def stream_density_tumbling(spark, folder):
    rows = written(J.density_tumbling(closed(debt_events(spark, folder)), "ts", ["user_id"]), "stream-tumbling")
    return stamped(rows, "window_start", "window_end").withColumn("density", r6("density"))


@query(
    f"""WITH {EVENTS_AS_DEBT}, placed AS (SELECT event_type, predicted_class,
        date_trunc('day', ts) - unnest(range(7)) * INTERVAL 1 DAY AS s FROM debt),
      windows AS (SELECT s, event_type, count(*) AS n_rows, CAST(sum(predicted_class) AS BIGINT) AS n_debt,
        round(avg(predicted_class), 6) AS density FROM placed GROUP BY ALL)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
      event_type, n_rows, n_debt, density FROM windows"""
)
def stream_density_sliding(spark, folder):
    rows = written(J.density_sliding(closed(debt_events(spark, folder)), "ts", ["event_type"]), "stream-sliding")
    return stamped(rows, "window_start", "window_end").withColumn("density", r6("density"))


@query(
    f"""WITH errors AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR
        THEN 0 ELSE 1 END AS starts FROM events WHERE event_type = 'error'),
      numbered AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM errors),
      bursts AS (SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 6 HOUR AS e, count(*) AS n_rows FROM numbered GROUP BY user_id, burst)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS burst_start, strftime(e, '%Y-%m-%d %H:%M:%S') AS burst_end, user_id, n_rows
    FROM bursts"""
)
def stream_debt_bursts(spark, folder):
    errors = debt_events(spark, folder).filter("predicted_class = 1")
    rows = written(J.debt_bursts(closed(errors), "ts", ["user_id"], "6 hours"), "stream-bursts")
    return stamped(rows, "burst_start", "burst_end")


@query("SELECT event_type AS label, count(*) AS n_rows FROM events GROUP BY event_type")
def stream_live_balance(spark, folder):
    """Running counts in update mode; each batch's changed rows go to the table."""
    path = scratch_path(spark, "stream-balance")
    stream = debt_events(spark, folder).select(F.col("event_type").alias("label"))

    def upsert(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    J.start_batch_sink(J.live_balance(stream), upsert, f"{path}_checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(path).groupBy("label").agg(F.max_by("n_rows", "batch_id").alias("n_rows"))


# Every event is predicted at once and labelled a number of hours later.
LATE = f"""predicted AS (SELECT event_id, ts, CASE WHEN value > 10 THEN 1 ELSE 0 END AS predicted_class,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, event_id % 240 AS hours FROM events),
  labelled AS (SELECT date_trunc('day', ts) AS window_start, label, predicted_class FROM predicted WHERE hours <= 168),
  {counts_sql('labelled', 'window_start')}"""


@query(f"WITH {LATE} SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, {SCORES_SQL} FROM counts")
def stream_late_labels(spark, folder):
    """Join predictions with labels that come later; days and their metrics come from the stream."""
    events = closed(stream_table(spark, folder, "events"), event_id=-1)
    guesses = events.select("event_id", "ts", (F.col("value") > 10).cast("int").alias("predicted_class"))
    later = F.col("ts") + F.make_dt_interval(hours=F.coalesce(F.col("event_id") % 240, F.lit(0)).cast("int"))
    truth = closed(stream_table(spark, folder, "events"), event_id=-2).select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("label"), later.alias("labelled_at")
    )
    joined = J.join_late_labels(guesses, truth, "event_id", "ts", "labelled_at", "7 days", "1 hour", "2 hours")
    path = scratch_path(spark, "stream-quality")
    J.start_quality_sink(joined, "ts", path, f"{path}_checkpoint", available_now=True).awaitTermination()
    scores = spark.read.parquet(path).drop("batch_id", "confusion_matrix")
    return stamped(rounded(scores, *SCORES), "window_start")


@query(
    """WITH late AS (SELECT ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events WHERE event_id % 10 <> 0) AS dropped
      FROM events WHERE event_id % 10 = 0)
    SELECT CAST(count(*) AS BIGINT) AS n_input, CAST(count_if(dropped) AS BIGINT) AS n_dropped FROM late"""
)
def stream_late_rows(spark, folder):
    """Rows that arrive after the others were read, and how many of them are too late, from the log of the queries."""
    inbox, log = scratch_path(spark, "late-inbox"), scratch_path(spark, "late-log")
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = scratch_path(spark, "late-out")
    with J.logged_late_rows(spark, log), J.durable_state(spark):
        for part in ("event_id % 10 <> 0", "event_id % 10 = 0"):  # what arrives first, and what arrives later
            events.where(part).write.mode("append").parquet(inbox)
            stream = spark.readStream.schema(events.schema).parquet(inbox).withWatermark("ts", "1 day")
            J.start_table_sink(stream.dropDuplicates(["event_id", "ts"]), out, f"{out}_checkpoint", available_now=True).awaitTermination()
    batches = spark.read.parquet(log)
    last = batches.groupBy("query_id").agg(F.max("batch_id").alias("batch_id"))
    return batches.join(last, ["query_id", "batch_id"]).select("n_input", "n_dropped")


@query(f"WITH {FLAT} SELECT id, title, state, user_login, labels FROM flat")
def stream_issue_source(spark, folder):
    """New issue files as they arrive, flattened."""
    path = scratch_path(spark, "issue-feed")
    raw_issues(spark, folder).write.json(path)
    flat = G.flatten_issues(G.drop_pull_requests(G.stream_issues(spark, path, max_files=4)))
    rows = flat.select("id", "title", "state", "user_login", F.array_join("labels", ",").alias("labels"))
    return written(rows, "stream-issues")
