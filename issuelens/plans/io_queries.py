"""Source and sink queries: what is written comes back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from issuelens.operators.sampling import stratified_split
from issuelens.plans.label_queries import NAMED, named_labels
from issuelens.plans.registry import labelled_documents, predictions, query, r6, table
from issuelens.plans.sampling_queries import CLASSES, KEY, RANKED_ROWS, quota_sql
from issuelens.session import scratch_path
from issuelens.sources import issues as G
from issuelens.sources import sinks, tables

TEXT_SCHEMA = "doc_id long, text string, lang string, n_chars long"


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def csv_round_trip(spark, folder):
    path = scratch_path(spark, "documents") + ".csv"
    sinks.write_csv(table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    return tables.load_table(spark, path, TEXT_SCHEMA)


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang,
      CASE WHEN n_chars % 3 <> 0 THEN n_chars END AS n_chars FROM documents"""
)
def csv_missing_markers(spark, folder):
    path = scratch_path(spark, "missing") + ".csv"
    rows = table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", "N/A").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("n_chars") % 3 == 0, "null").otherwise(F.col("n_chars").cast("string")).alias("n_chars"),
    )
    sinks.write_csv(rows, path)
    return tables.read_csv(spark, path)


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines_round_trip(spark, folder):
    path = scratch_path(spark, "conversations") + ".jsonl"
    table(spark, folder, "conversations").write.json(path)
    return tables.load_table(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT doc_id, text, source FROM documents")
def json_files_of_any_layout(spark, folder):
    """Files under ``.json`` in turn as an array, as lines, as columns, and with a single record."""
    fields = F.struct("doc_id", "text", "source")
    rows = table(spark, folder, "documents").select("doc_id", fields.alias("r"), (F.col("doc_id") % 101 == 7).alias("alone"))
    part = F.when(F.col("alone"), -F.col("doc_id") - 1).otherwise(F.floor(F.col("doc_id") / 50))
    line = F.concat(F.to_json("r"), F.lit("\n"))  # the copy matters: collected JSON values share a buffer
    groups = rows.groupBy(part.alias("part")).agg(F.collect_list("r").alias("r"), F.collect_list(line).alias("lines"))
    cells = lambda c: F.map_from_entries(F.transform("r", lambda x: F.struct(x["doc_id"].cast("string"), x[c].cast("string"))))
    columns = F.create_map(*[x for c in ("doc_id", "text", "source") for x in (F.lit(c), cells(c))])
    value = (
        F.when(F.col("part") < 0, F.to_json(F.get("r", F.lit(0))))
        .when(F.col("part") % 3 == 0, F.to_json("r"))
        .when(F.col("part") % 3 == 1, F.rtrim(F.array_join("lines", ""), F.lit("\n")))
        .otherwise(F.to_json(columns))
    )
    path = scratch_path(spark, "layouts") + ".json"
    groups.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return tables.load_table(spark, path, "doc_id long, text string, source string")


@query("SELECT doc_id, text, source FROM documents")
def json_columns_orient(spark, folder):
    """Column-oriented JSON texts of up to 100 documents each, and back to rows."""
    rows = table(spark, folder, "documents").withColumn("part", F.floor(F.col("doc_id") / 100))
    row_id = (F.col("doc_id") % 100).cast("string")
    cells = lambda c: F.map_from_entries(F.collect_list(F.struct(row_id, F.col(c).cast("string"))))
    names = ["doc_id", "text", "source"]
    texts = rows.groupBy("part").agg(
        F.to_json(F.create_map(*[x for c in names for x in (F.lit(c), cells(c))])).alias("value")
    )
    schema = StructType(
        [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType())]
    )
    return tables.spread_json_columns(texts, "part", "value", schema)


@query("SELECT * FROM orders")
def parquet_by_suffix(spark, folder):
    return tables.load_dataset(spark, f"{folder}/orders.parquet")


@query(
    f"""WITH {RANKED_ROWS}, {CLASSES}, {quota_sql('classes', 'n', 0.2)}
    SELECT doc_id, label FROM ranks JOIN quota USING (label) WHERE r > t"""
)
def split_write_then_read_train(spark, folder):
    path = scratch_path(spark, "splits")
    rows = labelled_documents(spark, folder).select("doc_id", "label")
    sinks.write_splits(stratified_split(rows, KEY), path)
    return tables.load_dataset(spark, path, "train")


@query(
    f"""WITH {RANKED_ROWS}, {CLASSES}, {quota_sql('classes', 'n', 0.2)}
    SELECT doc_id, label, CASE WHEN r <= t THEN 'test' ELSE 'train' END AS split FROM ranks JOIN quota USING (label)"""
)
def split_write_csv(spark, folder):
    path = scratch_path(spark, "splits-csv")
    rows = labelled_documents(spark, folder).select("doc_id", "label")
    sinks.write_splits_csv(stratified_split(rows, KEY), path)
    return tables.read_csv(spark, path, "doc_id long, label int, split string")


@query(f"WITH {NAMED} SELECT label, count(*) AS n_rows FROM named GROUP BY label")
def report_write_then_read(spark, folder):
    path = scratch_path(spark, "report")
    sinks.write_report(named_labels(spark, folder).groupBy("label").agg(F.count("*").alias("n_rows")), path)
    return tables.read_json_lines(spark, path, "label string, n_rows long")


@query(
    """SELECT d.doc_id, CASE WHEN n_chars % 2001 > 1000 THEN 1 ELSE 0 END AS predicted_class, 'documents' AS source, run_id
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('run_1'), ('run_2')) runs(run_id)"""
)
def predictions_by_run(spark, folder):
    path = scratch_path(spark, "predictions")
    rows = predictions(spark, folder).select("doc_id", "predicted_class")
    for run in ("run_1", "run_2"):
        sinks.append_predictions(rows, path, run, "documents")
    return spark.read.parquet(path)


@query(
    """SELECT doc_id, '[' || CASE WHEN n_chars % 2001 > 1000 THEN '0.25, 0.75' ELSE '0.75, 0.25' END || ']' AS class_probabilities
    FROM documents"""
)
def prediction_file_text(spark, folder):
    path = scratch_path(spark, "prediction-file") + ".csv"
    debt = F.col("n_chars") % 2001 > 1000
    rows = table(spark, folder, "documents").select(
        "doc_id", F.when(debt, F.array(F.lit(0.25), F.lit(0.75))).otherwise(F.array(F.lit(0.75), F.lit(0.25))).alias("class_probabilities")
    )
    sinks.write_csv(rows, path)
    return tables.read_csv(spark, path, "doc_id long, class_probabilities string")


# Raw issues from documents: some without a body, user or labels, some pull requests.
RAW_ISSUE = """
  doc_id AS id, doc_id AS number, source AS title,
  CASE WHEN n_chars % 7 <> 0 THEN text END AS body,
  CASE WHEN n_chars % 2 = 0 THEN 'open' ELSE 'closed' END AS state,
  '2024-01-01T00:00:00Z' AS created_at, '2024-01-02T03:04:05Z' AS updated_at, CAST(NULL AS STRING) AS closed_at,
  CASE WHEN n_chars % 5 <> 0 THEN lang END AS login,
  n_chars % 3 AS n_labels,
  CASE WHEN n_chars % 4 <> 0 THEN n_chars END AS comments,
  CASE WHEN n_chars % 6 <> 0 THEN 'https://e.x/' || doc_id END AS html_url,
  CASE WHEN n_chars % 11 = 0 THEN 'https://e.x/pull/' || doc_id END AS pull_url"""


def raw_issues(spark, folder):
    flat = table(spark, folder, "documents").selectExpr(*[part.strip() for part in _split_columns(RAW_ISSUE)])
    nested = flat.select(
        *["id", "number", "title", "body", "state", "created_at", "updated_at", "closed_at"],
        F.when(F.col("login").isNotNull(), F.struct("login")).alias("user"),
        F.transform(
            F.slice(F.array(F.lit("bug"), F.lit("debt")), 1, F.col("n_labels").cast("int")), lambda x: F.struct(x.alias("name"))
        ).alias("labels"),
        "comments",
        "html_url",
        F.when(F.col("pull_url").isNotNull(), F.struct(F.col("pull_url").alias("url"))).alias("pull_request"),
    )
    path = scratch_path(spark, "issues")
    nested.write.json(path)
    return G.read_issues(spark, path)


def _split_columns(sql: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, char in enumerate(sql):
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            parts.append(sql[start:i])
            start = i + 1
    return [*parts, sql[start:]]


FLAT = f"""raw AS (SELECT {RAW_ISSUE} FROM documents), flat AS (
  SELECT id, number, title, coalesce(body, '') AS body, state, '2024-01-01 00:00:00' AS created_at,
    '2024-01-02 03:04:05' AS updated_at, CAST(NULL AS VARCHAR) AS closed_at, coalesce(login, '') AS user_login,
    CASE n_labels WHEN 0 THEN '' WHEN 1 THEN 'bug' ELSE 'bug,debt' END AS labels, coalesce(comments, 0) AS comments,
    coalesce(html_url, '') AS url FROM raw WHERE pull_url IS NULL)"""


def flat_issues(spark, folder):
    flat = G.flatten_issues(G.drop_pull_requests(raw_issues(spark, folder)))
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at", "closed_at")}
    return flat.withColumns({**times, "labels": F.array_join("labels", ",")})


@query(f"WITH {FLAT} SELECT * FROM flat")
def issue_flatten(spark, folder):
    return flat_issues(spark, folder)


@query(f"WITH {FLAT} SELECT id, state, user_login, labels FROM flat WHERE state = 'open'")
def issues_open(spark, folder):
    return G.filter_state(flat_issues(spark, folder), "open").select("id", "state", "user_login", "labels")


@query(
    """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM
      (SELECT o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_orderkey)
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100"""
)
def newest_issues(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    newest = G.newest_issues(rows.unionByName(rows), 100)
    return newest.select("id", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


@query(
    """SELECT event_type, count(*) AS n_rows, round(avg(value), 6) AS mean FROM events
    WHERE value IS NOT NULL GROUP BY event_type"""
)
def columnar_write_then_scan(spark, folder):
    path = scratch_path(spark, "events")
    sinks.write_columnar(table(spark, folder, "events").select("event_id", "event_type", "value"), path, by="event_type")
    rows = spark.read.parquet(path).filter(F.col("value").isNotNull())
    return rows.groupBy("event_type").agg(F.count("*").alias("n_rows"), r6(F.avg("value")).alias("mean"))
