"""Label encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens.operators import labels as L
from issuelens.plans.registry import query, table


def named_labels(spark, folder):
    name = F.when(F.col("toxic") == 1, "toxic").otherwise("non_toxic")
    return table(spark, folder, "labels").select("doc_id", name.alias("label"))


NAMED = "named AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'non_toxic' END AS label FROM labels)"


@query("SELECT vec_id, CAST(CAST(label AS VARCHAR) AS INTEGER) AS label_idx FROM embeddings")
def label_numeric(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return rows.select("vec_id", L.numeric_label(F.col("label")).alias("label_idx"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label_idx FROM events"""
)
def label_positive_category(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select("event_id", L.one_vs_rest_label(F.col("event_type"), "error").alias("label_idx"))


@query(
    """WITH firsts AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type)
    SELECT e.event_id, e.event_type, CAST(f.code AS INTEGER) AS label_idx FROM events e JOIN firsts f USING (event_type)"""
)
def label_ordinal(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type")
    return L.encode_ordinal(rows, "event_type", "event_id").select("event_id", "event_type", "label_idx")


@query(
    f"""WITH {NAMED}, pair AS (
      SELECT coalesce(min(label) FILTER (starts_with(label, 'non_')), min(label)) AS negative FROM named)
    SELECT doc_id, label, CASE WHEN label = negative THEN 0 ELSE 1 END AS code FROM named, pair"""
)
def label_detect(spark, folder):
    return L.encode_detected(named_labels(spark, folder), "label", "code")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS state,
      CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS code FROM orders"""
)
def label_detect_by_order(spark, folder):
    state = F.when(F.col("o_orderstatus") == "F", "finished").otherwise("open")
    rows = table(spark, folder, "orders").select("o_orderkey", state.alias("state"))
    return L.encode_detected(rows, "state", "code")


@query(f"WITH {NAMED} SELECT doc_id, label AS decoded FROM named")
def label_decode(spark, folder):
    rows = named_labels(spark, folder)
    pair = L.detect_pair(rows)
    return rows.select("doc_id", pair.decode(pair.encode(F.col("label"))).alias("decoded"))


@query(f"WITH {NAMED} SELECT DISTINCT CASE WHEN label = 'toxic' THEN 1 ELSE 0 END AS code, label AS name FROM named")
def label_map(spark, folder):
    return L.label_map(L.encode_detected(named_labels(spark, folder), "label", "code"), "label", "code")


@query("SELECT vec_id, CASE WHEN label < 8 THEN 'kind_' || label END AS name FROM embeddings")
def class_names(spark, folder):
    names = {i: f"kind_{i}" for i in range(8)}
    return table(spark, folder, "embeddings").select("vec_id", L.class_names(F.col("label"), names).alias("name"))
