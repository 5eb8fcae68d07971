"""Named queries over the shared tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, folder) -> DataFrame under its own name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(column: Column | str) -> Column:
    """Rounded for comparison with another engine's doubles."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with truth: doc_id, source, label (the rarer of the two judgements)."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"), "quality")
    return documents.join(labels, "doc_id")


LABELLED = """labelled AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, l.toxic AS label, l.quality
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def ranked_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a logit that other engines compute alike."""
    rows = labelled_documents(spark, folder)
    return rows.withColumn("z", (F.col("n_chars") % 2001 - 1000) / F.lit(250.0))


RANKED = (
    LABELLED
    + """, ranked AS (
  SELECT *, (n_chars % 2001 - 1000) / CAST(250 AS DOUBLE) AS z FROM labelled)"""
)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked rows as binary predictions."""
    rows = ranked_labels(spark, folder)
    positive = 1 / (1 + F.exp(-F.col("z")))
    return rows.select(
        "doc_id",
        "source",
        "label",
        (F.col("z") > 0).cast("int").alias("predicted_class"),
        F.greatest(positive, 1 - positive).alias("predicted_probability"),
        F.array(1 - positive, positive).alias("class_probabilities"),
        "z",
    )


PREDICTED = (
    RANKED
    + """, predicted AS (
  SELECT doc_id, source, label, z, CASE WHEN z > 0 THEN 1 ELSE 0 END AS predicted_class,
         1 / (1 + exp(-z)) AS p1 FROM ranked)"""
)


def class_scores(spark: SparkSession, folder: str, n_classes: int = 10) -> DataFrame:
    """Multi-class logits: inner products of an embedding with the mean of each class.

    Means come from one aggregation with a sum per class and coordinate; the table of
    means has a row per class and goes to the driver.
    """
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    width = rows.agg(F.max(F.size("e"))).first()[0] or 0
    sums = rows.groupBy("label").agg(F.array(*[F.avg(F.get("e", F.lit(i))) for i in range(width)]).alias("m"))
    means = {r["label"]: r["m"] for r in sums.where(F.col("label") < n_classes).collect()}

    def product(mean):
        pairs = F.zip_with("e", F.lit(mean), lambda x, y: x * y)
        return F.round(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) * 10, 6)

    # A class without rows has no mean, so its logit is null.
    logits = [product(means[c]) if c in means else F.lit(None).cast("double") for c in range(n_classes)]
    return rows.select("vec_id", "label", F.array(*logits).alias("logits"))


CLASS_SCORES = """parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
means AS (SELECT label AS c, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM parts GROUP BY label, i) GROUP BY label),
class_scores AS (
  SELECT vec_id, label, list(round(list_dot_product(embedding::DOUBLE[], m) * 10, 6) ORDER BY c) AS logits
  FROM embeddings, means GROUP BY vec_id, label),
class_exp AS (
  SELECT vec_id, label, [exp(x - list_max(logits)) for x in logits] AS e FROM class_scores),
class_probs AS (
  SELECT vec_id, label, [x / list_sum(e) for x in e] AS p FROM class_exp)"""
