"""A corpus pipeline: toxic documents go, near-duplicates and benchmark text go, the rest is mixed and sharded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows the
stage before has kept. All but the last return the columns of ``docs`` as they were.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from issuelens.llm.common import fresh, table  # noqa: E402
from issuelens.llm.decontaminate import contamination  # noqa: E402
from issuelens.llm.jaccard import similar_classes  # noqa: E402
from issuelens.llm.keep import keep_rows, row_keys  # noqa: E402
from issuelens.llm.mixing import repeat_documents  # noqa: E402
from issuelens.llm.sharding import shard_documents  # noqa: E402
from issuelens.llm.toxicity import keep_clean  # noqa: E402
from issuelens.operators.small import sized  # noqa: E402
from issuelens.session import materialize  # noqa: E402

SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    Null and empty texts are scored by the prior and stay; equal texts have equal scores.
    """
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    A group is a component of texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more: SimHash fingerprints near by their distances to references
    are verified first, and an exact join finds what differs in more bits. Null ids come last;
    of rows with one id the one with the smallest digest of its text stays.
    """
    classes = similar_classes(docs.select(*row_keys(), "text"))
    last = (F.col("id_key") == F.lit(-(2**63))).alias("last")
    chosen = classes.groupBy("label").agg(F.min(F.struct(last, "id_key", "text_key")).alias("row"))
    return keep_rows(docs, chosen.select("row.id_key", "row.text_key"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go.

    Null and empty texts hold none and stay; whole texts are searched, copies go together.
    """
    keyed = docs.select(F.xxhash64("text", F.octet_length("text")).alias("doc_id"), "text")
    found = contamination(keyed, table(spark, sf_dir, "benchmark")).where("contaminated")
    name = fresh(docs, "__text_key")
    found = materialize(found.select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    found = sized(found)  # few documents are contaminated: the texts stay where they are
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*columns, F.xxhash64("text", F.octet_length("text")).alias(name))
    return rows.join(found, name, "left_anti").select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scarce domains are repeated to reach their targets; no document is lost.

    Null and empty texts have no tokens and are kept; equal rows are repeated alike.
    """
    return repeat_documents(docs, table(spark, sf_dir, "labels"), low=1.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row: null texts count no bytes, repeated rows have slots of their own."""
    return shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Trained scores, fingerprints and rates have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
