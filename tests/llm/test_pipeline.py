"""The pipeline's stages on their own input, and every query of the operators."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from issuelens.llm.common import table
from issuelens.llm.keep import keep_rows, row_keys
from issuelens.llm.queries import LLM_ORACLE_SQL, LLM_QUERIES
from tests.llm import plain
from tests.llm.test_jaccard import survivors
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_query(spark, sf_dir, name):
    assert difference(spark, connect(sf_dir), sf_dir, name, LLM_QUERIES[name], LLM_ORACLE_SQL.get(name)) is None


def test_stages(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, sf_dir, "documents")
    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    rejected = docs.join(clean, "doc_id", "left_anti").count()
    assert 0 < rejected < docs.count() / 4

    apart = stages["near_dedup"](spark, docs, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert apart.columns == docs.columns and sorted(r["doc_id"] for r in apart.collect()) == survivors([(d, t or "") for d, t in rows])

    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    left = stages["decontamination"](spark, docs, sf_dir)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, t in rows if not plain.contamination(t, items)[-1]}

    mixed = stages["mixing"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == {d for d, _ in rows}


def test_awkward_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(5).withColumn("key", F.lit(1)).withColumn("__text_key", F.lit(2))
    more = docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    empty = docs.limit(0)
    odd = docs.unionByName(docs).unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns and out.count() > 0, name
        assert stage(spark, empty, sf_dir).count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, odd, sf_dir).count() <= 6


def test_keep_rows_keeps_one_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 6), (None, None, 7)], "doc_id long, text string, z int")
    chosen = docs.select(*row_keys()).distinct()
    assert sorted(r["z"] for r in keep_rows(docs, chosen).collect()) == [5, 6, 7]
