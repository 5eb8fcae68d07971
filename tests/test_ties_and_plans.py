"""Ties up to rounding, and work that a plan must not repeat."""

from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from issuelens.functions import text as T
from issuelens.operators import metrics as M
from issuelens.operators import relational as R
from issuelens.operators import scoring as I
from issuelens.operators import training as TR
from issuelens.plans.text_queries import BODY, SQL_RULES
from issuelens.streaming import jobs as J


def test_logit_means_that_only_rounding_keeps_apart_are_tied(spark):
    # The three logits of class 1 add up to nothing; as doubles their sum depends on the order.
    rows = [(i, *[[0.0, z] for z in zs]) for i, zs in enumerate(permutations([-0.86, -2.34, 3.2]))]
    rows += [(10, [0.0, 1e-9], [0.0, 0.0], [0.0, 0.0]), (11, [0.0, -1.0], [0.0, 0.5], [0.0, 0.25]), (12, None, [0.0, 2.0], None)]
    rows += [(13, [0.0, float("-inf")], [0.0, 1.0], [0.0, 1.0]), (14, None, None, None)]
    df = spark.createDataFrame(rows, "id long, l1 array<double>, l2 array<double>, l3 array<double>")
    found = {r["id"]: r for r in I.ensemble_logits(df, ["l1", "l2", "l3"]).collect()}
    assert [found[i]["predicted_class"] for i in range(6)] == [0] * 6
    assert all(found[i]["class_probabilities"] == [0.5, 0.5] for i in range(6))
    assert [found[i]["predicted_class"] for i in (10, 11, 12, 13, 14)] == [1, 0, 1, 0, None]
    assert found[12]["class_probabilities"][1] == pytest.approx(0.880797, abs=1e-6)


def test_a_filter_on_scores_does_not_repeat_the_scoring(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, "c")], "id long, text string").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts")).repartition(2)
    weights = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 0.5)], "token string, class int, weight double")
    scored = I.predict_logits(I.linear_logits(texts, ["id"], "text", weights, [0.0, -1.0]))
    flagged = R.flag_debt(scored, min_probability=0.6)
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("octet_length(lower(") == 1  # texts are cut into tokens in one place
    assert [(r["id"], r["predicted_class"]) for r in flagged.collect()] == [(1, 1)]


def test_texts_of_many_rules_are_cleaned_alike_by_either_engine(spark):
    docs = spark.createDataFrame(
        [(1, "plain _x_ text\n- a", "en", "wiki", 17), (2, "é ﬂy `c` ☃\x0b**b*", "de", "src", 4), (3, None, "en", "a", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    bodies = docs.select("doc_id", F.expr(BODY).alias("body"))
    both = T.with_clean_text(bodies, "body", "text").withColumn("chain", T.clean_text(F.col("body"))).collect()
    assert [r["text"] for r in both] == [r["chain"] for r in both]
    assert [r["text"] for r in both][:2] == [T.python_clean(r["body"]) for r in both if r["body"]]
    names = list(SQL_RULES)
    steps = bodies.select(T.markup_digests(F.col("body"), names).alias("d"), *[F.md5(T.markup_step(F.col("body"), n)).alias(n) for n in names])
    for row in steps.collect():
        assert [row["d"][n] for n in names] == [row[n] for n in names]


def test_state_rows_are_not_counted(spark):
    name = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    with J.durable_state(spark):
        assert spark.conf.get(name) == "false"


def test_cross_validation_turns_texts_into_features_once(spark):
    rows = [(i, f"{'bad' if i % 3 == 0 else 'good'} word{i % 7} case", int(i % 3 == 0 or i % 11 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    estimator = TR.text_classifier(n_features=64, max_iter=5)
    features, rest = TR.fixed_features(df, estimator, ["id", "label"])
    assert features.columns == ["id", "label", "__tf"] and len(rest.getStages()) == 2
    per_fold, _ = TR.cross_validate(df, ["id"], estimator, k=3)
    folds = TR.kfold(df, ["id"], 3)
    for row in per_fold.collect():
        model = estimator.fit(folds.where(F.col("fold") != row["fold"]))
        wanted = M.compute_metrics(TR.predict(folds.where(F.col("fold") == row["fold"]), model)).first()
        assert [row[c] for c in ("accuracy", "f1", "roc_auc")] == pytest.approx([wanted[c] for c in ("accuracy", "f1", "roc_auc")])


def test_texts_are_aligned_in_small_batches(monkeypatch):
    align = pytest.importorskip("issuelens.llm.align")
    seen = []

    def spy(both, pieces, owner, n):
        seen.append(sum(map(len, pieces)))
        nothing = pa.array([], pa.int64())
        return {"whole": np.ones(n, bool), "counts": np.zeros((3, n), np.int64), "lines": [""] * n, "pairs": pa.table({"row": nothing, "key": nothing, "n_sum": nothing})}

    monkeypatch.setattr(align, "linked_tokens", spy)
    align.Block(None, piece=100).add(pa.record_batch({"doc_id": [1, 2]}), ["word " * 300, "other " * 200], 2700)
    assert sum(seen) == 2702 and max(seen) <= 200
