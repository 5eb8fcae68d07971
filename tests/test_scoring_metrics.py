"""Scoring, ensembles and metrics: hand-worked values and brute force."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuelens.functions import arrays
from issuelens.operators import metrics as M
from issuelens.operators import relational as R
from issuelens.operators import scoring as I
from issuelens.operators import training as TR
from issuelens.plans.score_job import predict_and_evaluate, predict_table

# Truth, guess, probability of class 1: four hits, two misses, one false alarm, five rejections.
DOZEN = [(1, 1, 0.77), (1, 1, 0.64), (1, 0, 0.41), (0, 0, 0.33), (0, 0, 0.12), (0, 1, 0.58)]
DOZEN += [(0, 0, 0.07), (1, 1, 0.93), (0, 0, 0.45), (1, 1, 0.51), (0, 0, 0.28), (1, 0, 0.19)]


def predictions(spark, rows):
    data = [(i, y, c, [1 - p, p]) for i, (y, c, p) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, label int, predicted_class int, class_probabilities array<double>")


def test_metrics_of_a_dozen(spark):
    row = M.compute_metrics(predictions(spark, DOZEN)).first()
    assert row["confusion_matrix"] == [[5, 1], [2, 4]]
    wanted = {"accuracy": 9 / 12, "precision": 4 / 5, "recall": 4 / 6, "f1": 8 / 11, "mcc": 18 / 1260**0.5, "roc_auc": 29 / 36}
    for name, value in wanted.items():
        assert row[name] == pytest.approx(value)


def test_perfect_and_one_class(spark):
    row = M.compute_metrics(predictions(spark, [(1, 1, 0.95), (0, 0, 0.05)] * 10)).first()
    assert [row[c] for c in ("accuracy", "f1", "mcc", "roc_auc")] == [1.0] * 4
    row = M.compute_metrics(predictions(spark, [(1, 1, 0.9)] * 3)).first()
    assert row["mcc"] == 0.0 and row["roc_auc"] is None and row["confusion_matrix"] == [[0, 0], [0, 3]]


def test_text_truth_and_text_predictions(spark):
    rows = predictions(spark, DOZEN)
    name = lambda c: F.when(F.col(c) == 1, "td").otherwise("non_td")
    for cols in (["label"], ["predicted_class"], ["label", "predicted_class"]):
        row = M.compute_metrics(rows.withColumns({c: name(c) for c in cols})).first()
        assert row["f1"] == pytest.approx(8 / 11) and row["roc_auc"] == pytest.approx(29 / 36)


SCORES = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=1, max_size=80)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(SCORES, st.sampled_from([2, 5, 1024]))
def test_auc_equals_pair_counting(spark, rows, ranges):
    df = spark.createDataFrame([(y, s / 12) for y, s in rows], "label int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    got = M.roc_auc(df, ranges=ranges).first()["roc_auc"]
    if pos and neg:
        assert got == pytest.approx(wins / (len(pos) * len(neg)))
    else:
        assert got is None


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(SCORES.filter(lambda rows: any(y for y, _ in rows) and not all(y for y, _ in rows)))
def test_curves_equal_counting(spark, rows):
    df = spark.createDataFrame([(y, s / 12) for y, s in rows], "label int, score double")
    n_pos = sum(y for y, _ in rows)
    roc = {(r["threshold"], round(r["fpr"], 9), round(r["tpr"], 9)) for r in M.roc_curve(df, ranges=4).collect()}
    pr = {(r["threshold"], round(r["precision"], 9), round(r["recall"], 9)) for r in M.pr_curve(df, ranges=4).collect()}
    want_roc, want_pr, area, last = {(None, 0.0, 0.0)}, {(None, 1.0, 0.0)}, 0.0, (1.0, 0.0)
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(y for y, s in rows if s >= t)
        fp = sum(1 - y for y, s in rows if s >= t)
        want_roc.add((t / 12, round(fp / (len(rows) - n_pos), 9), round(tp / n_pos, 9)))
        p, r = tp / (tp + fp), tp / n_pos
        want_pr.add((t / 12, round(p, 9), round(r, 9)))
        area += (r - last[1]) * (p + last[0]) / 2
        last = (p, r)
    assert roc == want_roc and pr == want_pr
    assert M.pr_auc(df, ranges=4).first()["pr_auc"] == pytest.approx(area)


def test_saturated_scores_stay_split(spark):
    """A third of the rows at one score, the rest crowded just below one."""
    df = spark.range(30000).select(
        (F.col("id") % 3 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 1, 1.0).otherwise(1 - (F.col("id") + 1) / 1e9).alias("score"),
    )
    curve = M.score_curve(df, ranges=64)
    assert curve.count() == 20001
    splits = M._score_splits(df, "score", 64)
    assert len(splits) > 30


def test_report_values(spark):
    rows = {r["class"]: r for r in M.classification_report(predictions(spark, DOZEN)).collect()}
    assert set(rows) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rows["1"]["precision"] == 0.8 and rows["1"]["support"] == 6.0 and rows["accuracy"]["support"] == 0.75


def test_t_values():
    # Textbook table values.
    for freedom, value in [(1, 12.7062), (2, 4.3027), (4, 2.7764), (9, 2.2622), (30, 2.0423)]:
        assert M.t_critical(0.95, freedom) == pytest.approx(value, abs=1e-4)
    assert M.t_critical(0.99, 4) == pytest.approx(4.6041, abs=1e-4)


def test_kfold_summary(spark):
    values = [0.7, 0.8, 0.75, 0.9, 0.85]
    df = spark.createDataFrame([(i, "f1", v) for i, v in enumerate(values)], "fold int, metric string, value double")
    row = M.kfold_summary(df, 5).first()
    std = math.sqrt(sum((v - 0.8) ** 2 for v in values) / 5)
    assert row["mean"] == pytest.approx(0.8) and row["std"] == pytest.approx(std)
    assert row["ci_upper"] - row["mean"] == pytest.approx(2.776445 * std / math.sqrt(5), abs=1e-5)


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([0.0, 2.0],), ([0.0, 1.0],), ([1.0, 1.0],), ([1000.0, -1000.0],)], "logits array<double>")
    rows = I.predict_logits(df).collect()
    assert [r["predicted_class"] for r in rows] == [1, 1, 0, 0]
    assert rows[0]["predicted_probability"] == pytest.approx(0.880797, abs=1e-6)
    assert rows[1]["predicted_probability"] == pytest.approx(0.731059, abs=1e-6)
    assert all(sum(r["class_probabilities"]) == pytest.approx(1.0) for r in rows)


def test_half_even_rounding(spark):
    df = spark.createDataFrame([([0.0625, 0.1875],)], "p array<double>")
    assert df.select(arrays.round_half_even(F.col("p"))).first()[0] == [0.062, 0.188]


def ensemble(spark, a, b, weights):
    df = spark.createDataFrame([(1, a, b)], "id int, a array<double>, b array<double>")
    weights = I.normalized_weights(["a", "b"], weights)
    wide = I.ensemble_wide(df, weights).first()
    long = I.ensemble_long(df.unpivot("id", ["a", "b"], "model_id", "class_probabilities"), ["id"], weights).first()
    assert wide["predicted_class"] == long["predicted_class"]
    assert wide["class_probabilities"] == pytest.approx(long["class_probabilities"])
    return wide


def test_ensembles(spark):
    row = ensemble(spark, [0.2, 0.8], [0.4, 0.6], None)
    assert row["predicted_class"] == 1 and row["class_probabilities"][1] == pytest.approx(0.7)
    assert ensemble(spark, [0.2, 0.8], [0.4, 0.6], [3, 1])["class_probabilities"][1] == pytest.approx(0.75)
    assert ensemble(spark, None, [0.4, 0.6], [3, 1])["class_probabilities"][1] == pytest.approx(0.6)
    row = ensemble(spark, None, None, [3, 1])
    assert row["predicted_class"] == 0 and row["class_probabilities"] == [0.5, 0.5]


def test_ensemble_argument_errors():
    with pytest.raises(ValueError, match="1 weights for 2 members"):
        I.normalized_weights(["a", "b"], [1.0])
    with pytest.raises(ValueError):
        I.normalized_weights([])
    assert I.normalized_weights(["a", "b"], [3, 1]) == {"a": 0.75, "b": 0.25}


def test_single_text(spark):
    score = lambda df: predict_table(df, lambda d: I.score_with(d, "text", lambda: lambda ts: [[0.1, 0.9]] * len(ts)))
    row = I.predict_single(spark, "some debt", score)
    assert row["text"] == "some debt" and row["predicted_class"] == 1
    with pytest.raises(ValueError, match="no text"):
        I.predict_single(spark, "", score)


def test_user_model_batches_and_failures(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(70)], "id long, text string")

    def factory():
        def score(texts):
            assert len(texts) <= 32
            if "x" * 69 in texts:
                raise RuntimeError("broken batch")
            return [[1 - len(t) / 100, len(t) / 100] for t in texts]

        return score

    rows = I.score_with(df.coalesce(1), "text", factory, skip_failed=True).orderBy("id").collect()
    assert rows[3]["class_probabilities"] == [1.0, 0.0]
    assert rows[10]["class_probabilities"][1] == pytest.approx(0.1)
    assert rows[69]["class_probabilities"] is None
    with pytest.raises(Exception, match="broken batch"):
        I.score_with(df, "text", factory).collect()


def test_predict_and_evaluate(spark):
    df = spark.createDataFrame([("aa", 1), ("b", 0), (None, 0)], "text string, label int")
    score = lambda d: I.score_with(d, "text", lambda: lambda ts: [[float(len(t) < 2), float(len(t) > 1)] for t in ts])
    predicted, metrics = predict_and_evaluate(df, score)
    assert predicted.columns == ["text", "label", "class_probabilities", "predicted_class", "predicted_probability"]
    assert metrics.first()["accuracy"] == 1.0
    assert predict_and_evaluate(df.drop("label"), score)[1] is None
    with pytest.raises(ValueError, match="no column"):
        predict_table(df, score, "missing")


@pytest.mark.parametrize("limit", [10_000, 1])
def test_linear_logits_of_small_and_large_vocabularies(spark, limit):
    df = spark.createDataFrame([(1, "a a b"), (2, ""), (3, "z")], "id int, text string")
    weights = spark.createDataFrame([("a", 1, 0.5), ("b", 1, -2.0), ("b", 0, 1.0)], "token string, class int, weight double")
    rows = {r["id"]: r["logits"] for r in I.linear_logits(df, ["id"], "text", weights, [0.0, 0.25], max_rows=limit).collect()}
    assert rows == {1: [1.0, -0.75], 2: [0.0, 0.25], 3: [0.0, 0.25]}


def test_small_weights_are_a_constant_of_the_scan(spark, tmp_path):
    spark.range(500).select("id", F.concat_ws(" ", F.lit("good"), F.col("id")).alias("text")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    weights = spark.range(2000).select(F.col("id").cast("string").alias("token"), F.lit(1).alias("class"), (F.col("id") / 8).alias("weight"))
    logits = I.linear_logits(df, ["id"], "text", weights, [0.0, 1.0])
    plan = executed(logits)
    assert "Exchange" not in plan and "Generate" not in plan and "from_json" not in plan
    assert all(r["logits"] == [0.0, 1.0 + r["id"] / 8] for r in logits.collect())


def test_top_classes(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.2, 0.1],)], "class_probabilities array<double>")
    names = dict(enumerate("abcd"))
    row = I.add_confidence(I.add_top_classes(df, names, 3), 0.6).first()
    assert [row[f"Top_{i}_Class"] for i in (1, 2, 3)] == ["b", "a", "c"]
    assert row["confidence"] == 0.5 and row["is_confident"] is False
    with pytest.raises(ValueError):
        I.add_top_classes(df, names, 5)


def test_registry(spark):
    assert I.model_registry(spark).count() == len(I.CATEGORIES) == 23
    members = I.group_members(spark).select("model_id")
    assert members.join(I.model_registry(spark), "model_id", "left_anti").count() == 0
    groups = {r["model_group"]: r["count"] for r in I.group_members(spark).groupBy("model_group").count().collect()}
    assert groups["Quality"] == 7 and groups["Types_TD"] == 8 and groups["TD"] == 1


def test_log_loss(spark):
    df = predictions(spark, [(1, 1, 0.8), (0, 0, 0.4)])
    plain = M.weighted_log_loss(df).first()["loss"]
    assert plain == pytest.approx(-(math.log(0.8) + math.log(0.6)) / 2)
    weighted = M.weighted_log_loss(df, class_weights={0: 1.0, 1: 3.0}).first()["loss"]
    assert weighted == pytest.approx(-(3 * math.log(0.8) + math.log(0.6)) / 4)


def test_early_stopping(spark):
    losses = [1.0, 0.8, 0.795, 0.79, 0.789, 0.5]
    df = spark.createDataFrame(list(enumerate(losses, 1)), "epoch int, loss double")
    row = TR.early_stopping(df).first()
    assert (row["best_epoch"], row["best_loss"], row["stop_epoch"]) == (6, 0.5, 5)
    assert TR.early_stopping(df, patience=5).first()["stop_epoch"] is None


def executed(df):
    """The plan as it ran."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_text_is_shuffled_to_find_copies(spark, tmp_path):
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    df.write.parquet(str(tmp_path / "texts"))
    kept = R.keep_first_by_text(spark.read.parquet(str(tmp_path / "texts")), "text", ["id"])
    assert kept.count() == 6001 and kept.filter("text = 'copy'").first()["id"] == 0
    plan = executed(kept)
    assert "hashpartitioning" not in plan and "SortAggregate" not in plan and "BroadcastHashJoin" in plan
    groups = R.repeated_texts(df, F.sha2("text", 256), ["id"])
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_count" in plan


@pytest.mark.parametrize("limit", [10_000, 0])
def test_first_of_copies(spark, monkeypatch, limit):
    monkeypatch.setattr("issuelens.operators.small.inline_if_small.__defaults__", (limit, 8 << 20))
    rows = [(3, "b", "x"), (1, "b", "x"), (1, "a", "x"), (None, "a", "x"), (7, "c", "y"), (7, "c", "y"), (9, "c", "y"), (None, "z", None), (None, "z", "only")]
    df = spark.createDataFrame(rows, "id long, part string, text string")
    got = sorted(tuple(r) for r in R.keep_first_by_text(df.where("text IS NOT NULL"), "text", ["part", "id"]).collect() if r["id"])
    assert got == [(7, "c", "y")]
    got = R.keep_first_by_text(df.where("text IS NOT NULL AND id IS NOT NULL"), "text", ["id", "part"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", "x"), (7, "c", "y")]
    assert R.keep_first_by_text(df.limit(0), "text", ["id"]).count() == 0


def test_shuffle_partitions_do_not_matter(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("score", F.col("doc_id") % 17 / 17)
    found = set()
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.add(M.roc_auc(labels, "toxic").first()["roc_auc"])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(found) == 1


def test_auc_plan_reads_once_and_curve_reuses(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("score", F.col("doc_id") % 17 / 17)
    plan = M.roc_auc(labels, "toxic")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    curve = M.roc_curve(labels, "toxic")
    curve.collect()
    assert "ReusedExchange" in curve._jdf.queryExecution().executedPlan().toString()


def test_certain_wrong_answers_cost_and_missing_labels_do_not(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (0, [0.0, 1.0]), (None, [0.5, 0.5]), (1, None)], "label int, class_probabilities array<double>")
    assert M.weighted_log_loss(df).first()["loss"] == pytest.approx(15 * 2.302585092994046 / 2)


def test_nan_scores_and_other_labels_do_not_count(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, float("nan")), (2, 0.95), (None, 0.2)], "label int, score double")
    assert M.roc_auc(df).first()["roc_auc"] == 1.0


def test_equal_keys_are_scored_each_on_its_own(spark):
    df = spark.createDataFrame([(1, "good"), (1, "good good")], "id long, text string")
    weights = spark.createDataFrame([("good", 0, 0.0), ("good", 1, 1.0)], "token string, class int, weight double")
    got = sorted(r["logits"][1] for r in I.linear_logits(df, ["id"], "text", weights, [0.0, 0.0]).collect())
    assert got == [1.0, 2.0]


def test_model_is_loaded_once_per_worker():
    from pyspark import cloudpickle

    factory = cloudpickle.dumps(lambda: object())
    first = I.loaded_scorer(factory)
    assert all(I.loaded_scorer(factory) is first for _ in range(5))


def test_unlisted_models_keep_their_id(spark):
    scores = spark.createDataFrame([(1, "port", 1), (1, "own_model", 1), (2, "port", 0)], "id int, model_id string, predicted_class int")
    assert [tuple(r) for r in I.debt_categories(scores, I.model_registry(spark), ["id"]).collect()] == [(1, ["Portability", "own_model"])]


def test_join_sides_are_bounded_by_rows_and_bytes(spark):
    from issuelens.operators.small import inline_if_small

    few, many = spark.range(500), spark.range(501)
    assert inline_if_small(few, max_rows=500) is not few
    assert inline_if_small(many, max_rows=500) is many
    wide = spark.range(300).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    short = wide.limit(70)
    assert inline_if_small(wide) is wide and inline_if_small(short, max_bytes=1 << 20) is short
    assert inline_if_small(short) is not short


def test_naive_bayes_by_hand(spark):
    rows = [(1, 0, "a a b"), (2, 1, "b c"), (3, 1, None), (4, None, "x")]
    df = spark.createDataFrame(rows, "id long, label int, text string")
    model = {(r["token"], r["class"]): r["weight"] for r in TR.fit_bayes(df).collect()}
    log = __import__("math").log
    assert model[("a", 0)] == pytest.approx(log(3 / 6)) and model[("a", 1)] == pytest.approx(log(1 / 5))
    assert model[("c", 0)] == pytest.approx(log(1 / 6)) and model[("c", 1)] == pytest.approx(log(2 / 5))
    assert model[("", 0)] == pytest.approx(log(1 / 3)) and ("x", 0) not in model
    scored = {r["id"]: r["predicted_class"] for r in TR.predict_bayes(df, TR.fit_bayes(df), ["id"]).collect()}
    assert scored == {1: 0, 2: 1, 3: 1, 4: 1}


def test_bayes_folds_equal_separate_models(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    rows = rows.withColumn("fold", (F.col("doc_id") % 3 + 1).cast("int"))
    got = {r["doc_id"]: r["class_probabilities"][1] for r in TR.cross_validate_bayes(rows, ["doc_id"], k=3).collect()}
    model = TR.fit_bayes(rows.where("fold <> 2"))
    want = {r["doc_id"]: r["class_probabilities"][1] for r in TR.predict_bayes(rows.where("fold = 2"), model, ["doc_id"]).collect()}
    assert len(got) == rows.count() and all(got[d] == pytest.approx(p) for d, p in want.items())


def test_class_scores_of_few_classes(spark, tmp_path):
    """Classes that no row has get no logit; an empty table has no rows."""
    from issuelens.plans.registry import class_scores

    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "vec_id long, label int, embedding array<float>")
    for name, some in {"few": rows, "none": rows.limit(0)}.items():
        some.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    got = {r["vec_id"]: r["logits"] for r in class_scores(spark, f"{tmp_path}/few", 4).collect()}
    assert got == {1: [10.0, None, 0.0, None], 2: [0.0, None, 10.0, None]}
    assert class_scores(spark, f"{tmp_path}/none", 4).collect() == []
