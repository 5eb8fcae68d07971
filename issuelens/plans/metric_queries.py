"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens.functions import arrays
from issuelens.operators import metrics as M
from issuelens.operators.sampling import kfold
from issuelens.plans.registry import CLASS_SCORES, PREDICTED, class_scores, predictions, query, r6, table
from issuelens.plans.sampling_queries import KEY
from issuelens.plans.score_job import predict_and_evaluate
from issuelens.session import materialize

SCORES = ["accuracy", "precision", "recall", "f1", "mcc"]


def rounded(frame, *names):
    return frame.withColumns({n: r6(n) for n in names})


def counts_sql(source: str, group: str = "") -> str:
    comma, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    return f"""counts AS (SELECT {comma}CAST(count(*) FILTER (label = 1 AND predicted_class = 1) AS DOUBLE) AS tp,
      CAST(count(*) FILTER (label = 0 AND predicted_class = 0) AS DOUBLE) AS tn,
      CAST(count(*) FILTER (label = 0 AND predicted_class = 1) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (label = 1 AND predicted_class = 0) AS DOUBLE) AS fn FROM {source}{by})"""


SCORES_SQL = """round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"""


def auc_sql(source: str, label: str, score: str, group: str = "") -> str:
    """(group, roc_auc) in SQL, with one window over all scores."""
    comma, by, part = (f"{group}, ", f"GROUP BY {group}", f"PARTITION BY {group}") if group else ("", "", "")
    return f"""by_score AS (SELECT {comma}{score}, count(*) FILTER ({label} = 1) AS pos, count(*) FILTER ({label} <> 1) AS neg
        FROM {source} GROUP BY {comma}{score}),
      running AS (SELECT *, sum(neg) OVER ({part} ORDER BY {score}) - neg AS below FROM by_score),
      auc AS (SELECT {comma}CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0) AS roc_auc
        FROM running {by})"""


@query(
    f"""WITH {PREDICTED}, {counts_sql('predicted')}, {auc_sql('predicted', 'label', 'z')}
    SELECT {SCORES_SQL}, '[[' || CAST(tn AS BIGINT) || ', ' || CAST(fp AS BIGINT) || '], [' || CAST(fn AS BIGINT) || ', '
      || CAST(tp AS BIGINT) || ']]' AS confusion_matrix, round(roc_auc, 6) AS roc_auc FROM counts, auc"""
)
def metrics_binary(spark, folder):
    scores = M.compute_metrics(predictions(spark, folder))
    lines = F.transform("confusion_matrix", lambda line: F.concat(F.lit("["), F.array_join(line.cast("array<string>"), ", "), F.lit("]")))
    text = F.concat(F.lit("["), F.array_join(lines, ", "), F.lit("]"))
    return rounded(scores, *SCORES, "roc_auc").withColumn("confusion_matrix", text)


@query(
    f"""WITH {PREDICTED}, {counts_sql('predicted', 'source')}, {auc_sql('predicted', 'label', 'z', 'source')}
    SELECT source, {SCORES_SQL}, round(roc_auc, 6) AS roc_auc FROM counts JOIN auc USING (source)"""
)
def metrics_by_source(spark, folder):
    scores = M.compute_metrics(predictions(spark, folder), by=["source"]).drop("confusion_matrix")
    return rounded(scores, *SCORES, "roc_auc")


@query(f"WITH {PREDICTED}, {counts_sql('predicted')} SELECT {SCORES_SQL} FROM counts")
def metrics_aligned_labels(spark, folder):
    rows = predictions(spark, folder)
    named = rows.withColumn("label", F.when(F.col("label") == 1, "toxic").otherwise("non_toxic"))
    scores = M.compute_metrics(named, probabilities=None).drop("confusion_matrix")
    return rounded(scores, *SCORES)


@query(
    f"""WITH {PREDICTED}, grid AS (SELECT a.i AS label, b.i AS predicted FROM range(2) a(i), range(2) b(i))
    SELECT CAST(g.label AS INTEGER) AS label, CAST(g.predicted AS INTEGER) AS predicted, count(p.doc_id) AS n
    FROM grid g LEFT JOIN predicted p ON p.label = g.label AND p.predicted_class = g.predicted GROUP BY ALL"""
)
def confusion_matrix(spark, folder):
    return M.confusion_matrix(predictions(spark, folder), n_classes=2)


@query(f"WITH {PREDICTED}, {auc_sql('predicted', 'label', 'z')} SELECT round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc(spark, folder):
    return rounded(M.roc_auc(predictions(spark, folder), "label", "z"), "roc_auc")


CURVE = f"""{PREDICTED}, by_score AS (SELECT z, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg
    FROM predicted GROUP BY z),
  curve AS (SELECT z, pos, neg, sum(pos) OVER (ORDER BY z DESC) AS tp, sum(neg) OVER (ORDER BY z DESC) AS fp,
    sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM by_score)"""


@query(
    f"""WITH {CURVE} SELECT z AS threshold, round(CAST(fp AS DOUBLE) / n_neg, 6) AS fpr, round(CAST(tp AS DOUBLE) / n_pos, 6) AS tpr
    FROM curve UNION ALL SELECT NULL, 0.0, 0.0"""
)
def roc_curve(spark, folder):
    return rounded(M.roc_curve(predictions(spark, folder), "label", "z"), "fpr", "tpr")


@query(
    f"""WITH {CURVE} SELECT z AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
      round(CAST(tp AS DOUBLE) / n_pos, 6) AS recall FROM curve UNION ALL SELECT NULL, 1.0, 0.0"""
)
def pr_curve(spark, folder):
    return rounded(M.pr_curve(predictions(spark, folder), "label", "z"), "precision", "recall")


@query(
    f"""WITH {CURVE}, points AS (SELECT z, CAST(tp AS DOUBLE) / (tp + fp) AS p, CAST(tp AS DOUBLE) / n_pos AS r FROM curve),
      pairs AS (SELECT p, r, lag(p, 1, 1.0) OVER (ORDER BY z DESC) AS p0, lag(r, 1, 0.0) OVER (ORDER BY z DESC) AS r0 FROM points)
    SELECT round(sum((r - r0) * (p + p0) / 2), 6) AS pr_auc FROM pairs"""
)
def pr_auc(spark, folder):
    return rounded(M.pr_auc(predictions(spark, folder), "label", "z"), "pr_auc")


def class_probabilities(spark, folder):
    rows = class_scores(spark, folder)
    return rows.withColumn("class_probabilities", arrays.softmax(F.col("logits")))


# Logits rank like any score within a class, and compare alike in both engines.
PER_CLASS = f"""{CLASS_SCORES}, per_class AS (
  SELECT CAST(unnest(range(10)) AS INTEGER) AS class, unnest(logits) AS score, label FROM class_scores),
  one_vs_rest AS (SELECT class, score, CASE WHEN label = class THEN 1 ELSE 0 END AS y FROM per_class)"""


@query(
    f"""WITH {PER_CLASS}, {auc_sql('one_vs_rest', 'y', 'score', 'class')}
    SELECT class, round(roc_auc, 6) AS roc_auc FROM auc"""
)
def one_vs_rest_auc(spark, folder):
    return rounded(M.one_vs_rest_auc(class_scores(spark, folder), "label", "logits"), "roc_auc")


@query(
    f"""WITH {PER_CLASS}, by_score AS (SELECT class, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
        FROM one_vs_rest GROUP BY class, score),
      curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS n_pos,
        sum(neg) OVER (PARTITION BY class) AS n_neg FROM by_score WINDOW w AS (PARTITION BY class ORDER BY score DESC))
    SELECT class, round(score, 6) AS threshold, round(CAST(fp AS DOUBLE) / n_neg, 6) AS fpr,
      round(CAST(tp AS DOUBLE) / nullif(n_pos, 0), 6) AS tpr FROM curve
    UNION ALL SELECT DISTINCT class, NULL, 0.0, 0.0 FROM per_class"""
)
def one_vs_rest_roc(spark, folder):
    return rounded(M.one_vs_rest_roc(class_scores(spark, folder), "label", "logits"), "threshold", "fpr", "tpr")


@query(
    f"""WITH {CLASS_SCORES}, guesses AS (SELECT label, list_position(logits, list_max(logits)) - 1 AS predicted FROM class_scores),
      grid AS (SELECT a.i AS label, b.i AS predicted FROM range(10) a(i), range(10) b(i))
    SELECT CAST(g.label AS INTEGER) AS label, CAST(g.predicted AS INTEGER) AS predicted, count(s.label) AS n
    FROM grid g LEFT JOIN guesses s ON s.label = g.label AND s.predicted = g.predicted GROUP BY ALL"""
)
def confusion_matrix_multiclass(spark, folder):
    return M.confusion_from_probabilities(class_probabilities(spark, folder), 10)


def report_sql(source: str) -> str:
    return f"""classes AS (SELECT label AS c FROM {source} UNION SELECT predicted FROM {source}),
      per_class AS (SELECT c, CAST(count(*) FILTER (label = c AND predicted = c) AS DOUBLE) AS tp,
        CAST(count(*) FILTER (label = c) AS DOUBLE) AS s, CAST(count(*) FILTER (predicted = c) AS DOUBLE) AS g
        FROM {source}, classes GROUP BY c),
      scores AS (SELECT c, tp, s, coalesce(tp / nullif(g, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r,
        coalesce(2 * tp / nullif(g + s, 0), 0) AS f FROM per_class),
      report AS (SELECT CAST(c AS VARCHAR) AS class, p AS precision, r AS recall, f AS f1_score, s AS support FROM scores
        UNION ALL SELECT 'accuracy', sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s) FROM scores
        UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM scores
        UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM scores)
      SELECT class, round_even(precision, 3) AS precision, round_even(recall, 3) AS recall, round_even(f1_score, 3) AS f1_score,
        round_even(support, 3) AS support FROM report"""


@query(f"WITH {PREDICTED}, pairs AS (SELECT label, predicted_class AS predicted FROM predicted), {report_sql('pairs')}")
def classification_report(spark, folder):
    return M.classification_report(predictions(spark, folder))


@query(
    f"""WITH {CLASS_SCORES}, pairs AS (SELECT label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted
      FROM class_scores), {report_sql('pairs')}"""
)
def classification_report_multiclass(spark, folder):
    rows = class_scores(spark, folder).withColumn("predicted", arrays.argmax(F.col("logits")))
    return M.classification_report(rows, "label", "predicted")


FOLDED = f"""{PREDICTED}, ordered AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n
    FROM predicted),
  folded AS (SELECT *, CAST(CASE WHEN r <= (n % 5) * (n // 5 + 1) THEN (r - 1) // (n // 5 + 1)
    ELSE n % 5 + (r - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END + 1 AS INTEGER) AS fold FROM ordered),
  {counts_sql('folded', 'fold')}, {auc_sql('folded', 'label', 'z', 'fold')}"""


def fold_metrics(spark, folder):
    return M.compute_metrics(kfold(predictions(spark, folder), KEY, 5), by=["fold"]).drop("confusion_matrix")


@query(f"WITH {FOLDED} SELECT fold, {SCORES_SQL}, round(roc_auc, 6) AS roc_auc FROM counts JOIN auc USING (fold)")
def kfold_metrics(spark, folder):
    return rounded(fold_metrics(spark, folder), *SCORES, "roc_auc")


@query(
    f"""WITH {FOLDED}, scores AS (SELECT fold, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
        coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
        coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc, roc_auc
        FROM counts JOIN auc USING (fold)),
      long AS (UNPIVOT scores ON accuracy, precision, recall, f1, mcc, roc_auc INTO NAME metric VALUE value),
      summary AS (SELECT metric, avg(value) AS mean, stddev_pop(value) AS std FROM long GROUP BY metric)
    SELECT metric, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - 2.7764451051977987 * std / sqrt(5), 6) AS ci_lower,
      round(mean + 2.7764451051977987 * std / sqrt(5), 6) AS ci_upper FROM summary"""
)
def kfold_summary(spark, folder):
    summary = M.kfold_summary(M.long_metrics(fold_metrics(spark, folder)), 5)
    return rounded(summary, "mean", "std", "ci_lower", "ci_upper")


LOSS = "-ln(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END)"


@query(f"WITH {PREDICTED} SELECT round(avg({LOSS}), 6) AS loss FROM predicted")
def log_loss(spark, folder):
    return rounded(M.weighted_log_loss(predictions(spark, folder)), "loss")


@query(
    f"""WITH {PREDICTED} SELECT source, round(sum(CASE WHEN label = 1 THEN 3 ELSE 1 END * {LOSS})
      / sum(CASE WHEN label = 1 THEN 3 ELSE 1 END), 6) AS loss FROM predicted GROUP BY source"""
)
def weighted_log_loss(spark, folder):
    return rounded(M.weighted_log_loss(predictions(spark, folder), class_weights={0: 1.0, 1: 3.0}, by=["source"]), "loss")


# Scores far from zero become certain: rows that are right or wrong with probability 0 or 1, and missing labels.
CERTAIN = f"""{PREDICTED}, certain AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN label END AS label,
    CASE WHEN z > 2 THEN 1.0 WHEN z < -2 THEN 0.0 ELSE p1 END AS p1 FROM predicted)"""


def certain_predictions(spark, folder):
    p = F.when(F.col("z") > 2, 1.0).when(F.col("z") < -2, 0.0).otherwise(F.col("class_probabilities")[1])
    rows = predictions(spark, folder).withColumn("class_probabilities", F.array(1 - p, p))
    return rows.withColumn("label", F.when(F.col("doc_id") % 7 != 0, F.col("label")))


@query(
    f"""WITH {CERTAIN} SELECT round(avg(-ln(greatest(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END, 1e-15))), 6) AS loss
    FROM certain WHERE label IS NOT NULL"""
)
def log_loss_certain(spark, folder):
    return rounded(M.weighted_log_loss(certain_predictions(spark, folder)), "loss")


UNSCORED = f"""{PREDICTED}, scored AS (SELECT label, z FROM predicted WHERE doc_id % 5 <> 0)"""


@query(f"WITH {UNSCORED}, {auc_sql('scored', 'label', 'z')} SELECT round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc_with_nan(spark, folder):
    """Every fifth row has NaN as its score and does not count."""
    rows = predictions(spark, folder).withColumn("z", F.when(F.col("doc_id") % 5 == 0, float("nan")).otherwise(F.col("z")))
    return rounded(M.roc_auc(rows, "label", "z"), "roc_auc")


# Two classes with a precision of exactly 1/16, which rounds to 0.062.
TIED = "tied AS (SELECT CASE WHEN doc_id % 16 = 0 THEN 1 ELSE 0 END AS label, 1 AS predicted FROM documents WHERE doc_id < (SELECT count(*) // 16 * 16 FROM documents))"


@query(f"WITH {TIED}, {report_sql('tied')}")
def classification_report_tie(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    whole = docs.agg((F.floor(F.count("*") / 16) * 16).alias("n"))
    rows = docs.join(F.broadcast(whole), F.col("doc_id") < F.col("n"))
    return M.classification_report(rows.select((F.col("doc_id") % 16 == 0).cast("int").alias("label"), F.lit(1).alias("predicted_class")))


@query(f"WITH {PREDICTED}, {counts_sql('predicted')}, {auc_sql('predicted', 'label', 'p1')} SELECT {SCORES_SQL}, round(roc_auc, 6) AS roc_auc FROM counts, auc")
def score_file_and_evaluate(spark, folder):
    """One job: score a written table, keep the predictions, evaluate them."""
    rows = materialize(predictions(spark, folder).select("doc_id", "label", "z", F.lit("t").alias("text")), "to-score")
    positive = 1 / (1 + F.exp(-F.col("z")))
    score = lambda df: df.withColumn("class_probabilities", F.array(1 - positive, positive))
    _, metrics = predict_and_evaluate(rows, score)
    return rounded(metrics.select(*SCORES, "roc_auc"), *SCORES, "roc_auc")
