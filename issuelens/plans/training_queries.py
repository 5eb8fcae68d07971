"""Training queries. Fitted numbers depend on the optimiser, so those have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens.functions.text import with_clean_text
from issuelens.operators import metrics as M
from issuelens.operators import training as TR
from issuelens.operators.sampling import kfold_hashed, stratified_split
from issuelens.plans.metric_queries import SCORES, SCORES_SQL, counts_sql, rounded
from issuelens.plans.registry import query, r6, table
from issuelens.plans.sampling_queries import DRAW, KEY
from issuelens.plans.text_queries import sql_words
from issuelens.session import materialize, scratch_path
from issuelens.sources.tables import spread


def training_texts(spark, folder):
    """Cleaned labelled texts, written once since every fit reads them again."""
    documents = spread(table(spark, folder, "documents").select("doc_id", F.col("text").alias("body")))
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    cleaned = with_clean_text(documents.join(labels, "doc_id"), "body", "text")
    return materialize(cleaned.select("doc_id", "text", "label"), "training")


FEATURES = 1 << 12


@query()
def train_and_evaluate(spark, folder):
    """Weighted fit on train, saved, loaded and evaluated on test."""
    rows = stratified_split(TR.add_class_weights(training_texts(spark, folder)), KEY)
    model = TR.fit(rows.filter("split = 'train'"), TR.text_classifier(n_features=FEATURES, max_iter=10, weighted=True))
    path = scratch_path(spark, "model")
    TR.save_model(model, path)
    scored = TR.predict(rows.filter("split = 'test'"), TR.load_model(path))
    scores = M.binary_scores(M.confusion_counts(scored)).drop("confusion_matrix")
    return rounded(scores, *SCORES)


@query()
def cross_validation(spark, folder):
    estimator = TR.text_classifier(n_features=FEATURES, max_iter=5)
    _, summary = TR.cross_validate(training_texts(spark, folder), KEY, estimator, k=3)
    return rounded(summary, "mean", "std", "ci_lower", "ci_upper")


@query()
def best_candidate(spark, folder):
    """Validation loss of each candidate, with the winner marked."""
    rows = stratified_split(training_texts(spark, folder), KEY)
    candidates = {f"reg_{r}": TR.text_classifier(n_features=FEATURES, max_iter=5, reg=r) for r in (0.01, 0.1)}
    winner, _, losses = TR.best_model(rows.filter("split = 'train'"), rows.filter("split = 'test'"), candidates)
    listed = spark.createDataFrame(list(losses.items()), "candidate string, loss double")
    return listed.withColumn("is_best", F.col("candidate") == winner)


@query(
    """SELECT toxic AS label, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS class_weight
    FROM labels GROUP BY toxic"""
)
def class_weights(spark, folder):
    rows = table(spark, folder, "labels").select(F.col("toxic").alias("label"))
    return rounded(TR.balanced_weights(rows), "class_weight")


# Naive Bayes: the same counts and logarithms in SQL. Token '' counts texts; fold 0 leaves nothing out.
BAYES = f"""texts AS (SELECT doc_id, text, toxic AS label, CAST({DRAW.format('doc_id')} % 5 AS INTEGER) + 1 AS fold
    FROM documents JOIN labels USING (doc_id)),
  words AS (SELECT doc_id, label, fold, unnest(list_prepend('', {sql_words("lower(coalesce(text, ''))")})) AS token FROM texts)"""


def bayes_sql(learned: str, alpha: str = "1.0") -> str:
    """weights (fold, token, w0, w1) of a relation (fold, label, token, n), one model a fold."""
    share = "ln(CASE WHEN token = '' THEN n{c} / texts ELSE (n{c} + CAST({a} AS DOUBLE)) / (s{c} + CAST({a} AS DOUBLE) * vocabulary) END) AS w{c}"
    return f"""wide AS (SELECT fold, token, CAST(sum(CASE WHEN label = 0 THEN n ELSE 0 END) AS DOUBLE) AS n0,
      CAST(sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS DOUBLE) AS n1 FROM {learned} GROUP BY ALL HAVING sum(n) > 0),
    sizes AS (SELECT fold, count(*) FILTER (token <> '') AS vocabulary, sum(n0) FILTER (token <> '') AS s0,
      sum(n1) FILTER (token <> '') AS s1, sum(n0 + n1) FILTER (token = '') AS texts FROM wide GROUP BY fold),
    weights AS (SELECT fold, token, {share.format(c=0, a=alpha)}, {share.format(c=1, a=alpha)} FROM wide JOIN sizes USING (fold))"""


SCORED = """sums AS (SELECT doc_id, label, h.fold, sum(w0) AS z0, sum(w1) AS z1 FROM held h JOIN weights w
    ON w.fold = h.model AND w.token = h.token GROUP BY ALL),
  predicted AS (SELECT *, CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS predicted_class,
    1 / (1 + exp(least(700, CASE WHEN label = 1 THEN z0 - z1 ELSE z1 - z0 END))) AS p FROM sums)"""
TRAIN = "learned AS (SELECT 0 AS fold, label, token, count(*) AS n FROM words WHERE fold < 5 GROUP BY ALL)"
TEST = "held AS (SELECT *, 0 AS model FROM words WHERE fold = 5)"


def bayes_texts(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = spread(table(spark, folder, "documents").select("doc_id", "text")).join(labels, "doc_id")
    return materialize(kfold_hashed(rows, KEY, 5), "bayes")


@query(f"WITH {BAYES}, {TRAIN}, {bayes_sql('learned')} SELECT token, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM weights")
def naive_bayes_weights(spark, folder):
    """The model as it comes back from disk."""
    path = scratch_path(spark, "bayes-model")
    TR.fit_bayes(bayes_texts(spark, folder).where("fold < 5")).write.parquet(path)
    model = spark.read.parquet(path)
    return model.groupBy("token").agg(*[r6(F.sum(F.when(F.col("class") == c, F.col("weight")))).alias(f"w{c}") for c in (0, 1)])


@query(f"WITH {BAYES}, {TRAIN}, {TEST}, {bayes_sql('learned')}, {SCORED}, {counts_sql('predicted')} SELECT {SCORES_SQL} FROM counts")
def naive_bayes_evaluate(spark, folder):
    """Fit on four folds, save, load, score the fifth."""
    rows, path = bayes_texts(spark, folder), scratch_path(spark, "bayes-model")
    TR.fit_bayes(rows.where("fold < 5")).write.parquet(path)
    scored = TR.predict_bayes(rows.where("fold = 5"), spark.read.parquet(path), ["doc_id", "label"])
    return rounded(M.binary_scores(M.confusion_counts(scored)).drop("confusion_matrix"), *SCORES)


LEFT_OUT = """counted AS (SELECT fold, label, token, count(*) AS n FROM words GROUP BY ALL),
  learned AS (SELECT f.fold, c.label, c.token, c.n FROM counted c JOIN (SELECT unnest(range(1, 6)) AS fold) f ON c.fold <> f.fold),
  held AS (SELECT *, fold AS model FROM words)"""


@query(f"WITH {BAYES}, {LEFT_OUT}, {bayes_sql('learned')}, {SCORED}, {counts_sql('predicted', 'fold')} SELECT fold, {SCORES_SQL} FROM counts")
def naive_bayes_cross_validation(spark, folder):
    """Every fold scored by the model of the others, from one count."""
    scored = TR.cross_validate_bayes(bayes_texts(spark, folder), KEY)
    scores = M.compute_metrics(scored, probabilities=None, by=["fold"]).drop("confusion_matrix")
    return rounded(scores, *SCORES)


SMOOTHINGS = (0.1, 1.0, 10.0)
BEST = " UNION ALL ".join(
    f"SELECT * FROM (WITH {bayes_sql('learned', str(a))}, {SCORED} SELECT 'smoothing_{a}' AS candidate, avg(-ln(greatest(p, 1e-15))) AS loss FROM predicted)"
    for a in SMOOTHINGS
)


@query(f"WITH {BAYES}, {TRAIN}, {TEST}, losses AS ({BEST}) SELECT candidate, round(loss, 6) AS loss, loss = (SELECT min(loss) FROM losses) AS is_best FROM losses")
def naive_bayes_best_candidate(spark, folder):
    """Held-out loss of each smoothing, with the winner marked."""
    rows = bayes_texts(spark, folder)
    counts = materialize(TR.token_totals(rows.where("fold < 5")), "counts")
    losses = {}
    for smoothing in SMOOTHINGS:
        scored = TR.predict_bayes(rows.where("fold = 5"), TR.bayes_weights(counts, smoothing=smoothing), ["doc_id", "label"])
        losses[f"smoothing_{smoothing}"] = M.weighted_log_loss(scored).first()["loss"]
    listed = spark.createDataFrame([(n, x, x == min(losses.values())) for n, x in losses.items()], "candidate string, loss double, is_best boolean")
    return rounded(listed, "loss")


# A loss history per run: the mean of a day's values stands for an epoch's loss.
@query(
    """WITH daily AS (SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS epoch,
        round(avg(value), 6) AS loss FROM events GROUP BY ALL),
      marked AS (SELECT *, min(loss) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM daily),
      better AS (SELECT *, max(CASE WHEN low IS NULL OR loss < low - 0.01 THEN epoch END) OVER (PARTITION BY event_type ORDER BY epoch) AS last FROM marked)
    SELECT event_type, CAST(arg_min(epoch, (loss, epoch)) AS INTEGER) AS best_epoch, min(loss) AS best_loss,
      CAST(min(CASE WHEN epoch - last >= 3 THEN epoch END) AS INTEGER) AS stop_epoch FROM better GROUP BY event_type"""
)
def early_stopping(spark, folder):
    epoch = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    history = table(spark, folder, "events").groupBy("event_type", epoch.alias("epoch")).agg(r6(F.avg("value")).alias("loss"))
    return TR.early_stopping(history, ["event_type"])
