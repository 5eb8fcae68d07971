"""Training on labelled text with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.functions.text import tokens
from issuelens.operators.metrics import LEAST_PROBABILITY, compute_metrics, kfold_summary, long_metrics, weighted_log_loss
from issuelens.operators.sampling import kfold
from issuelens.operators.scoring import add_prediction, linear_logits, predict_logits, score_with_model
from issuelens.operators.small import inline_if_small
from issuelens.session import materialize

WEIGHT = "class_weight"


def text_classifier(
    text: str = "text",
    label: str = "label",
    n_features: int = 1 << 18,
    reg: float = 0.01,
    max_iter: int = 20,
    stop_words: bool = False,
    weighted: bool = False,
) -> Pipeline:
    """Hashed TF-IDF and logistic regression; binary or multi-class by the label."""
    words = RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"(?U)[\s\x1c-\x1f]+")
    stages = [words]
    if stop_words:
        stages.append(StopWordsRemover(inputCol="__words", outputCol="__kept"))
    counted = HashingTF(inputCol=stages[-1].getOutputCol(), outputCol="__tf", numFeatures=n_features)
    scaled = IDF(inputCol="__tf", outputCol="__features")
    model = LogisticRegression(featuresCol="__features", labelCol=label, regParam=reg, maxIter=max_iter)
    if weighted:
        model = model.setWeightCol(WEIGHT)
    return Pipeline(stages=[*stages, counted, scaled, model])


def boosted_classifier(
    text: str = "text", label: str = "label", n_features: int = 1 << 10, validation: str = "is_validation"
) -> Pipeline:
    """Boosted trees that stop adding trees when the validation rows stop improving."""
    words = RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"(?U)[\s\x1c-\x1f]+")
    counted = HashingTF(inputCol="__words", outputCol="__features", numFeatures=n_features)
    trees = GBTClassifier(featuresCol="__features", labelCol=label, validationIndicatorCol=validation)
    return Pipeline(stages=[words, counted, trees])


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, class_weight) with rows / (classes * class rows)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    everything = Window.partitionBy(F.lit(0))
    weight = F.sum("__n").over(everything) / (F.count("*").over(everything) * F.col("__n"))
    return counts.select(label, weight.alias(WEIGHT))


def add_class_weights(df: DataFrame, label: str = "label", weights: Mapping[int, float] | None = None) -> DataFrame:
    """Attach given class weights, or balanced ones."""
    if weights is not None:
        entries = [F.lit(x) for c, w in weights.items() for x in (c, float(w))]
        return df.withColumn(WEIGHT, F.try_element_at(F.create_map(*entries), F.col(label)))
    return df.join(inline_if_small(balanced_weights(df, label)), label)


def fit(df: DataFrame, estimator: Pipeline | None = None) -> PipelineModel:
    return (estimator or text_classifier()).fit(df)


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    return add_prediction(score_with_model(df, model))


def fixed_features(df: DataFrame, estimator: Pipeline, columns: Sequence[str]) -> tuple[DataFrame, Pipeline]:
    """What the leading stages that learn nothing make of ``df``, and the stages that remain.

    Besides ``columns`` only those that a remaining stage names are kept.
    """
    stages = estimator.getStages()
    first = next((i for i, stage in enumerate(stages) if not isinstance(stage, Transformer)), len(stages))
    rest = stages[first:]
    made = PipelineModel(stages[:first]).transform(df)
    named = {value for stage in rest for value in stage.extractParamMap().values() if isinstance(value, str)}
    return made.select(*[c for c in made.columns if c in named or c in columns]), Pipeline(stages=rest)


def cross_validate(
    df: DataFrame,
    key_cols: Sequence[str],
    estimator: Pipeline,
    label: str = "label",
    k: int = 5,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """``(per_fold, summary)``: a fresh model per fold, scored on the fold left out.

    The loop is over folds; each fit and each scoring pass is a distributed job. Stages
    that learn nothing run once, not for each fold and pass.
    """
    folds, estimator = fixed_features(kfold(df, key_cols, k, seed), estimator, [*key_cols, label, "fold"])
    folds = materialize(folds, "features")
    held_out = []
    for fold in range(1, k + 1):
        model = estimator.fit(folds.filter(F.col("fold") != fold))
        scored = predict(folds.filter(F.col("fold") == fold), model)
        held_out.append(scored.select(*key_cols, "fold", label, "class_probabilities", "predicted_class"))
    # Narrow rows, written once: every metric reads them again, the texts and models are not needed for it.
    scored = materialize(reduce(DataFrame.unionByName, held_out), "held_out")
    losses = weighted_log_loss(scored, label, by=["fold"])
    per_fold = compute_metrics(scored, label, by=["fold"]).join(losses, "fold")
    return per_fold, kfold_summary(long_metrics(per_fold), k)


def best_model(
    train: DataFrame, validation: DataFrame, candidates: Mapping[str, Pipeline], label: str = "label"
) -> tuple[str, PipelineModel, dict[str, float]]:
    """Fit every candidate and keep the one with the lowest validation loss."""
    models = {name: estimator.fit(train) for name, estimator in candidates.items()}
    losses = {
        name: weighted_log_loss(score_with_model(validation, model), label).first()["loss"]
        for name, model in models.items()
    }
    winner = min(losses, key=lambda name: (losses[name], name))
    return winner, models[winner], losses


def early_stopping(
    history: DataFrame,
    run_cols: Sequence[str] = (),
    epoch: str = "epoch",
    loss: str = "loss",
    patience: int = 3,
    min_delta: float = 0.01,
) -> DataFrame:
    """Per run: best epoch, its loss, and the epoch to stop at (null if none).

    An epoch improves if it beats the lowest loss before it by more than ``min_delta``;
    the run stops at the first epoch ``patience`` epochs after the last improvement.
    """
    by_epoch = Window.partitionBy(*(run_cols or [F.lit(0)])).orderBy(epoch)
    before = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        history.withColumn("__low", F.min(loss).over(before))
        .withColumn("__better", F.col("__low").isNull() | (F.col(loss) < F.col("__low") - min_delta))
        .withColumn("__last", F.max(F.when(F.col("__better"), F.col(epoch))).over(by_epoch))
        .withColumn("__stop", F.col(epoch) - F.col("__last") >= patience)
    )
    return marked.groupBy(*run_cols).agg(
        F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"),
        F.min(loss).alias("best_loss"),
        F.min(F.when(F.col("__stop"), F.col(epoch))).alias("stop_epoch"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def token_totals(df: DataFrame, text: str = "text", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(by, class, token, n): how often each token stands in the texts of a class; token '' counts the texts."""
    counted = F.concat(F.array(F.lit("")), tokens(F.col(text)))
    rows = df.where(F.col(label).isNotNull()).select(*by, F.col(label).cast("int").alias("class"), F.explode(counted).alias("token"))
    return rows.groupBy(*by, "class", "token").agg(F.count(F.lit(1)).alias("n"))


def bayes_weights(counts: DataFrame, n_classes: int = 2, smoothing: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, token, class, weight) of multinomial naive Bayes: logarithms of the tokens' shares
    in a class, ``smoothing`` added to every count; token '' has those of the classes."""
    classes = range(n_classes)
    wide = counts.groupBy(*by, "token").agg(
        *[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(f"__n{c}") for c in classes]
    )
    wide = wide.where(sum((F.col(f"__n{c}") for c in classes), F.lit(0)) > 0)
    word = F.col("token") != ""
    sizes = wide.groupBy(*by).agg(
        F.count(F.when(word, 1)).alias("__words"),
        *[F.sum(F.when(word, F.col(f"__n{c}")).otherwise(0)).alias(f"__s{c}") for c in classes],
        F.sum(F.when(~word, sum((F.col(f"__n{c}") for c in classes), F.lit(0))).otherwise(0)).alias("__texts"),
    )
    if by:
        joined = wide.join(F.broadcast(sizes), [*by])  # a row a model
    else:
        row = sizes.first().asDict()
        joined = wide.withColumns({name: F.lit(value) for name, value in row.items()})
    shares = [
        F.when(word, (F.col(f"__n{c}") + smoothing) / (F.col(f"__s{c}") + smoothing * F.col("__words"))).otherwise(
            F.greatest(F.col(f"__n{c}"), F.lit(LEAST_PROBABILITY)) / F.col("__texts")
        )
        for c in classes
    ]
    logs = F.posexplode(F.array(*[F.log(s) for s in shares])).alias("class", "weight")
    return joined.select(*by, "token", logs)


def fit_bayes(df: DataFrame, text: str = "text", label: str = "label", n_classes: int = 2, smoothing: float = 1.0) -> DataFrame:
    """Naive Bayes as a table of weights for :func:`predict_bayes`; one grouped count."""
    return bayes_weights(token_totals(df, text, label), n_classes, smoothing)


def predict_bayes(df: DataFrame, model: DataFrame, key_cols: Sequence[str], text: str = "text") -> DataFrame:
    """Keys, probabilities and winner; tokens the model does not know do not count."""
    priors = sorted((r["class"], r["weight"]) for r in model.where("token = ''").collect())  # a row a class
    weights = model.where("token <> ''")
    return predict_logits(linear_logits(df, key_cols, text, weights, [w for _, w in priors]))


def cross_validate_bayes(
    df: DataFrame, key_cols: Sequence[str], fold: str = "fold", text: str = "text", label: str = "label", k: int = 5,
    n_classes: int = 2, smoothing: float = 1.0,
) -> DataFrame:
    """Every row scored by the model of the other folds: keys, fold, label, probabilities and winner.

    Tokens are counted once, by fold; the counts a model learns from are all but those of
    its fold. All folds are then scored in one join.
    """
    counts = materialize(token_totals(df, text, label, [fold]), "fold_counts")
    every = counts.groupBy("class", "token").agg(F.sum("n").alias("__all"))
    every = every.withColumn(fold, F.explode(F.sequence(F.lit(1), F.lit(k))))
    left = every.join(counts, [fold, "class", "token"], "left")
    left = left.select(fold, "class", "token", (F.col("__all") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    weights = bayes_weights(left, n_classes, smoothing, [fold])
    table = weights.groupBy(fold, "token").agg(
        *[F.sum(F.when(F.col("class") == c, F.col("weight"))).alias(f"__w{c}") for c in range(n_classes)]
    )
    counted = F.concat(F.array(F.lit("")), tokens(F.col(text)))
    rows = df.select(*key_cols, fold, label, F.explode(counted).alias("token")).groupBy(*key_cols, fold, label, "token").count()
    sums = [F.sum(F.col("count") * F.col(f"__w{c}")) for c in range(n_classes)]
    logits = rows.join(table, [fold, "token"]).groupBy(*key_cols, fold, label).agg(F.array(*sums).alias("logits"))
    return predict_logits(logits)
