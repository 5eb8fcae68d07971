"""Distributed text scoring, ensembles and prediction columns."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.functions import arrays
from issuelens.functions.text import null_to_empty, tokens
from issuelens.operators.small import INLINE_BYTES, INLINE_ROWS, small_rows

# The debt categories models exist for, as (code, category).
CATEGORIES = [
    ("TD", "General TD"),
    ("architecture", "Architecture"),
    ("code", "Code Quality"),
    ("defect", "Defects"),
    ("infrastructure", "Infrastructure"),
    ("perf", "Performance"),
    ("requirement", "Requirements"),
    ("design", "Design"),
    ("secu", "Security"),
    ("usab", "Usability"),
    ("reli", "Reliability"),
    ("process", "Process"),
    ("build", "Build"),
    ("main", "Maintenance"),
    ("automation", "Automation"),
    ("people", "People"),
    ("port", "Portability"),
    ("comp", "Compatibility"),
    ("documentation", "Documentation"),
    ("test", "Test"),
    ("finetuned_TD", "Technical Debt (fine-tuned)"),
    ("High_priority_roberta", "High Priority"),
    ("finetuned_Priority", "High Priority (fine-tuned)"),
]

# Model groups a user can pick as a whole.
MODEL_GROUPS = {
    "TD": ["TD"],
    "FT_TD": ["finetuned_TD"],
    "High_Priority": ["High_priority_roberta"],
    "FT_HighPriority": ["finetuned_Priority"],
    "Quality": ["comp", "main", "perf", "port", "reli", "secu", "usab"],
    "Types_TD": [
        "automation",
        "build",
        "design",
        "documentation",
        "infrastructure",
        "people",
        "test",
        "architecture",
    ],
}

Scorer = Callable[[list], list]
SLOTS = 1 << 14


def weight_table(weights: DataFrame, n_classes: int, max_rows: int, max_bytes: int) -> Column | None:
    """A constant array of hash slots, each with the (token, weights) that fall there; None if they are too many.

    ``weights`` has a row a token and a column ``__w<class>`` a class.
    """
    slot = F.pmod(F.xxhash64("token"), F.lit(SLOTS)).cast("int")
    rows = small_rows(weights.where("token IS NOT NULL").select(slot, "token", *[f"__w{c}" for c in range(n_classes)]), max_rows, max_bytes)
    if rows is None:
        return None
    slots: list = [None] * SLOTS
    for at, token, *own in rows:
        slots[at] = [*(slots[at] or []), {"t": token, "w": [w or 0.0 for w in own]}]
    schema = "array<array<struct<t:string,w:array<double>>>>"
    # One constant, read once while the query is planned.
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), schema)


def linear_logits(
    df: DataFrame,
    key_cols: Sequence[str],
    text: str,
    weights: DataFrame,
    bias: Sequence[float],
    max_tokens: int | None = None,
    max_rows: int = INLINE_ROWS,
    max_bytes: int = INLINE_BYTES,
) -> DataFrame:
    """Bag-of-words logits: per class, bias plus the weights of the text's tokens.

    ``weights`` is (token, class, weight). Up to ``max_rows`` tokens and ``max_bytes`` the
    weights become a constant hash table, in which every row looks its tokens up: nothing
    is exploded or shuffled, and a stream can be scored without state. Beyond that, tokens
    are shuffled to their weights; ``key_cols`` are repeated per token there, so keep them
    narrow. Rows that share a key are scored each on its own.
    """
    classes = range(len(bias))
    pivoted = weights.groupBy("token").agg(
        *[F.sum(F.when(F.col("class") == c, F.col("weight"))).alias(f"__w{c}") for c in classes]
    )
    table = weight_table(pivoted, len(bias), max_rows, max_bytes)
    if table is not None:
        def slot(token: Column) -> Column:
            return F.get(table, F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int"))

        # Most tokens fall into an empty slot and are dropped at once.
        known = F.filter(tokens(F.col(text), max_tokens), lambda t: slot(t).isNotNull())
        hits = F.flatten(F.transform(known, lambda t: F.filter(slot(t), lambda e: e["t"] == t)))
        start = F.array(*[F.lit(float(b)) for b in bias])
        logits = F.aggregate("__hits", start, lambda held, e: F.zip_with(held, e["w"], lambda x, y: x + y))
        return df.select(*key_cols, hits.alias("__hits")).select(*key_cols, arrays.computed_once(logits).alias("logits"))
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    exploded = numbered.select(*key_cols, "__row", F.explode_outer(tokens(F.col(text), max_tokens)).alias("token"))
    logits = [F.coalesce(F.sum(f"__w{c}"), F.lit(0.0)) + F.lit(float(bias[c])) for c in classes]
    summed = exploded.join(pivoted, "token", "left").groupBy(*key_cols, "__row").agg(F.array(*logits).alias("logits"))
    return summed.drop("__row")


_LOADED: dict[str, Scorer] = {}


def loaded_scorer(pickled: bytes) -> Scorer:
    """The scorer of this worker process; the last one is kept, told apart by its factory's bytes."""
    key = hashlib.sha256(pickled).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = cloudpickle.loads(pickled)()
    return _LOADED[key]


def score_with(
    df: DataFrame,
    text: str,
    scorer_factory: Callable[[], Scorer],
    batch_size: int = 32,
    skip_failed: bool = False,
    target: str = "class_probabilities",
) -> DataFrame:
    """Add class probabilities from a user-supplied scorer.

    ``scorer_factory`` is called once per Python worker to load a model, which later tasks
    in the worker use again; the scorer maps a list of texts to a list of probability lists. Only the text column goes to
    Python. With ``skip_failed`` a batch the scorer raises on gets null probabilities,
    which the ensemble operators leave out.
    """

    pickled = cloudpickle.dumps(scorer_factory)

    def score_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = loaded_scorer(pickled)
        for texts in batches:
            scored: list = []
            for start in range(0, len(texts), batch_size):
                chunk = texts.iloc[start : start + batch_size].tolist()
                try:
                    scored.extend([float(p) for p in row] for row in scorer(chunk))
                except Exception:
                    if not skip_failed:
                        raise
                    scored.extend([None] * len(chunk))
            yield pd.Series(scored, index=texts.index, dtype=object)

    udf = F.pandas_udf(score_batches, "array<double>").asNondeterministic()
    return df.withColumn(target, udf(null_to_empty(F.col(text))))


def score_with_model(df: DataFrame, model: PipelineModel, target: str = "class_probabilities") -> DataFrame:
    """Add class probabilities from a fitted Spark ML pipeline."""
    scored = model.transform(df).withColumn(target, vector_to_array("probability"))
    return scored.select(*[c for c in df.columns if c != target], target)


def add_prediction(
    df: DataFrame,
    probabilities: str = "class_probabilities",
    class_col: str = "predicted_class",
    probability_col: str = "predicted_probability",
) -> DataFrame:
    """Add the winning class, the first on ties, and its probability."""
    return df.withColumns(
        {
            class_col: arrays.argmax(F.col(probabilities)),
            probability_col: F.array_max(probabilities),
        }
    )


def predict_logits(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Logits to probabilities, winning class and winning probability."""
    return add_prediction(df.withColumn("class_probabilities", arrays.softmax(F.col(logits)))).drop(logits)


def predict_single(spark: SparkSession, text: str, score: Callable[[DataFrame], DataFrame]) -> dict:
    """Run a table scorer on one text."""
    if not text:
        raise ValueError("there is no text to score")
    return score(spark.createDataFrame([(0, text)], "id long, text string")).first().asDict()


def mark_empty_text(df: DataFrame, text: str = "text", target: str = "error") -> DataFrame:
    """Flag rows a model cannot score, without failing the job."""
    return df.withColumn(target, F.when(null_to_empty(F.col(text)) == "", "empty"))


def normalized_weights(members: Sequence[str], weights: Sequence[float] | None = None) -> dict[str, float]:
    """Member weights that sum to one, equal by default."""
    if not members:
        raise ValueError("an ensemble needs a member")
    weights = [1.0] * len(members) if weights is None else weights
    if len(weights) != len(members):
        raise ValueError(
            f"{len(weights)} weights for {len(members)} members"
        )
    total = float(sum(weights))
    return {m: w / total for m, w in zip(members, weights)}


def _uniform(n_classes: int):
    return F.array(*[F.lit(1.0 / n_classes)] * n_classes)


def ensemble_wide(
    df: DataFrame, weights: Mapping[str, float], n_classes: int = 2, target: str = "class_probabilities"
) -> DataFrame:
    """Weighted mean over probability columns (the keys of ``weights``).

    Null members are left out and the other weights renormalised; with no member left
    the row gets uniform probabilities.
    """
    mean = arrays.weighted_mean_arrays([F.col(c) for c in weights], list(weights.values()))
    return add_prediction(df.withColumn(target, F.coalesce(mean, _uniform(n_classes))), target)


def ensemble_long(
    scores: DataFrame,
    key_cols: Sequence[str],
    weights: Mapping[str, float],
    n_classes: int = 2,
    model: str = "model_id",
    probabilities: str = "class_probabilities",
) -> DataFrame:
    """Weighted mean over (key, model, probabilities) rows; same rules as the wide form.

    Members that are not in ``weights`` do not count.
    """
    entries = [F.lit(x) for m, w in weights.items() for x in (m, float(w))]
    member = scores.select(
        *key_cols,
        F.col(probabilities).alias("__p"),
        F.when(
            F.col(probabilities).isNotNull(),
            F.coalesce(F.try_element_at(F.create_map(*entries), F.col(model)), F.lit(0.0)),
        ).alias("__w"),
    )
    sums = member.groupBy(*key_cols).agg(
        F.sum("__w").alias("__total"),
        *[F.sum(F.col("__w") * F.get("__p", F.lit(c))).alias(f"__c{c}") for c in range(n_classes)],
    )
    mean = F.array(*[F.col(f"__c{c}") / F.col("__total") for c in range(n_classes)])
    return add_prediction(
        sums.select(
            *key_cols,
            F.when(F.col("__total") > 0, mean).otherwise(_uniform(n_classes)).alias("class_probabilities"),
        )
    )


def ensemble_logits(df: DataFrame, logit_cols: Sequence[str]) -> DataFrame:
    """Unweighted mean of logits, then softmax and winner, the first one on ties up to rounding."""
    mean = arrays.settled_means([F.col(c) for c in logit_cols])
    return predict_logits(df.withColumn("__mean_logits", mean), "__mean_logits")


def model_columns(
    scores: DataFrame, key_cols: Sequence[str], model_ids: Sequence[str], model: str = "model_id"
) -> DataFrame:
    """One ``Prediction_<m>`` and ``Probability_<m>`` column per model."""
    picked = []
    for m in model_ids:
        is_m = F.col(model) == m
        picked += [
            F.max(F.when(is_m, F.col("predicted_class"))).alias(f"Prediction_{m}"),
            F.max(F.when(is_m, F.col("predicted_probability"))).alias(f"Probability_{m}"),
        ]
    return scores.groupBy(*key_cols).agg(*picked)


def model_registry(spark: SparkSession, prefix: str = "") -> DataFrame:
    """(model_id, category) for all known categories."""
    return spark.createDataFrame(
        [(prefix + code, category) for code, category in CATEGORIES], "model_id string, category string"
    )


def group_members(spark: SparkSession, prefix: str = "") -> DataFrame:
    """(model_group, model_id) with one row per member of each group."""
    return spark.createDataFrame(
        [(g, [prefix + m for m in members]) for g, members in MODEL_GROUPS.items()],
        "model_group string, members array<string>",
    ).select("model_group", F.explode("members").alias("model_id"))


def debt_categories(scores: DataFrame, registry: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """The sorted categories whose model says class 1, for each key with any.

    A model that the registry does not list stands under its own id. ``registry`` may be
    of any size: Spark chooses the join from what it measures.
    """
    found = scores.filter("predicted_class = 1").join(registry, "model_id", "left")
    named = found.withColumn("category", F.coalesce("category", "model_id"))
    return named.groupBy(*key_cols).agg(F.sort_array(F.collect_set("category")).alias("categories"))


def named_probabilities(
    df: DataFrame, names: Mapping[int, str], probabilities: str = "class_probabilities", digits: int = 3
) -> DataFrame:
    """One rounded probability column per class."""
    return df.withColumns(
        {name: F.bround(F.get(probabilities, F.lit(i)), digits) for i, name in names.items()}
    )


def add_top_classes(
    df: DataFrame,
    names: Mapping[int, str],
    n: int = 1,
    probabilities: str = "class_probabilities",
    digits: int = 3,
) -> DataFrame:
    """Add ``Top_i_Prob`` and ``Top_i_Class`` for the ``n`` best classes, best first."""
    if n > len(names):
        raise ValueError(f"top {n} of {len(names)} classes")
    rounded = arrays.round_half_even(F.col(probabilities), digits)
    ranked = df.withColumn("__top", arrays.top_classes(rounded, n))
    entries = [F.lit(x) for pair in names.items() for x in pair]
    columns = {}
    for i in range(n):
        entry = F.get("__top", F.lit(i))
        columns[f"Top_{i + 1}_Prob"] = entry["prob"]
        columns[f"Top_{i + 1}_Class"] = F.try_element_at(F.create_map(*entries), entry["idx"])
    return ranked.withColumns(columns).drop("__top")


def add_confidence(df: DataFrame, threshold: float = 0.5, probability: str = "Top_1_Prob") -> DataFrame:
    return df.withColumn("confidence", F.col(probability)).withColumn(
        "is_confident", F.col("confidence") >= threshold
    )
