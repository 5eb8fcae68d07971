"""Scoring and ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens.functions import arrays
from issuelens.functions.text import text_hash, tokens, with_clean_text
from issuelens.operators import metrics as M
from issuelens.operators import relational as R
from issuelens.operators import scoring as I
from issuelens.plans.registry import (
    CLASS_SCORES,
    RANKED,
    class_scores,
    query,
    r6,
    ranked_labels,
    table,
)
from issuelens.plans.score_job import predict_table
from issuelens.plans.text_queries import sql_clean, sql_words
from issuelens.session import materialize
from issuelens.sources.tables import spread

BIAS = [0.0, -0.5]


def token_weights(spark, folder):
    """A weight for class 1 per word of the benchmark texts, by the word's length."""
    words = table(spark, folder, "benchmark").select(F.explode(tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", F.lit(1).alias("class"), ((F.length("token") % 5 - 2) * 0.25).alias("weight"))


WEIGHTS = f"""weights AS (SELECT DISTINCT token, (length(token) % 5 - 2) * CAST(0.25 AS DOUBLE) AS weight
  FROM (SELECT unnest({sql_words('lower(text)')}) AS token FROM benchmark))"""


def linear_sql(source: str, key: str, text: str) -> str:
    """(key, z, p0, p1) of the linear scorer over ``source``."""
    return f"""{WEIGHTS}, token_rows AS (SELECT {key}, unnest({sql_words(f'lower({text})')}) AS token FROM {source}),
      sums AS (SELECT {key}, sum(weight) AS s FROM token_rows JOIN weights USING (token) GROUP BY {key}),
      logits AS (SELECT b.{key}, coalesce(s, 0) - 0.5 AS z FROM {source} b LEFT JOIN sums ON b.{key} = sums.{key}),
      shifted AS (SELECT {key}, z, exp(0 - greatest(z, 0)) AS e0, exp(z - greatest(z, 0)) AS e1 FROM logits),
      probs AS (SELECT {key}, z, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1,
        CASE WHEN e1 > e0 THEN 1 ELSE 0 END AS predicted_class FROM shifted)"""


def linear_predictions(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return I.predict_logits(I.linear_logits(documents, ["doc_id"], "text", token_weights(spark, folder), BIAS))


@query(f"WITH {linear_sql('documents', 'doc_id', 'text')} SELECT doc_id, z FROM probs")
def linear_score(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    logits = I.linear_logits(documents, ["doc_id"], "text", token_weights(spark, folder), BIAS)
    return logits.select("doc_id", F.get("logits", F.lit(1)).alias("z"))


@query(f"WITH {linear_sql('documents', 'doc_id', 'text')} SELECT doc_id, z FROM probs")
def linear_score_large_vocabulary(spark, folder):
    """The same scores with the weights as a table of any size."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    logits = I.linear_logits(documents, ["doc_id"], "text", token_weights(spark, folder), BIAS, max_rows=0)
    return logits.select("doc_id", F.get("logits", F.lit(1)).alias("z"))


@query(
    f"""WITH {linear_sql('documents', 'doc_id', 'text')}
    SELECT doc_id, predicted_class, round(greatest(p0, p1), 6) AS predicted_probability, round(p1, 6) AS p1 FROM probs"""
)
def softmax_argmax(spark, folder):
    rows = linear_predictions(spark, folder)
    return rows.select(
        "doc_id",
        "predicted_class",
        r6("predicted_probability").alias("predicted_probability"),
        r6(F.get("class_probabilities", F.lit(1))).alias("p1"),
    )


@query(
    f"""WITH cleaned AS (SELECT d.doc_id, l.toxic AS label, {sql_clean('text')} AS text
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL),
      kept AS (SELECT * FROM cleaned WHERE length(text) >= 20 AND doc_id IN
        (SELECT min(doc_id) FROM cleaned WHERE length(text) >= 20 GROUP BY text)),
      {linear_sql('kept', 'doc_id', 'text')},
      counts AS (SELECT CAST(count(*) FILTER (label = 1 AND predicted_class = 1) AS DOUBLE) AS tp,
          CAST(count(*) FILTER (label = 0 AND predicted_class = 0) AS DOUBLE) AS tn,
          CAST(count(*) FILTER (label = 0 AND predicted_class = 1) AS DOUBLE) AS fp,
          CAST(count(*) FILTER (label = 1 AND predicted_class = 0) AS DOUBLE) AS fn
        FROM kept JOIN probs USING (doc_id))
    SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
      round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc
    FROM counts"""
)
def clean_score_evaluate(spark, folder):
    """Labelled documents: clean, filter, de-duplicate, score, evaluate."""
    documents = spread(table(spark, folder, "documents").select("doc_id", F.col("text").alias("body")))
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    labelled = R.drop_null_rows(documents, "body").join(labels, "doc_id")
    cleaned = with_clean_text(labelled, "body", "text").drop("body")
    cleaned = R.keep_min_length(cleaned, "text", 20).withColumn("digest", text_hash(F.col("text")))
    kept = R.keep_first_by_text(materialize(cleaned, "cleaned"), "text", ["doc_id"], "digest").drop("digest")
    weights = token_weights(spark, folder)
    scored = I.predict_logits(I.linear_logits(kept, ["doc_id", "label"], "text", weights, BIAS))
    scores = M.binary_scores(M.confusion_counts(scored))
    return scores.select(*[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "mcc")])


def length_scorer():
    """Stands in for a model: the probability is the last two digits of the length."""

    def score(texts):
        return [[1 - len(t) % 100 / 100, len(t) % 100 / 100] for t in texts]

    return score


def picky_scorer():
    """Like :func:`length_scorer`, but fails on texts with an odd number of characters."""
    score = length_scorer()

    def checked(texts):
        if any(len(t) % 2 for t in texts):
            raise ValueError("odd length")
        return score(texts)

    return checked


LENGTH_P = "CAST(length(text) % 100 AS DOUBLE) / 100"


@query(
    f"""SELECT doc_id, lang, CASE WHEN {LENGTH_P} > 0.5 THEN 1 ELSE 0 END AS predicted_class,
      round(greatest({LENGTH_P}, 1 - {LENGTH_P}), 6) AS predicted_probability, round({LENGTH_P}, 6) AS p1 FROM documents"""
)
def score_with_user_model(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    scored = predict_table(documents, lambda df: I.score_with(df, "text", length_scorer))
    return scored.select(
        "doc_id",
        "lang",
        "predicted_class",
        r6("predicted_probability").alias("predicted_probability"),
        r6(F.get("class_probabilities", F.lit(1))).alias("p1"),
    )


@query(
    f"""SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN round({LENGTH_P}, 6) ELSE 0.5 END AS p1,
      CASE WHEN length(text) % 2 = 0 AND {LENGTH_P} > 0.5 THEN 1 ELSE 0 END AS predicted_class FROM documents"""
)
def score_with_failures(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    scored = I.score_with(documents, "text", picky_scorer, batch_size=1, skip_failed=True, target="model_a")
    combined = I.ensemble_wide(scored, {"model_a": 1.0})
    return combined.select("doc_id", r6(F.get("class_probabilities", F.lit(1))).alias("p1"), "predicted_class")


@query("SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'empty' END AS error FROM documents")
def mark_empty_text(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.when(F.col("n_chars") % 2 == 1, F.col("lang")).alias("text"))
    return I.mark_empty_text(rows).select("doc_id", "error")


# Three members over the same rows; in some rows one, two or all of them failed.
WEIGHTS3 = I.normalized_weights(["m1", "m2", "m3"], [3, 2, 1])


def members(spark, folder):
    rows = ranked_labels(spark, folder)
    m2 = (F.col("n_chars") % 1501 - 750) / F.lit(200.0)
    m3 = (F.col("n_chars") % 701 - 350) / F.lit(100.0)
    rest = F.col("n_chars") % 5
    logits = lambda z: F.array(F.lit(0.0), z)
    return rows.select(
        "doc_id",
        logits(F.col("z")).alias("l1"),
        logits(m2).alias("l2"),
        logits(m3).alias("l3"),
        F.when(rest != 0, arrays.softmax(logits(F.col("z")))).alias("m1"),
        F.when(rest > 1, arrays.softmax(logits(m2))).alias("m2"),
        F.when(rest != 0, arrays.softmax(logits(m3))).alias("m3"),
    )


MEMBERS = (
    RANKED
    + """, members AS (SELECT doc_id, n_chars % 5 AS rest, z AS z1, (n_chars % 1501 - 750) / CAST(200 AS DOUBLE) AS z2,
        (n_chars % 701 - 350) / CAST(100 AS DOUBLE) AS z3 FROM ranked),
      member_probs AS (SELECT *, CASE WHEN rest <> 0 THEN 1 / (1 + exp(-z1)) END AS q1,
        CASE WHEN rest > 1 THEN 1 / (1 + exp(-z2)) END AS q2, CASE WHEN rest <> 0 THEN 1 / (1 + exp(-z3)) END AS q3 FROM members),
      mixed AS (SELECT *, CASE WHEN rest = 0 THEN 0.5 WHEN rest = 1 THEN (3 * q1 + q3) / 4
        ELSE (3 * q1 + 2 * q2 + q3) / 6 END AS p1 FROM member_probs)"""
)
MIXED = f"WITH {MEMBERS} SELECT doc_id, round(p1, 6) AS p1, CASE WHEN round(p1, 9) > 0.5 THEN 1 ELSE 0 END AS predicted_class FROM mixed"


def mixed(rows):
    return rows.select("doc_id", r6(F.get("class_probabilities", F.lit(1))).alias("p1"), "predicted_class")


@query(MIXED)
def ensemble_wide(spark, folder):
    return mixed(I.ensemble_wide(members(spark, folder), WEIGHTS3))


@query(MIXED)
def ensemble_long(spark, folder):
    scores = members(spark, folder).unpivot("doc_id", list(WEIGHTS3), "model_id", "class_probabilities")
    return mixed(I.ensemble_long(scores, ["doc_id"], WEIGHTS3))


@query(
    f"""WITH {MEMBERS}, mean AS (SELECT doc_id, 1 / (1 + exp(-(z1 + z2 + z3) / 3)) AS p1 FROM members)
    SELECT doc_id, round(p1, 6) AS p1, CASE WHEN round(p1, 9) > 0.5 THEN 1 ELSE 0 END AS predicted_class FROM mean"""
)
def ensemble_logit_mean(spark, folder):
    return mixed(I.ensemble_logits(members(spark, folder), ["l1", "l2", "l3"]))


def model_scores(spark, folder, model_ids):
    """(doc_id, model_id, prediction) for many models over the labelled documents."""
    rows = ranked_labels(spark, folder)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(i).alias("i")) for i, m in enumerate(model_ids)]))
    logit = (F.col("n_chars") % (101 + 10 * F.col("m.i")) - 50) / F.lit(20.0)
    scored = rows.select("doc_id", "n_chars", each.alias("m")).select(
        "doc_id", "m.model_id", F.array(F.lit(0.0), logit).alias("logits")
    )
    return I.predict_logits(scored)


def model_scores_sql(model_ids) -> str:
    listed = ", ".join(f"('{m}', {i})" for i, m in enumerate(model_ids))
    return (
        RANKED
        + f""", models(model_id, i) AS (VALUES {listed}),
        model_logits AS (SELECT doc_id, model_id, (n_chars % (101 + 10 * i) - 50) / CAST(20 AS DOUBLE) AS z FROM ranked, models),
        model_scores AS (SELECT doc_id, model_id, CASE WHEN z > 0 THEN 1 ELSE 0 END AS c,
          1 / (1 + exp(-abs(z))) AS p FROM model_logits)"""
    )


QUALITY = I.MODEL_GROUPS["Quality"]
ALL_CODES = [code for code, _ in I.CATEGORIES]


@query(
    f"WITH {model_scores_sql(QUALITY)} SELECT doc_id, "
    + ", ".join(
        f"max(c) FILTER (model_id = '{m}') AS Prediction_{m}, round(max(p) FILTER (model_id = '{m}'), 6) AS Probability_{m}"
        for m in QUALITY
    )
    + " FROM model_scores GROUP BY doc_id"
)
def model_columns(spark, folder):
    wide = I.model_columns(model_scores(spark, folder, QUALITY), ["doc_id"], QUALITY)
    return wide.withColumns({f"Probability_{m}": r6(f"Probability_{m}") for m in QUALITY})


@query(
    f"""WITH {model_scores_sql(ALL_CODES)}, registry(model_id, category) AS (VALUES
      {', '.join(f"('{code}', '{category}')" for code, category in I.CATEGORIES)})
    SELECT doc_id, string_agg(category, ', ' ORDER BY category) AS categories FROM model_scores JOIN registry USING (model_id)
    WHERE c = 1 GROUP BY doc_id"""
)
def debt_categories(spark, folder):
    scores = model_scores(spark, folder, ALL_CODES)
    found = I.debt_categories(scores, I.model_registry(spark), ["doc_id"])
    return found.withColumn("categories", F.array_join("categories", ", "))


@query(
    f"""WITH {model_scores_sql(ALL_CODES)}, members(model_group, model_id) AS (VALUES
      {', '.join(f"('{g}', '{m}')" for g, ms in I.MODEL_GROUPS.items() for m in ms)})
    SELECT model_group, count(*) AS n_scores, count(*) FILTER (c = 1) AS n_debt FROM model_scores JOIN members USING (model_id)
    GROUP BY model_group"""
)
def scores_by_model_group(spark, folder):
    scores = model_scores(spark, folder, ALL_CODES)
    joined = scores.join(F.broadcast(I.group_members(spark)), "model_id")
    return joined.groupBy("model_group").agg(
        F.count("*").alias("n_scores"), F.count(F.when(F.col("predicted_class") == 1, 1)).alias("n_debt")
    )


KINDS = {i: f"kind_{i}" for i in range(10)}


@query(
    f"WITH {CLASS_SCORES} SELECT vec_id, "
    + ", ".join(f"round_even(p[{i + 1}], 3) AS kind_{i}" for i in KINDS)
    + " FROM class_probs"
)
def named_probabilities(spark, folder):
    rows = class_scores(spark, folder).withColumn("class_probabilities", arrays.softmax(F.col("logits")))
    return I.named_probabilities(rows, KINDS).select("vec_id", *KINDS.values())


@query(
    f"""WITH {CLASS_SCORES}, entries AS (SELECT vec_id, unnest(range(10)) AS i, unnest([round_even(x, 3) for x in p]) AS q FROM class_probs),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS r FROM entries)
    SELECT vec_id, max(q) FILTER (r = 1) AS Top_1_Prob, max('kind_' || i) FILTER (r = 1) AS Top_1_Class,
      max(q) FILTER (r = 2) AS Top_2_Prob, max('kind_' || i) FILTER (r = 2) AS Top_2_Class,
      max(q) FILTER (r = 3) AS Top_3_Prob, max('kind_' || i) FILTER (r = 3) AS Top_3_Class,
      max(q) FILTER (r = 1) AS confidence, max(q) FILTER (r = 1) >= 0.25 AS is_confident
    FROM ranked GROUP BY vec_id"""
)
def top_classes_confident(spark, folder):
    rows = class_scores(spark, folder).withColumn("class_probabilities", arrays.softmax(F.col("logits")))
    return I.add_confidence(I.add_top_classes(rows, KINDS, 3), 0.25).drop("label", "logits", "class_probabilities")


@query(
    f"""WITH {linear_sql('documents', 'doc_id', 'text')}
    SELECT doc_id, round(p1, 6) AS confidence FROM probs WHERE predicted_class = 1 AND p1 >= 0.6"""
)
def flagged_debt(spark, folder):
    flagged = R.flag_debt(linear_predictions(spark, folder), min_probability=0.6)
    return flagged.select("doc_id", r6("predicted_probability").alias("confidence"))


@query(
    f"""WITH {linear_sql('documents', 'doc_id', 'text')}
    SELECT source, count(*) FILTER (predicted_class = 0) AS n_clean, count(*) FILTER (predicted_class = 1) AS n_debt,
      round(avg(p1) FILTER (predicted_class = 1), 6) AS debt_confidence, round(avg(greatest(p0, p1)), 6) AS mean_confidence
    FROM probs JOIN documents USING (doc_id) GROUP BY source"""
)
def scan_report(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    logits = I.linear_logits(documents, ["doc_id", "source"], "text", token_weights(spark, folder), BIAS)
    report = R.scan_report(I.predict_logits(logits), "source")
    return report.withColumns({c: r6(c) for c in ("debt_confidence", "mean_confidence")})


@query(
    f"""WITH {linear_sql('documents', 'doc_id', 'text')}, pairs AS (SELECT toxic AS y, z FROM probs JOIN labels USING (doc_id)),
      by_score AS (SELECT z, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM pairs GROUP BY z),
      running AS (SELECT *, sum(neg) OVER (ORDER BY z) - neg AS below FROM by_score)
    SELECT round(CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM running"""
)
def text_score_auc(spark, folder):
    """Score once, keep the narrow result, evaluate from there."""
    logits = linear_score(spark, folder).join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")
    scores = materialize(logits, "scores")
    return M.roc_auc(scores, "toxic", "z").select(r6("roc_auc").alias("roc_auc"))


@query("SELECT sha256(text) AS text_hash, count(*) AS copies FROM documents GROUP BY ALL")
def text_digests(spark, folder):
    rows = table(spark, folder, "documents").select(text_hash(F.col("text")).alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.count("*").alias("copies"))
