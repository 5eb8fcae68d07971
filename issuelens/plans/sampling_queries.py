"""Sampling, balancing and split queries over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens.operators import sampling as S
from issuelens.plans.registry import LABELLED, labelled_documents, query, table
from issuelens.plans.split_jobs import split_job, split_job_overlapping

KEY = ["doc_id"]

# The same order and ranks in SQL, with plain windows over whole classes.
ORDERED = LABELLED + """, keyed AS (SELECT *, md5('42:' || doc_id) AS h FROM labelled)"""
RANKED_ROWS = (
    ORDERED
    + """, ranks AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS r,
        count(*) OVER (PARTITION BY label) AS n FROM keyed)"""
)


def quota_sql(source: str, size: str, fraction: float) -> str:
    """(label, size, t): the test rows per class by largest remainder."""
    return f"""want AS (SELECT CAST(ceil(CAST({fraction} AS DOUBLE) * sum({size})) AS BIGINT) AS w, sum({size}) AS total FROM {source}),
      parts AS (SELECT label, {size}, CAST({size} AS HUGEINT) * w // total AS base, CAST({size} AS HUGEINT) * w % total AS rest, w
        FROM {source}, want),
      quota AS (SELECT label, {size}, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
        <= w - sum(base) OVER () THEN 1 ELSE 0 END AS t FROM parts)"""


def docs(spark, folder):
    return labelled_documents(spark, folder).select("doc_id", "source", "label")


CLASSES = "classes AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)"
TOP_ONE = """top AS (SELECT source FROM labelled WHERE label = 1 GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"""
TOP_TEN = """top AS (SELECT source FROM labelled WHERE label = 1 GROUP BY source ORDER BY count(*) DESC, source LIMIT 10)"""


@query(f"WITH {RANKED_ROWS} SELECT doc_id, label FROM ranks WHERE r <= (SELECT min(n) FROM ranks)")
def balance_classes(spark, folder):
    return S.balance_classes(docs(spark, folder), KEY).select("doc_id", "label")


@query(
    f"""WITH {RANKED_ROWS}, {CLASSES}, {quota_sql('classes', 'n', 0.2)}
    SELECT doc_id, label, CASE WHEN r <= t THEN 'test' ELSE 'train' END AS split FROM ranks JOIN quota USING (label)"""
)
def stratified_split(spark, folder):
    return S.stratified_split(docs(spark, folder), KEY).select("doc_id", "label", "split")


@query(
    f"""WITH {RANKED_ROWS}, {CLASSES}, {quota_sql('classes', 'n', 0.1)}
    SELECT doc_id, label, CASE WHEN r <= t THEN 'test' ELSE 'train' END AS split FROM ranks JOIN quota USING (label)"""
)
def train_eval_split(spark, folder):
    return S.stratified_split(docs(spark, folder), KEY, test_size=0.1).select("doc_id", "label", "split")


@query(
    f"""WITH {LABELLED}, {TOP_ONE}
    SELECT doc_id, label, source, CASE WHEN source IN (FROM top) THEN 'held_out' ELSE 'rest' END AS part FROM labelled"""
)
def holdout_top_group(spark, folder):
    rest, held = S.holdout_top_group(docs(spark, folder), "source")
    return rest.withColumn("part", F.lit("rest")).unionByName(held.withColumn("part", F.lit("held_out")))


@query(
    f"""WITH {LABELLED}, {TOP_ONE}
    SELECT doc_id, label, source, CASE WHEN source IN (FROM top) THEN 'held_out' ELSE 'rest' END AS part FROM labelled
    WHERE label = 1 OR source NOT IN (FROM top)"""
)
def holdout_top_group_positives(spark, folder):
    rest, held = S.holdout_top_group_positives(docs(spark, folder), "source")
    return rest.withColumn("part", F.lit("rest")).unionByName(held.withColumn("part", F.lit("held_out")))


@query(
    f"""WITH {LABELLED}, best AS (SELECT label, source FROM (
        SELECT label, source, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, source) AS r
        FROM labelled GROUP BY label, source) WHERE r = 1)
    SELECT doc_id, l.label, l.source, CASE WHEN b.label IS NULL THEN 'rest' ELSE 'held_out' END AS part
    FROM labelled l LEFT JOIN best b ON l.label = b.label AND l.source = b.source"""
)
def holdout_top_group_per_class(spark, folder):
    rest, held = S.holdout_top_group_per_class(docs(spark, folder), "source")
    return rest.withColumn("part", F.lit("rest")).unionByName(held.withColumn("part", F.lit("held_out")))


@query(f"WITH {LABELLED} SELECT source, count(*) AS n_positive FROM labelled WHERE label = 1 GROUP BY source ORDER BY 2 DESC, 1 LIMIT 10")
def top_groups(spark, folder):
    return S.top_groups(docs(spark, folder), "source", n=10)


@query(
    f"""WITH {ORDERED}, {TOP_TEN}, inside AS (SELECT * FROM keyed WHERE source IN (FROM top)),
      ranks AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS r,
        count(*) OVER (PARTITION BY label) AS n FROM inside)
    SELECT doc_id, source, label FROM ranks WHERE r <= (SELECT min(n) FROM ranks)"""
)
def top_groups_balanced(spark, folder):
    return S.top_groups_balanced(docs(spark, folder), "source", KEY)


# Hold-out: the positives of the top group, so that it lacks negatives.
PARTS = f"""{RANKED_ROWS}, {TOP_ONE}, {CLASSES}, {quota_sql('classes', 'n', 0.2)},
  parted AS (SELECT doc_id, label, h, CASE WHEN label = 1 AND source IN (FROM top) THEN 'top_repos'
    WHEN r <= t THEN 'test' ELSE 'train' END AS split FROM ranks JOIN quota USING (label))"""


@query(
    f"""WITH {PARTS}, need AS (SELECT count(*) FILTER (split = 'top_repos' AND label = 1)
        - count(*) FILTER (split = 'top_repos' AND label = 0) AS gap,
        count(*) FILTER (split = 'test' AND label = 0) AS available FROM parted),
      placed AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY h, doc_id) AS q FROM parted)
    SELECT doc_id, label, CASE WHEN split = 'test' AND label = 0 AND gap > 0 AND gap <= available AND q <= gap
      THEN 'top_repos' ELSE split END AS split FROM placed, need"""
)
def holdout_topup(spark, folder):
    rows = S.stratified_split(docs(spark, folder), KEY)
    marked = S.mark_top_groups(rows, "source")
    held = F.when(F.col("is_top") & (F.col("label") == 1), S.HOLDOUT).otherwise(F.col("split"))
    return S.top_up_holdout(marked.withColumn("split", held), KEY).select("doc_id", "label", "split")


@query(
    f"""WITH {ORDERED}, ranks AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS r, count(*) OVER () AS n FROM keyed)
    SELECT doc_id, CASE WHEN r <= CAST(floor(n * CAST(0.98 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ranks"""
)
def percent_split(spark, folder):
    return S.percent_split(docs(spark, folder), KEY, 98).select("doc_id", "split")


@query(
    """SELECT event_id, event_type FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 500"""
)
def sample_cap(spark, folder):
    return S.sample_rows(table(spark, folder, "events").select("event_id", "event_type"), 500, ["event_id"])


@query(
    f"""WITH {ORDERED}, ranks AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS r, count(*) OVER () AS n FROM keyed)
    SELECT doc_id, CAST(CASE WHEN r <= (n % 5) * (n // 5 + 1) THEN (r - 1) // (n // 5 + 1)
      ELSE n % 5 + (r - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END + 1 AS INTEGER) AS fold FROM ranks"""
)
def kfold_assign(spark, folder):
    return S.kfold(docs(spark, folder), KEY, 5).select("doc_id", "fold")


@query(
    f"""WITH {RANKED_ROWS}
    SELECT doc_id, label, CAST(CASE WHEN r <= (n % 5) * (n // 5 + 1) THEN (r - 1) // (n // 5 + 1)
      ELSE n % 5 + (r - 1 - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END + 1 AS INTEGER) AS fold FROM ranks"""
)
def kfold_stratified(spark, folder):
    return S.kfold(docs(spark, folder), KEY, 5, strata=["label"]).select("doc_id", "label", "fold")


DRAW = "CAST('0x' || substr(md5('42:' || {}), 1, 8) AS BIGINT)"


@query(f"WITH {LABELLED} SELECT doc_id, CAST({DRAW.format('doc_id')} % 5 AS INTEGER) + 1 AS fold FROM labelled")
def kfold_hashed(spark, folder):
    return S.kfold_hashed(docs(spark, folder), KEY, 5).select("doc_id", "fold")


@query(f"SELECT event_id, event_type FROM events WHERE {DRAW.format('event_id')} < {round(0.1 * 2**32)}")
def sample_fraction(spark, folder):
    return S.sample_fraction(table(spark, folder, "events").select("event_id", "event_type"), 0.1, ["event_id"])


@query(
    f"""WITH {LABELLED} SELECT doc_id, source, label FROM labelled
    WHERE label = 1 OR label = 0 AND {DRAW.format('doc_id')} < {round(0.2 * 2**32)}"""
)
def sample_fraction_by_class(spark, folder):
    return S.sample_fraction_by(docs(spark, folder), "label", {0: 0.2, 1: 1.0}, KEY)


# All documents, most of them without a label.
SOME = """labelled AS (SELECT d.doc_id, d.source, l.toxic AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(
    f"""WITH {SOME}, ranks AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS r FROM labelled),
      {CLASSES}, {quota_sql('classes', 'n', 0.2).replace('rest DESC, label', 'rest DESC, label NULLS FIRST')}
    SELECT doc_id, ranks.label, CASE WHEN r <= t THEN 'test' ELSE 'train' END AS split
    FROM ranks JOIN quota ON ranks.label IS NOT DISTINCT FROM quota.label"""
)
def stratified_split_unlabelled(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left")
    return S.stratified_split(rows, KEY).select("doc_id", "label", "split")


@query(
    """SELECT lang, source, count(*) AS n_rows, count(*) AS n_keys FROM documents GROUP BY lang, source"""
)
def row_keys(spark, folder):
    keyed = S.add_row_key(table(spark, folder, "documents").select("lang", "source"))
    return keyed.groupBy("lang", "source").agg(
        F.count("*").alias("n_rows"), F.count_distinct("row_key").alias("n_keys")
    )


SPLIT_JOB = f"""{ORDERED}, {TOP_ONE},
  outside AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS r FROM keyed WHERE source NOT IN (FROM top)),
  smallest AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM outside GROUP BY label)),
  balanced AS (SELECT * FROM outside, smallest WHERE r <= m),
  classes AS (SELECT label, count(*) AS n FROM balanced GROUP BY label), {quota_sql('classes', 'n', 0.2)},
  held AS (SELECT count(*) FILTER (label = 1) - count(*) FILTER (label = 0) AS gap FROM keyed WHERE source IN (FROM top)),
  assigned AS (
    SELECT doc_id, label, source, 'top_repos' AS split FROM keyed WHERE source IN (FROM top)
    UNION ALL
    SELECT doc_id, label, source, CASE WHEN label = 0 AND gap > 0 AND gap <= t AND r <= gap THEN 'top_repos'
      WHEN r <= t THEN 'test' ELSE 'train' END FROM balanced JOIN quota USING (label), held)"""


@query(f"WITH {SPLIT_JOB} SELECT doc_id, label, source, split FROM assigned")
def split_job_by_group(spark, folder):
    return split_job(docs(spark, folder), KEY, group="source")


@query(
    f"""WITH {RANKED_ROWS}, {CLASSES}, {quota_sql('classes', 'n', 0.2)}, {TOP_TEN},
      inside AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS q,
        count(*) OVER (PARTITION BY label) AS k FROM keyed WHERE source IN (FROM top))
    SELECT doc_id, label, CASE WHEN r <= t THEN 'test' ELSE 'train' END AS split FROM ranks JOIN quota USING (label)
    UNION ALL SELECT doc_id, label, 'top_repos' FROM inside WHERE q <= (SELECT min(k) FROM inside)"""
)
def split_job_with_overlap(spark, folder):
    rows = docs(spark, folder).withColumn("label", F.when(F.col("label") == 1, "toxic").otherwise("non_toxic"))
    divided, top = split_job_overlapping(rows, KEY, group="source")
    top = top.withColumn("split", F.lit(S.HOLDOUT))
    return divided.select("doc_id", "label", "split").unionByName(top.select("doc_id", "label", "split"))


@query(
    f"""WITH {SPLIT_JOB} SELECT split, label, count(*) AS n_rows,
      (SELECT count(*) FROM (SELECT doc_id FROM assigned GROUP BY doc_id HAVING count(DISTINCT split) > 1)) AS n_shared
    FROM assigned GROUP BY split, label"""
)
def split_checks(spark, folder):
    rows = split_job(docs(spark, folder), KEY, group="source")
    shared = S.split_overlap(rows, KEY).agg(F.count("*").alias("n")).scalar()
    return rows.groupBy("split", "label").agg(F.count("*").alias("n_rows")).withColumn("n_shared", shared)
