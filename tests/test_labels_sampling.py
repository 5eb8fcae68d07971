"""Labels, balancing, splits and folds: hand-made cases and plain-Python ranks."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuelens.operators import labels as L
from issuelens.operators import sampling as S
from issuelens.plans.split_jobs import split_job, split_job_overlapping


def frame(spark, rows, schema="id long, label int"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def forty(spark):
    return frame(spark, [(i, int(i < 20)) for i in range(40)])


@pytest.fixture(scope="module")
def repos(spark):
    counts = [("team-x/core", 1, 12), ("team-x/core", 0, 17), ("team-y/site", 1, 6), ("team-y/site", 0, 11)]
    rows = [(repo, label) for repo, label, n in counts for _ in range(n)]
    return frame(spark, [(i, label, repo) for i, (repo, label) in enumerate(rows)], "id long, label int, repo string")


def sizes(df, *cols):
    return {tuple(r)[:-1]: r["count"] for r in df.groupBy(*cols).count().collect()}


def test_stratified_split_sizes(forty):
    split = S.stratified_split(forty, ["id"])
    assert sizes(split, "split", "label") == {("train", 0): 16, ("train", 1): 16, ("test", 0): 4, ("test", 1): 4}
    assert S.split_overlap(split, ["id"]).count() == 0


def test_balance_and_folds(forty, spark):
    assert S.balance_classes(forty, ["id"]).count() == 40
    assert set(sizes(S.kfold(forty, ["id"], 5), "fold").values()) == {8}
    uneven = frame(spark, [(i, int(i < 20)) for i in range(30)])
    assert sizes(S.balance_classes(uneven, ["id"]), "label") == {(0,): 10, (1,): 10}
    assert sorted(sizes(S.kfold(uneven, ["id"], 4), "fold").values()) == [7, 7, 8, 8]


def test_same_seed_same_rows_other_seed_other_rows(forty):
    pick = lambda seed: {r["id"] for r in S.sample_rows(forty, 10, ["id"], seed).collect()}
    assert pick(1) == pick(1) and pick(1) != pick(2)
    assert S.sample_rows(forty, 100, ["id"]).count() == 40
    assert S.sample_rows(forty, 0, ["id"]).count() == 0


def test_percent_split(forty):
    assert sizes(S.percent_split(forty, ["id"], 98), "split") == {("train",): 39, ("test",): 1}
    assert sizes(S.percent_split(forty, ["id"], 100), "split") == {("train",): 40}


def test_top_group(repos):
    rest, held = S.holdout_top_group(repos, "repo")
    assert (rest.count(), held.count()) == (17, 29)
    rest, held = S.holdout_top_group_positives(repos, "repo")
    assert (rest.count(), held.count()) == (17, 12)
    rest, held = S.holdout_top_group_per_class(repos, "repo")
    assert (rest.count(), held.count()) == (17, 29)
    assert sizes(S.top_groups_balanced(repos, "repo", ["id"]), "label") == {(0,): 18, (1,): 18}


def test_no_positives_means_no_holdout(spark):
    rows = frame(spark, [(1, 0, "a"), (2, 0, "b")], "id long, label int, repo string")
    rest, held = S.holdout_top_group_positives(rows, "repo")
    assert (rest.count(), held.count()) == (2, 0)


def test_split_job_without_enough_negatives(spark):
    counts = [("alpha", 1, 10), ("beta", 1, 4), ("gamma", 0, 30)]
    rows = [(repo, label) for repo, label, n in counts for _ in range(n)]
    df = frame(spark, [(i, label, repo) for i, (repo, label) in enumerate(rows)], "id long, label int, repo string")
    job = split_job(df, ["id"], group="repo")
    assert sizes(job, "split", "label") == {
        ("top_repos", 1): 10,
        ("train", 0): 3,
        ("train", 1): 3,
        ("test", 0): 1,
        ("test", 1): 1,
    }


def test_split_job_equals_its_steps(spark):
    rows = [(i, int(i % 3 == 0), f"r{i % 7 if i % 5 else 0}") for i in range(700)]
    rows += [(1000 + i, 1, "r0") for i in range(60)]
    df = frame(spark, rows, "id long, label int, repo string")
    rest, held = S.holdout_top_group(df, "repo")
    parts = S.stratified_split(S.balance_classes(rest, ["id"]), ["id"]).unionByName(held.withColumn("split", F.lit(S.HOLDOUT)))
    steps = S.top_up_holdout(parts, ["id"])
    whole = split_job(df, ["id"], group="repo")
    by_id = lambda d: {r["id"]: r["split"] for r in d.collect()}
    assert by_id(whole) == by_id(steps)


def test_split_job_moves_negatives(spark):
    rows = [(i, 1, "hot") for i in range(12)] + [(100 + i, 0, "hot") for i in range(10)]
    rows += [(200 + i, i % 2, f"r{i % 9}") for i in range(180)]
    job = split_job(frame(spark, rows, "id long, label int, repo string"), ["id"], group="repo")
    found = sizes(job, "split", "label")
    assert found[("top_repos", 0)] == found[("top_repos", 1)]
    assert S.split_overlap(job, ["id"]).count() == 0


def test_overlapping_job_keeps_all_rows(repos):
    divided, top = split_job_overlapping(repos, ["id"], group="repo", numeric_labels=True)
    assert divided.count() == 46 and top.count() == 36


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10**6)), min_size=1, max_size=120, unique_by=lambda r: r[1]),
    st.integers(0, 5),
    st.lists(st.integers(-1, 70), min_size=1, max_size=3).map(sorted),
)
def test_rank_bands_equal_sorting(spark, rows, seed, cuts):
    df = frame(spark, [(key, label) for label, key in rows])
    ranks = lambda t: t.withColumns({f"rank_{i}": F.lit(c) for i, c in enumerate(cuts)})
    got = {r["id"]: r["band"] for r in S.rank_bands(df, ["id"], ["label"], ranks, len(cuts), seed).collect()}
    for label in {r[0] for r in rows}:
        keys = sorted((hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k) for x, k in rows if x == label)
        for rank, (_, key) in enumerate(keys, 1):
            assert got[key] == sum(rank > c for c in cuts)


def test_hot_class_and_composite_text_keys(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("k"), F.col("id")).alias("a"), (F.col("id") % 2).alias("b"), F.when(F.col("id") < 2990, 0).otherwise(1).alias("label")
    )
    assert sizes(S.balance_classes(df, ["a", "b"]), "label") == {(0,): 10, (1,): 10}


def test_split_plan_has_no_shuffle_or_window_over_rows(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plan = S.stratified_split(labels, ["doc_id"], "toxic")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "Sort" not in plan


def test_row_keys_are_unique_and_repeatable(spark):
    df = spark.createDataFrame([("a", 1)] * 7 + [("b", None)] * 2 + [("c", 3)], "x string, y int")
    keys = lambda: sorted(r["row_key"] for r in S.add_row_key(df, copies_per_task=3).collect())
    first = keys()
    assert len(set(first)) == 10 and first == keys()
    with pytest.raises(ValueError):
        S.require_unique_key(df, ["x"])
    S.require_unique_key(S.add_row_key(df), ["row_key"])


@pytest.mark.parametrize(
    "names,pair",
    [
        (["td", "non_td"], ("non_td", "td")),
        (["defect", "non_defect"], ("non_defect", "defect")),
        (["yes", "no"], ("no", "yes")),
        (["non_b", "non_a"], ("non_a", "non_b")),
    ],
)
def test_detect_pair(spark, names, pair):
    df = spark.createDataFrame([(n,) for n in names * 3] + [(None,)], "label string")
    found = L.detect_pair(df)
    assert (found.negative, found.positive) == pair
    codes = {r["label"]: r["code"] for r in L.encode_detected(df, "label", "code").collect()}
    assert codes == {pair[0]: 0, pair[1]: 1, None: None}


def test_detect_pair_needs_two(spark):
    for names in (["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError, match="exactly 2"):
            L.detect_pair(spark.createDataFrame([(n,) for n in names], "label string"))


def test_ordinal_and_one_vs_rest(spark):
    df = spark.createDataFrame([(i, f"cat_{c}") for i, c in enumerate("CCABBA")], "id long, label string")
    codes = {r["label"]: r["label_idx"] for r in L.encode_ordinal(df, "label", "id").collect()}
    assert codes == {"cat_C": 0, "cat_A": 1, "cat_B": 2}
    with pytest.raises(ValueError):
        L.one_vs_rest_label(F.col("label"), None)
    with_null = df.select(F.when(F.col("id") > 0, F.col("label")).alias("label"))
    assert [r[0] for r in with_null.select(L.one_vs_rest_label(F.col("label"), "cat_C")).collect()] == [0, 1, 0, 0, 0, 0]


def test_numeric_label_rejects_text(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("x",)], "label string").select(L.numeric_label(F.col("label"))).collect()


def test_a_cut_between_equal_keys_raises(spark):
    df = frame(spark, [(i // 10, i % 2) for i in range(100)])
    with pytest.raises(Exception, match="not unique"):
        S.sample_rows(df, 5, ["id"]).collect()
    assert S.sample_rows(df, 30, ["id"]).count() == 30  # the cut falls between keys


def test_unlabelled_rows_stay_in_splits(spark):
    df = frame(spark, [(i, [0, 1, None][i % 3]) for i in range(30)])
    split = S.stratified_split(df, ["id"])
    assert sizes(split, "split", "label") == {(s, x): 8 if s == "train" else 2 for s in ("train", "test") for x in (0, 1, None)}
    assert S.top_up_holdout(split, ["id"]).count() == 30
    assert sizes(S.balance_classes(df, ["id"]), "label") == {(0,): 10, (1,): 10}
