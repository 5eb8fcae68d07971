"""Exact-size samples, balancing, splits and folds.

Every operator here orders rows by a digest of (seed, key) and keeps or assigns them
by rank. Ranks are never computed for the whole table. Rows are counted per digest
prefix, the prefix that holds the wanted rank is found from those counts, and only
the rows of that one prefix are ordered. What comes out is the digest at the wanted
rank, a handful of values per class, so the pass over the wide rows is a comparison
in a scan: no shuffle, no sort, and no task that holds a whole class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.operators.small import inline_if_small

# Hex digits of the digest used as counting prefix: 16**4 = 65,536 groups per class.
PREFIX_DIGITS = 4
TRAIN, TEST, HOLDOUT = "train", "test", "top_repos"


def shuffle_digest(seed: int, key_cols: Sequence[str]) -> Column:
    """The value that stands for a row's place in the random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key_cols]))


def _order_key(seed: int, key_cols: Sequence[str]) -> Column:
    return F.struct(
        shuffle_digest(seed, key_cols).alias("digest"), *[F.col(k).alias(k) for k in key_cols]
    )


def require_unique_key(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Raise unless ``key_cols`` identify rows. Costs one shuffle of the keys."""
    repeated = df.groupBy(*key_cols).count().filter("count > 1").limit(1).toArrow()
    if repeated.num_rows:
        raise ValueError(f"{list(key_cols)} is not unique")
    return df


def add_row_key(df: DataFrame, target: str = "row_key", copies_per_task: int = 100_000) -> DataFrame:
    """A repeatable key for files that have none: digest of the values plus an ordinal.

    Equal rows are counted map-side and written out again in chunks of at most
    ``copies_per_task``, so copies of one hot row come from many tasks.
    """
    first = F.col("__chunk") * copies_per_task + 1
    last = F.least(F.col("__copies"), (F.col("__chunk") + 1) * copies_per_task)
    return (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("__copies"))
        .withColumn("__digest", F.sha2(F.to_json(F.struct(*df.columns)), 256))
        .withColumn(
            "__chunk",
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / copies_per_task))),
        )
        .repartition("__digest", "__chunk")
        .withColumn("__ordinal", F.explode(F.sequence(first, last)))
        .select(F.concat_ws("-", "__digest", F.col("__ordinal").cast("string")).alias(target), *df.columns)
    )


def rank_bands(
    df: DataFrame,
    key_cols: Sequence[str],
    strata: Sequence[str],
    ranks: Callable[[DataFrame], DataFrame],
    n_ranks: int,
    seed: int = 42,
    target: str = "band",
) -> DataFrame:
    """Add the number of cut ranks that lie below each row's rank in its stratum.

    ``ranks`` gets the table (strata, ``n``) and returns it with columns ``rank_0`` ..
    ``rank_{n_ranks-1}``, ascending. Band 0 holds the ``rank_0`` first rows, band 1 the
    next up to ``rank_1``, and so on; rows past the last cut get ``n_ranks``. Null is a
    stratum like any other. Rows that share a key cannot be told apart: the job raises if
    a cut would have to fall between them.
    """
    # A struct around the value makes nulls equal in joins.
    strata_cols = [F.struct(F.col(s).alias("v")).alias(f"__s{i}") for i, s in enumerate(strata)]
    strata_cols = strata_cols or [F.struct(F.lit(0).alias("v")).alias("__s0")]
    names = [f"__s{i}" for i in range(len(strata_cols))]
    order_key = _order_key(seed, key_cols)
    order_fields = ["digest", *key_cols]
    slim = df.select(*strata_cols, order_key.alias("__order")).withColumn(
        "__prefix", F.substring("__order.digest", 1, PREFIX_DIGITS)
    )
    running = Window.partitionBy(*names).orderBy("__prefix")
    prefixes = (
        slim.groupBy(*names, "__prefix")
        .agg(F.count("*").alias("__rows"))
        .withColumn("__upto", F.sum("__rows").over(running))
    )
    totals = prefixes.groupBy(*names).agg(F.max("__upto").alias("n"))
    plain = [F.col(f"{name}.v").alias(s) for name, s in zip(names, strata)]
    wanted = ranks(totals.select(*names, *plain, "n"))
    cuts = wanted.select(
        *names,
        F.posexplode(
            F.array(*[F.least(F.col(f"rank_{i}").cast("long"), F.col("n")) for i in range(n_ranks)])
        ).alias("__cut", "__rank"),
    )
    holding = (F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__rows"))
    for name in names:
        holding = holding & (F.col(f"c.{name}") == F.col(f"p.{name}"))
    places = inline_if_small(
        cuts.alias("c")
        .join(prefixes.alias("p"), holding, "left")
        .select(
            *[F.col(f"c.{name}").alias(name) for name in names],
            "__cut",
            "__prefix",
            (F.col("__rank") - F.col("__upto") + F.col("__rows")).alias("__nth"),
            (F.col("__rank") <= 0).alias("__none"),
        )
    )
    same_key = F.raise_error(F.lit(f"{list(key_cols)} is not unique: a cut falls between rows that share a key"))
    in_prefix = Window.partitionBy(*names, "__prefix").orderBy("__order")
    found = (
        slim.join(places.select(*names, "__prefix"), [*names, "__prefix"], "left_semi")
        .withColumns(
            {"__nth": F.row_number().over(in_prefix).cast("long"), "__next": F.lead("__order").over(in_prefix)}
        )
        .withColumn("__order", F.when(F.col("__next") == F.col("__order"), same_key).otherwise(F.col("__order")))
        .join(places, [*names, "__prefix", "__nth"])
        .groupBy(*names)
        .agg(*[F.max(F.when(F.col("__cut") == i, F.col("__order"))).alias(f"__at{i}") for i in range(n_ranks)])
        .select(
            *names,
            *[F.col(f"__at{i}.{f}").alias(f"__at{i}_{f}") for i in range(n_ranks) for f in order_fields],
        )
    )
    empty_cuts = [F.max(F.when(F.col("__cut") == i, F.col("__none"))).alias(f"__none{i}") for i in range(n_ranks)]
    bounds = inline_if_small(places.groupBy(*names).agg(*empty_cuts).join(found, names, "left"))

    def is_past(i: int) -> Column:
        cut = F.struct(*[F.col(f"__at{i}_{f}").alias(f) for f in order_fields])
        return F.col(f"__none{i}") | (F.col(f"__at{i}_digest").isNotNull() & (order_key > cut))

    above = [F.when(is_past(i), 1).otherwise(0) for i in range(n_ranks)]
    return (
        df.select("*", *strata_cols)
        .join(bounds, names)
        .withColumn(target, reduce(lambda x, y: x + y, above))
        .select(*[c for c in df.columns if c != target], target)
    )


def _over_classes() -> Window:
    """All rows of a per-class table; never used on data rows."""
    return Window.partitionBy(F.lit(0))


def _split_quota(totals: DataFrame, label: str, size: str, fraction: float, target: str) -> DataFrame:
    """Share ceil(fraction * rows) over classes by largest remainder, ties by label."""
    big = "decimal(38,0)"
    everything = F.sum(size).over(_over_classes())
    want = F.ceil(F.lit(float(fraction)) * everything.cast("double")).cast("long")
    product = F.col(size).cast("decimal(19,0)") * F.col("__want").cast("decimal(19,0)")
    return (
        totals.withColumns({"__all": everything, "__want": want})
        .withColumns(
            {
                "__base": F.floor(product / F.greatest(F.col("__all"), F.lit(1))).cast("long"),
                "__left": (product % F.greatest(F.col("__all"), F.lit(1))).cast(big),
            }
        )
        .withColumn(
            "__place", F.row_number().over(_over_classes().orderBy(F.desc("__left"), F.col(label)))
        )
        .withColumn("__spare", F.col("__want") - F.sum("__base").over(_over_classes()))
        .withColumn(
            target, F.col("__base") + F.when(F.col("__place") <= F.col("__spare"), 1).otherwise(0)
        )
        .drop("__all", "__want", "__base", "__left", "__place", "__spare")
    )


def sample_rows(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` random rows, or all if there are fewer. Also serves as a row cap."""
    banded = rank_bands(df, key_cols, [], lambda t: t.withColumn("rank_0", F.lit(n)), 1, seed, "__band")
    return banded.filter("__band = 0").drop("__band")


def _draw(seed: int, key_cols: Sequence[str]) -> Column:
    """A whole number below 2**32 from the row's digest."""
    return F.conv(F.substring(shuffle_digest(seed, key_cols), 1, 8), 16, 10).cast("long")


def sample_fraction(df: DataFrame, fraction: float, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """An approximate sample in one pass, where the exact size does not matter; the same rows on any cluster."""
    return df.filter(_draw(seed, key_cols) < round(fraction * 2**32))


def sample_fraction_by(
    df: DataFrame, label: str, fractions: dict, key_cols: Sequence[str], seed: int = 42
) -> DataFrame:
    """A fraction of each class; classes without a fraction, and unlabelled rows, go."""
    limit = F.lit(0).cast("long")
    for value, fraction in fractions.items():
        limit = F.when(F.col(label) == value, round(fraction * 2**32)).otherwise(limit)
    return df.filter(_draw(seed, key_cols) < limit)


def balance_classes(
    df: DataFrame, key_cols: Sequence[str], label: str = "label", seed: int = 42
) -> DataFrame:
    """Undersample every class to the size of the smallest; rows without a label are no class and go."""
    smallest = lambda t: t.withColumn("rank_0", F.min("n").over(_over_classes()))
    banded = rank_bands(df.filter(F.col(label).isNotNull()), key_cols, [label], smallest, 1, seed, "__band")
    return banded.filter("__band = 0").drop("__band")


def stratified_split(
    df: DataFrame,
    key_cols: Sequence[str],
    label: str = "label",
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: train or test, with class shares kept; unlabelled rows are a class of their own."""
    quota = lambda t: _split_quota(t, label, "n", test_size, "rank_0")
    banded = rank_bands(df, key_cols, [label], quota, 1, seed, "__band")
    return banded.withColumn("split", F.when(F.col("__band") == 0, TEST).otherwise(TRAIN)).drop("__band")


def percent_split(
    df: DataFrame, key_cols: Sequence[str], train_percent: float, seed: int = 42
) -> DataFrame:
    """Add ``split`` with int(rows * percent / 100) train rows, not stratified."""
    size = F.floor(F.col("n") * F.lit(train_percent / 100.0)).cast("long")
    banded = rank_bands(df, key_cols, [], lambda t: t.withColumn("rank_0", size), 1, seed, "__band")
    return banded.withColumn("split", F.when(F.col("__band") == 0, TRAIN).otherwise(TEST)).drop("__band")


def kfold(
    df: DataFrame,
    key_cols: Sequence[str],
    k: int = 5,
    seed: int = 42,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Add ``fold`` 1..k; fold sizes differ by at most one (within each stratum)."""

    def ends(totals):
        base, extra = F.floor(F.col("n") / k).cast("long"), F.col("n") % k
        return totals.withColumns(
            {f"rank_{i}": base * (i + 1) + F.least(extra, F.lit(i + 1)) for i in range(k - 1)}
        )

    return rank_bands(df, key_cols, list(strata), ends, k - 1, seed, "fold").withColumn(
        "fold", F.col("fold") + 1
    )


def kfold_hashed(df: DataFrame, key_cols: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Folds of about equal size in a single pass."""
    return df.withColumn("fold", (_draw(seed, key_cols) % k).cast("int") + 1)


def top_groups(df: DataFrame, group: str, label: str = "label", positive=1, n: int = 1) -> DataFrame:
    """The ``n`` groups with the most positive rows, ties by name."""
    return (
        df.filter((F.col(label) == positive) & F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count("*").alias("n_positive"))
        .orderBy(F.desc("n_positive"), group)
        .limit(n)
    )


def mark_top_groups(
    df: DataFrame, group: str, label: str = "label", positive=1, n: int = 1, target: str = "is_top"
) -> DataFrame:
    """Add whether the row's group is one of the ``n`` top groups.

    The joined side has at most ``n`` rows by construction.
    """
    top = inline_if_small(top_groups(df, group, label, positive, n).select(group).withColumn(target, F.lit(True)))
    return df.join(top, group, "left").withColumn(target, F.coalesce(target, F.lit(False))).select(
        *df.columns, target
    )


def holdout_top_group(df: DataFrame, group: str, label: str = "label", positive=1):
    """``(rest, held_out)``: all rows of the top group, and everything else."""
    marked = mark_top_groups(df, group, label, positive)
    return marked.filter("not is_top").drop("is_top"), marked.filter("is_top").drop("is_top")


def holdout_top_group_positives(df: DataFrame, group: str, label: str = "label", positive=1):
    """``(rest, held_out)``: only the top group's positive rows are held out.

    The group's other rows are in neither part.
    """
    rest, held = holdout_top_group(df, group, label, positive)
    return rest, held.filter(F.col(label) == positive)


def holdout_top_group_per_class(df: DataFrame, group: str, label: str = "label"):
    """``(rest, held_out)``: for each class, the rows of that class's largest group."""
    counts = df.dropna(subset=[group]).groupBy(label, group).agg(F.count("*").alias("__n"))
    best = counts.groupBy(label).agg(
        F.min_by(group, F.struct((-F.col("__n")).alias("n"), F.col(group))).alias(group)
    )
    best = inline_if_small(best)
    return df.join(best, [label, group], "left_anti"), df.join(best, [label, group], "left_semi")


def top_groups_balanced(
    df: DataFrame,
    group: str,
    key_cols: Sequence[str],
    label: str = "label",
    n: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Rows of the ``n`` top groups, undersampled to equal classes.

    If only one class occurs there, all its rows stay.
    """
    marked = mark_top_groups(df, group, label, 1, n)
    rows = marked.filter(F.col("is_top") & F.col(label).isin(0, 1)).drop("is_top")
    return balance_classes(rows, key_cols, label, seed)


def top_up_holdout(
    df: DataFrame,
    key_cols: Sequence[str],
    label: str = "label",
    split: str = "split",
    seed: int = 42,
) -> DataFrame:
    """Move test negatives to the hold-out until it has as many negatives as positives.

    Nothing moves if test has too few.
    """

    def need(totals):
        def size(part, code):
            match = (F.col(split) == part) & (F.col(label) == code)
            return F.coalesce(F.sum(F.when(match, F.col("n"))).over(_over_classes()), F.lit(0))

        gap = size(HOLDOUT, 1) - size(HOLDOUT, 0)
        movable = (F.col(split) == TEST) & (F.col(label) == 0) & (gap > 0) & (gap <= F.col("n"))
        return totals.withColumn("rank_0", F.when(movable, gap).otherwise(0))

    banded = rank_bands(df, key_cols, [split, label], need, 1, seed, "__band")
    return banded.withColumn(
        split, F.when(F.col("__band") == 0, HOLDOUT).otherwise(F.col(split))
    ).drop("__band")


def split_overlap(df: DataFrame, key_cols: Sequence[str], split: str = "split") -> DataFrame:
    """Keys that occur in more than one split; empty for a sound split."""
    return (
        df.groupBy(*key_cols)
        .agg(F.min(split).alias("__first"), F.max(split).alias("__last"))
        .filter("__first <> __last")
        .select(*key_cols)
    )
