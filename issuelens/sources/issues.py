"""Issue dumps: nested issue JSON to the flat issue table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.operators.small import inline_if_small

# The fields of a raw issue and their types.
RAW_ISSUE_SCHEMA = (
    "id long, number long, title string, body string, state string, "
    "created_at string, updated_at string, closed_at string, "
    "user struct<login: string>, labels array<struct<name: string>>, "
    "comments long, html_url string, pull_request struct<url: string>"
)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Raw issues from JSON lines, without schema inference."""
    return spark.read.schema(RAW_ISSUE_SCHEMA).json(path)


def stream_issues(spark: SparkSession, path: str, max_files: int = 100, glob: str | None = None) -> DataFrame:
    """Raw issues from a folder new JSON-lines files arrive in."""
    reader = spark.readStream.schema(RAW_ISSUE_SCHEMA).option("maxFilesPerTrigger", max_files)
    return (reader if glob is None else reader.option("pathGlobFilter", glob)).json(path)


def drop_pull_requests(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("pull_request").isNull())


def filter_state(issues: DataFrame, state: str = "all") -> DataFrame:
    if state not in ("open", "closed", "all"):
        raise ValueError(f"state must be open, closed or all, not {state!r}")
    return issues if state == "all" else issues.filter(F.col("state") == state)


def flatten_issues(raw: DataFrame) -> DataFrame:
    """The 12-column issue table; label names stay an array until a CSV is written."""
    return raw.select(
        "id",
        "number",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        "state",
        F.try_to_timestamp("created_at").alias("created_at"),
        F.try_to_timestamp("updated_at").alias("updated_at"),
        F.try_to_timestamp("closed_at").alias("closed_at"),
        F.coalesce("user.login", F.lit("")).alias("user_login"),
        F.transform(F.coalesce("labels", F.array()), lambda entry: entry["name"]).alias("labels"),
        F.coalesce("comments", F.lit(0)).alias("comments"),
        F.coalesce("html_url", F.lit("")).alias("url"),
    )


def newest_issues(issues: DataFrame, limit: int | None = 100, created: str = "created_at", key: str = "id") -> DataFrame:
    """One row per issue, the newest ``limit`` of them; all if ``limit`` is None.

    With a limit, the wanted ids are found from ids and times alone (a top-k per task
    and a merge), and only their rows are carried on. Repeats of an id collapse
    map-side.
    """
    rows = issues
    if limit is not None:
        latest = issues.groupBy(key).agg(F.max(created).alias("__created"))
        wanted = latest.orderBy(F.desc("__created"), F.desc(key)).limit(limit).select(key)
        rows = issues.join(inline_if_small(wanted), key, "left_semi")
    columns = issues.columns
    # Versions with equal times: a hash of the whole row decides, the same on every run.
    content = F.xxhash64(F.to_json(F.struct(*columns)))
    latest_version = F.struct(created, *[c for c in ("updated_at",) if c in columns], content.alias("__content"))
    unique = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), latest_version).alias("__row"))
    return unique.select("__row.*").orderBy(F.desc(created), F.desc(key))
