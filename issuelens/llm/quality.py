"""Document quality by hierarchical empirical Bayes.

A classifier fitted on labelled rows gives each document a probability. Hosts and paths
of a host get a posterior quality rate: the expected number of good documents, plus what
the level above expects of as many documents as its prior is worth. That worth is found
from the spread between sites (method of moments), so sparse or uninformative sites fall
back to the host and the global rate. The document's odds are then moved by how far its
path's rate is from the global rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.classify import Softmax, batch_features, fit_texts, labelled_sample
from issuelens.llm.common import small_batches
from issuelens.llm.toxicity import held_out
from issuelens.session import materialize

WEAKEST, STRONGEST = 2.0, 1e6


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first path part of a URL, for tables that have one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def evidence(rows: DataFrame, model: Softmax | None, base: float) -> DataFrame:
    """The columns of ``rows`` but its text, and ``p``, the classifier's probability of good."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    keys = rows.drop("text")
    names = [*keys.columns, "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *held, texts = batch.columns
            if sent.value is None:
                p = pa.array([base] * batch.num_rows, pa.float64())
            else:
                x, _ = batch_features(texts)
                p = pa.array(sent.value.probabilities(x)[:, sent.value.names.index("1")].clip(1e-6, 1 - 1e-6))
            yield pa.RecordBatch.from_arrays([*held, p], names=names)

    rows = rows.select(*keys.columns, F.col("text").cast("string"))
    return rows.mapInArrow(run, keys.withColumn("p", F.lit(0.0)).schema)


def worth(sites: DataFrame, parent: str) -> float:
    """How many documents the prior of a level counts as, from the spread between sites.

    ``sites`` has n, good (expected) and noise (the sum of p(1-p)). The variance of site
    means beyond what the documents' own uncertainty explains is what a prior of strength
    w leaves: mean (1 - mean) / (1 + w). No spread: the strongest prior.
    """
    error = F.pow(F.col("good") / F.col("n") - F.col(parent), 2)
    row = sites.where("n > 0").agg(
        F.sum(F.col("n") * error).alias("spread"),
        F.sum(F.col("noise") / F.col("n")).alias("noise"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("room"),
    ).first()
    if not row["n"] or not row["room"]:
        return STRONGEST
    between = (row["spread"] - row["noise"]) / row["n"]
    return STRONGEST if between <= 0 else min(max(row["room"] / row["n"] / between - 1, WEAKEST), STRONGEST)


def site_rates(rows: DataFrame) -> tuple[DataFrame, float]:
    """Posterior rates of every (host, path) and the global rate.

    Sums are taken by path first, combined in the map tasks; hosts are sums of paths.
    """
    sums = [F.sum("seen").alias("good"), F.count(F.lit(1)).alias("n"), F.sum(F.col("p") * (1 - F.col("p"))).alias("noise")]
    paths = materialize(rows.groupBy("host", "path").agg(*sums), "paths")
    total = paths.agg(F.sum("good") / F.sum("n")).first()[0]
    if total is None:
        return paths.select("host", "path", F.lit(0.5).alias("rate")), 0.5
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("good", "n", "noise")])
    hosts = hosts.withColumn("base", F.lit(float(total)))
    w_host = worth(hosts, "base")
    host_rate = (F.col("good") + w_host * F.col("base")) / (F.col("n") + w_host)
    hosts = hosts.select("host", host_rate.alias("host_rate"))
    joined = paths.join(hosts, "host")
    w_path = worth(joined, "host_rate")
    rate = (F.col("good") + w_path * F.col("host_rate")) / (F.col("n") + w_path)
    return joined.select("host", "path", F.col("host_rate"), rate.alias("rate")), float(total)


def score_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, held_out, host, path, p_text, p_site, score and keep for every row.

    Host and path default to source and language. Labels outside the held-out fifth
    replace the classifier's probability in the sums of their site, never in the score of
    the document. Null sites are a site of their own. Null and empty texts are judged like
    others. Labels with one class or none: the classifier says the share of good labels
    (one half without labels). Repeated rows count and are returned as often as they
    occur; an empty table gives an empty one; other columns are not read.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    model = fit_texts(labelled_sample(docs, known, F.col("quality").cast("int").cast("string")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        "text",
    )
    base = 0.5 if share is None else min(max(float(share), 1e-6), 1 - 1e-6)
    scored = materialize(evidence(rows, model, base), "evidence")
    seen = scored.join(known, "doc_id", "left").withColumn("seen", F.coalesce("quality", "p"))
    rates, total = site_rates(seen)
    odds = F.log(F.col("p") / (1 - F.col("p")))
    clipped = F.greatest(F.lit(1e-6), F.least(F.col("rate"), F.lit(1 - 1e-6)))
    base = min(max(total, 1e-6), 1 - 1e-6)
    shift = F.log(clipped / (1 - clipped)) - F.log(F.lit(base) / (1 - F.lit(base)))
    joined = scored.join(rates, ["host", "path"])
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "host",
        "path",
        F.col("p").alias("p_text"),
        F.col("rate").alias("p_site"),
        (1 / (1 + F.exp(-(odds + shift)))).alias("score"),
    ).withColumn("keep", F.col("score") >= 0.5)
