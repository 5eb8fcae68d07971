"""Mixing documents to target token weights per domain, by soft membership.

A classifier fitted on labelled rows gives every document a posterior over domains. Rates
r >= 0 minimise the squared relative errors of the expected domain totals sum(r t p)
against the targets, by projected gradient with momentum, and where that is slow by
projected gradient at the point a step reaches. A pass over the narrow table of tokens and
posteriors gives the domain totals of a step; a rate follows from the posterior and the
totals so far, so rates are never stored or moved between passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.classify import Softmax, batch_features, fit_texts, labelled_sample
from issuelens.llm.common import fresh, small_batches
from issuelens.session import materialize

STEPS = 400
TOLERANCE = 1e-3
STILL = 1e-7
SMALLEST_TARGET = 1e-4
DIRECT_TASKS = 512
TEMPERATURE = 0.8
MEMBERS = "doc_id long, n_tokens long, posterior array<double>, draw double"


def domain_value():
    """Language and labelled quality; rows without either teach nothing."""
    return F.when(
        F.col("lang").isNotNull() & F.col("quality").isin(0, 1),
        F.concat("lang", F.when(F.col("quality") == 1, "-good").otherwise("-poor")),
    )


def _posteriors(model: Softmax | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x, tokens = batch_features(column)
    return (np.ones((len(x), 1)) if model is None else model.probabilities(x)), tokens


def memberships(docs: DataFrame, model: Softmax | None, seed: int = 0) -> DataFrame:
    """doc_id, n_tokens, posterior and the uniform draw of every row, stored."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, tokens = _posteriors(sent.value, batch.column(1))
            flat = pa.ListArray.from_arrays(np.arange(len(p) + 1) * p.shape[1], pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens), flat, batch.column(2)], names=["doc_id", "n_tokens", "posterior", "draw"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), draw(seed))
    return materialize(rows.mapInArrow(run, MEMBERS), "members")


def draw(seed: int):
    """A number in [0, 1) from the id and the text, the same on any cluster."""
    return (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) / float(1 << 53)).alias("__draw")


class Rates:
    """Document rates as a function of the posterior: the steps taken so far.

    A step goes from the point ahead against the gradient, back into the bounds, and sets
    the next point ahead by some momentum.
    """

    def __init__(self, low: float, high: float | None):
        self.low, self.high, self.steps = low, np.inf if high is None else high, []

    def after_steps(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rates, the point ahead, and how far the last step moved the rates."""
        rate = ahead = np.full(len(p), min(max(1.0, self.low), self.high))
        moved = np.zeros(len(p))
        for slope, momentum in self.steps:
            new = np.clip(ahead - p @ slope, self.low, self.high)
            moved = new - rate
            rate, ahead = new, new + momentum * moved
        return rate, ahead, moved

    def of(self, p: np.ndarray) -> np.ndarray:
        return self.after_steps(p)[0]


def default_targets(shares: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
    """Token targets, as parts of all tokens there are, that give small domains more.

    Shares to a power below one, scaled so that no domain has to give up tokens.
    """
    raised = np.where(shares > 0, np.maximum(shares, 1e-12) ** temperature, 0.0)
    held = shares > 0
    return raised * np.max(shares[held] / raised[held]) if held.any() else shares


def _sums(members: DataFrame, rates: Rates) -> DataFrame:
    """For each task sums over its documents: rows of domain totals by rate, by the point ahead,
    by one, the movement, and the products of posteriors, one after the other. After a step
    products are of documents between their bounds only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                p = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                t = batch.column(0).to_numpy()
                rate, ahead, moved = rates.after_steps(p)
                free = t * ((rate > rates.low) & (rate < rates.high)) if rates.steps else t
                own = np.vstack([(rate * t) @ p, (ahead * t) @ p, t @ p, (np.abs(moved) * t) @ p, (p * free[:, None]).T @ p])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["sums"])

    return members.select("n_tokens", "posterior").mapInArrow(run, "sums array<double>")


def _few_tasks(members: DataFrame) -> bool:
    return members.rdd.getNumPartitions() <= DIRECT_TASKS


def _pass(members: DataFrame, rates: Rates, direct: bool) -> np.ndarray | None:
    """:func:`_sums` over all documents, a row each. Many tasks' sums are added by Spark first;
    without that a pass has no shuffle, whose files would stay until the driver collects garbage."""
    found = _sums(members, rates)
    if not direct:
        found = found.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
        found = found.orderBy("at")
    rows = found.collect()  # (4 + domains) x domains numbers, or as many a task
    if not rows:
        return None
    total = np.sum([r["sums"] for r in rows], axis=0) if direct else np.array([r["value"] for r in rows])
    return total.reshape(-1, round(np.sqrt(4 + len(total)) - 2))


def solve(members: DataFrame, targets=None, low: float = 0.0, high: float | None = None, steps: int = STEPS) -> tuple[Rates, np.ndarray, np.ndarray]:
    """Rates, targets and the totals reached, both as parts of all tokens.

    ``targets`` None: :func:`default_targets`. Ends when every total is within
    ``TOLERANCE`` of its target, or when steps no longer move the rates: bounds or
    posteriors then do not allow more, which the totals tell. Raises RuntimeError if
    neither is so after ``steps`` passes. Errors are relative to the target, or to
    ``SMALLEST_TARGET`` if that is smaller.

    The first half of the passes takes steps with momentum. If they do not end, steps
    follow whose gradient is that of the point they reach: it is found by Newton's rule on
    one number a domain, and each such step is four times as long as the one before.
    """
    rates, direct = Rates(low, high), _few_tasks(members)
    now = _pass(members, rates, direct)
    if now is None or now[2].sum() == 0:
        return rates, np.zeros(0), np.zeros(0)
    every = now[2].sum()
    targets = default_targets(now[2] / every) if targets is None else np.asarray(targets, float)
    floor = np.maximum(targets, SMALLEST_TARGET)

    def curvature():
        return now[4:] / every / np.outer(floor, floor)

    def error():
        return (now[0] / every - targets) / floor

    def ended():
        total = now[0].sum() / every
        return np.max(np.abs(error())) < TOLERANCE or (rates.steps and now[3].sum() / every < STILL * max(1.0, total))

    length = 1 / max(np.linalg.eigvalsh(curvature())[-1], 1e-12)
    weight, least, left = 1.0, np.inf, steps
    while not ended() and left > steps // 2:
        if error() @ error() > least:
            weight = 1.0  # momentum went too far
        least = error() @ error()
        following = (1 + np.sqrt(1 + 4 * weight**2)) / 2
        rates.steps.append((length * (now[1] / every - targets) / floor**2, (weight - 1) / following))
        weight, left = following, left - 1
        now = _pass(members, rates, direct)
    if not ended() and rates.steps:
        rates.steps[-1] = (rates.steps[-1][0], 0.0)  # the next step goes from the rates, not from the point ahead
    length *= 5
    while not ended() and left:
        rates.steps.append((np.zeros(len(targets)), 0.0))
        slope, apart = np.zeros(len(targets)), -length * error()  # slope less that at the point reached
        while left and np.linalg.norm(apart) > 0.01 * np.linalg.norm(slope):
            turn, part, before = np.linalg.solve(np.eye(len(targets)) + length * curvature(), apart), 1.0, apart
            while left:
                tried = slope - part * turn
                rates.steps[-1] = (tried / floor, 0.0)
                now, left = _pass(members, rates, direct), left - 1
                apart = tried - length * error()
                if apart @ turn >= -0.5 * (before @ turn) or part < 1e-9:
                    break
                part /= 2  # too far
            slope = tried
            if np.max(np.abs(error())) < TOLERANCE:
                break
        length *= 4
    if ended():
        return rates, targets, now[0] / every
    raise RuntimeError(f"rates still move after {steps} steps: targets {targets.tolist()}, reached {(now[0] / every).tolist()}")


def fit_domains(docs: DataFrame, labels: DataFrame) -> Softmax | None:
    return fit_texts(labelled_sample(docs, labels, domain_value()))


def mix_documents(docs: DataFrame, labels: DataFrame, targets=None, low: float = 0.0, high: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), rate and copies of every row.

    ``copies`` is the rate rounded up or down at random by a hash of id and text, so its
    mean is the rate. Empty and null texts have no tokens and a rate like others. With
    labels of less than two domains all belong to one. Rows that are equal get equal
    results; an empty table gives an empty one.
    """
    model = fit_domains(docs, labels)
    members = memberships(docs, model, seed)
    rates, _, _ = solve(members, targets, low, high)
    names = ["all"] if model is None else model.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            rate = rates.of(p)
            domain = [names[i] for i in p.argmax(axis=1)] if batch.num_rows else []
            copies = (np.floor(rate) + (batch.column(3).to_numpy() < rate % 1)).astype(np.int32)
            arrays = [batch.column(0), batch.column(1), pa.array(domain, pa.string()), pa.array(rate), pa.array(copies)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "domain", "rate", "copies"])

    return members.mapInArrow(run, "doc_id long, n_tokens long, domain string, rate double, copies int")


def mixing_report(docs: DataFrame, labels: DataFrame, targets=None, low: float = 0.0, high: float | None = None) -> DataFrame:
    """domain, share, target and reached, each as parts of all tokens: what the rates come to."""
    model = fit_domains(docs, labels)
    members = memberships(docs, model)
    _, targets, reached = solve(members, targets, low, high)
    names = ["all"] if model is None else list(model.names)
    plain = _pass(members, Rates(1.0, 1.0), _few_tasks(members))
    shares = plain[0] / plain[2].sum() if len(reached) else []
    rows = [(n, float(s), float(t), float(r)) for n, s, t, r in zip(names, shares, targets, reached)]
    return docs.sparkSession.createDataFrame(rows, "domain string, share double, target double, reached double")


def repeat_documents(docs: DataFrame, labels: DataFrame, targets=None, low: float = 1.0, high: float | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as its number of copies says; columns unchanged.

    With ``low`` = 1 no document is lost and scarce domains are repeated.
    """
    model = fit_domains(docs, labels)
    rates, _, _ = solve(memberships(docs, model, seed), targets, low, high)
    text = docs.columns.index("text")
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model, rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rates = sent.value
        for batch in batches:
            p, _ = _posteriors(model, batch.column(text))
            rate = rates.of(p)
            copies = (np.floor(rate) + (batch.column(batch.num_columns - 1).to_numpy() < rate % 1)).astype(np.int64)
            kept = batch.select(list(range(batch.num_columns - 1)))
            yield kept.take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    return docs.select("*", draw(seed).alias(fresh(docs, "__draw"))).mapInArrow(run, docs.schema)
