"""A small softmax classifier of texts by byte shares and shape, used by two operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import LOWER, WORD, small_batches, strings
from issuelens.llm.toxicity import held_out
from issuelens.session import materialize

SAMPLE_ROWS = 20_000
FEATURES = 256 + 7
LOW = np.frombuffer(LOWER, np.uint8)


def text_features(text: bytes) -> tuple[np.ndarray, int]:
    """Byte shares and shape of a whole text, and its number of words."""
    out = np.zeros(FEATURES)
    data = np.frombuffer(text, np.uint8)
    words = WORD.findall(text.translate(LOWER))
    if len(data):
        out[:256] = np.sqrt(np.bincount(LOW[data], minlength=256) / len(data))
    lines = text.split(b"\n")
    n = max(len(words), 1)
    out[256:] = (
        np.log1p(len(words)),
        np.log1p(len(text) / n),
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        float(np.mean((data >= 65) & (data <= 90))) if len(data) else 0.0,
        np.log1p(max(map(len, words), default=0)),
        np.log1p(len(text) / len(lines)),
    )
    return out, len(words)


def batch_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = strings(column)
    data = data.tobytes()
    rows = [text_features(data[a:b]) for a, b in zip(at[:-1], at[1:])]
    return np.array([r[0] for r in rows]).reshape(-1, FEATURES), np.array([r[1] for r in rows], np.int64)


class Softmax:
    """Class probabilities from standardised features."""

    def __init__(self, names: list, mean, scale, beta):
        self.names, self.mean, self.scale, self.beta = names, mean, scale, beta

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.beta[1:] + self.beta[0]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, labels: list, ridge: float = 1e-3, steps: int = 300) -> Softmax:
    """Accelerated gradient steps on the mean log loss with a ridge on the weights."""
    names = sorted(set(labels))
    y = np.zeros((len(labels), len(names)))
    y[np.arange(len(labels)), [names.index(v) for v in labels]] = 1
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    design = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    beta = np.zeros((design.shape[1], len(names)))
    beta[0] = np.log(y.mean(axis=0))
    rate = 2.0 / (np.linalg.norm(design, 2) ** 2 / len(x) + ridge)
    ahead, t = beta, 1.0
    for _ in range(steps):
        z = design @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = design.T @ (p - y) / len(x)
        slope[1:] += ridge * ahead[1:]
        step, t_next = ahead - rate * slope, (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, beta, t = step + (t - 1) / t_next * (step - beta), step, t_next
    return Softmax(names, mean, scale, beta)


def labelled_sample(docs: DataFrame, labels: DataFrame, value: Column, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(text, value) of at most ``limit`` labelled rows, those with the smallest hash of their id.

    Only rows outside the held-out fifth; the bounded list of ids goes to the scan, so no
    text is shuffled. ``value`` may use columns of ``labels`` and of ``docs``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    known = known.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(limit)
    kept = [c for c in docs.columns if c == "doc_id" or c not in known.columns]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).join(F.broadcast(known), "doc_id")
    rows = rows.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), value.alias("value"))
    return materialize(rows.where(F.col("value").isNotNull()), "labelled")


def fit_texts(rows: DataFrame) -> Softmax | None:
    """A classifier of (text, value) rows; None without two classes. Features come from tasks."""
    small_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            x, _ = batch_features(batch.column(0))
            flat = pa.array(x.astype(np.float32).ravel())
            x = pa.FixedSizeListArray.from_arrays(flat, FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([x, batch.column(1).cast(pa.string())], names=["x", "value"])

    got = rows.select("text", "value").mapInArrow(run, "x array<float>, value string").orderBy("value", "x").toArrow()
    values = got.column("value").to_pylist()  # a bounded sample, in a fixed order
    if len(set(values)) < 2:
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(values), FEATURES)
    return fit_softmax(x.astype(float), values)
