"""Rates of the mixing operator against a dense solver, and targets that need many or large steps."""

import numpy as np
import pytest

from issuelens.llm.common import table
from issuelens.llm.mixing import SMALLEST_TARGET, TOLERANCE, Rates, _pass, _sums, mixing_report, solve


def members(spark, tokens, posteriors):
    rows = [(i, int(t), [float(x) for x in p], 0.5) for i, (t, p) in enumerate(zip(tokens, posteriors))]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>, draw double").coalesce(2)


def dense(tokens, p, targets, low, high, steps=100_000):
    """Least relative errors by plain projected gradient on the whole matrix."""
    a = (p * tokens[:, None] / tokens.sum()).T / np.maximum(targets, SMALLEST_TARGET)[:, None]
    b = targets / np.maximum(targets, SMALLEST_TARGET)
    rate, length = np.ones(len(tokens)), 1 / np.linalg.eigvalsh(a @ a.T)[-1]
    for _ in range(steps):
        rate = np.clip(rate - length * a.T @ (a @ rate - b), low, high)
    return np.sum((a @ rate - b) ** 2)


@pytest.mark.parametrize("low, high, seed", [(0.0, None, 1), (0.5, 2.0, 2), (1.0, 1.5, 3)])
def test_least_squares_of_a_dense_solver(spark, low, high, seed):
    draw = np.random.default_rng(seed)
    tokens, p = draw.integers(1, 100, 50), draw.dirichlet([0.3] * 4, 50)
    shares = tokens @ p / tokens.sum()
    targets = shares * draw.uniform(0.3, 3, 4)
    _, _, reached = solve(members(spark, tokens, p), targets, low, high)
    ours = np.sum(((reached - targets) / np.maximum(targets, SMALLEST_TARGET)) ** 2)
    best = dense(tokens.astype(float), p, targets, low, np.inf if high is None else high)
    assert ours <= best + max(4 * TOLERANCE**2, 1e-3 * best)


def test_a_domain_twenty_times_its_share(spark):
    p = np.repeat([[1.0, 0.0], [0.0, 1.0]], [99, 1], axis=0)
    rates, _, reached = solve(members(spark, np.full(100, 10), p), [0.8, 0.2])
    assert np.allclose(reached, [0.8, 0.2], rtol=2 * TOLERANCE) and rates.of(p).max() > 19


def test_posteriors_that_overlap(spark):
    p = np.repeat([[0.55, 0.45], [0.45, 0.55]], 30, axis=0)
    rates, _, reached = solve(members(spark, np.full(60, 7), p), [0.53, 0.47])
    assert np.allclose(reached, [0.53, 0.47], rtol=2 * TOLERANCE)
    assert np.allclose(np.unique(rates.of(p).round(2)), [0.4, 1.6], atol=0.03)


def test_too_few_steps_are_no_secret(spark):
    p = np.repeat([[0.55, 0.45], [0.45, 0.55]], 30, axis=0)
    with pytest.raises(RuntimeError, match="still move"):
        solve(members(spark, np.full(60, 7), p), [0.53, 0.47], steps=2)


def test_report(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    found = mixing_report(table(spark, folder, "documents"), table(spark, folder, "labels")).collect()
    assert len(found) > 1 and abs(sum(r["share"] for r in found) - 1) < 1e-9
    assert all(abs(r["reached"] - r["target"]) <= TOLERANCE * r["target"] * 1.01 for r in found)


def scarce(rows, overlap, seed):
    """Tokens and posteriors of one large domain and seven small ones."""
    draw = np.random.default_rng(seed)
    p = draw.dirichlet(np.array([0.12, 0.016, 0.57, 0.07, 0.08, 0.012, 0.11, 0.02]) * 8 * overlap + 1e-3, rows)
    return draw.integers(1, 100, rows), p


def test_bounds_that_most_documents_meet(spark):
    """Steps with momentum alone did not end within the passes allowed."""
    tokens, p = scarce(300, 0.05, 1)
    _, targets, reached = solve(members(spark, tokens, p), low=1.0, steps=100)
    assert np.allclose(reached, targets, rtol=TOLERANCE)
    tokens, p = scarce(300, 0.2, 2)  # the large domain cannot give up what the small ones bring
    _, targets, reached = solve(members(spark, tokens, p), low=1.0, steps=140)
    assert np.sum((reached / targets - 1) ** 2) == pytest.approx(3.3431e-4, rel=1e-2)


def test_a_pass_shuffles_nothing(spark):
    rows = members(spark, *scarce(50, 0.2, 1))
    found = _sums(rows, Rates(1.0, None))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2  # a row a task


def test_many_tasks_are_added_by_spark(spark):
    rows = members(spark, *scarce(300, 0.05, 1))
    rates = Rates(1.0, None)
    assert np.allclose(_pass(rows, rates, False), _pass(rows, rates, True))
