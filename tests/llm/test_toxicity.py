"""The bounded sample, and the chain against a plain fit."""

import numpy as np

from popspark.llm import toxicity


def test_sample_is_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 3, f"text number {i}") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(3)], "doc_id bigint, quality int, toxic int")
    got = toxicity.sampled(docs, labels, ["quality", "toxic"], most=10)
    assert got.count() == 10
    assert toxicity.sampled(docs, labels, ["quality", "toxic"], most=100).count() == 60


def test_empty_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, ["quality", "toxic"]).collect()}
    assert set(got) == {1, 2} and not got[1].toxic and not got[2].toxic


def test_fit_minimises_the_penalised_loss():
    """No small change of a weight, nor of the bias, lowers the mean log loss plus the penalty."""
    g = np.random.default_rng(1)
    n, k = 200, 6
    x = g.random((n, k)) < 0.4
    more = g.random((n, 1))
    y = (g.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - 2 * x[:, 1] + more[:, 0] - 0.5)))).astype(float)
    slots = [np.flatnonzero(row) for row in x]
    w, v, bias = toxicity.fitted(slots, more, y, steps=5000)

    def loss(w, v, bias):
        margin = x @ w[:k] + more @ v + bias
        return np.mean(np.log1p(np.exp(margin)) - y * margin) + toxicity.PENALTY * np.abs(w).sum()

    best = loss(w, v, bias)
    for j in range(k):
        for step in (-0.02, 0.02):
            moved = w.copy()
            moved[j] += step
            assert loss(moved, v, bias) >= best - 1e-6
    for step in (-0.02, 0.02):
        assert loss(w, v + step, bias) >= best - 1e-6 and loss(w, v, bias + step) >= best - 1e-6
