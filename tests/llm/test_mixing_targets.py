"""Rates against plain projected gradient on the whole table, and targets that are met."""

import numpy as np
import pytest

from tallyhouse.llm import mixing


def table(seed, n=200, soft=0.3):
    random = np.random.default_rng(seed)
    p = random.dirichlet([soft * 8, soft * 2, soft], n)
    tokens = random.integers(0, 400, n)
    tokens[:3] = [0, 5000, 1]
    return p, tokens


def chances_of(spark, p, tokens):
    rows = [(i, int(t), x.tolist()) for i, (x, t) in enumerate(zip(p, tokens))]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>").repartition(3)


def plain(p, tokens, wanted, ridge, least=0.0, steps=60_000):
    """The same least squares, by plain steps on all rates."""
    w = tokens / tokens.sum()
    mass, r = w @ p, np.ones(len(p))
    for _ in range(steps):
        gradient = p @ (((w * r) @ p - wanted) / mass) + ridge * (r - 1)
        r = np.maximum(least, r - gradient / (1 + ridge))
    return r


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_plain_steps(spark, seed):
    p, tokens = table(seed)
    wanted = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    settings = mixing.Settings(ridge=1e-2)
    found = mixing.fit_rates(chances_of(spark, p, tokens), mixing.TARGETS, settings=settings)
    got = np.array([r.rate for r in found.rows.orderBy("doc_id").collect()])
    want = plain(p, tokens, wanted, 1e-2)
    assert np.abs(got - want).max() < 1e-3 and (want == 0).any()


@pytest.mark.parametrize("soft", [0.05, 0.3, 2.0])
def test_targets_are_met(spark, soft):
    p, tokens = table(7, 500, soft)
    found = mixing.fit_rates(chances_of(spark, p, tokens), mixing.TARGETS)
    rates = np.array([r.rate for r in found.rows.orderBy("doc_id").collect()])
    shares = (tokens * rates) @ p / tokens.sum()
    assert (rates >= 0).all() and found.steps < 40
    for i, name in enumerate(mixing.DOMAINS):
        assert abs(shares[i] - mixing.TARGETS[name]) < 1e-4
        assert abs(shares[i] - found.shares[name]) < 1e-9


def test_targets_out_of_reach(spark):
    """No rates of two kinds of documents give three shares: the miss is told."""
    p, tokens = np.array([[0.5, 0.3, 0.2], [0.9, 0.1, 0.0]] * 50), np.full(100, 10)
    found = mixing.fit_rates(chances_of(spark, p, tokens), mixing.TARGETS)
    assert max(abs(x) for x in found.residuals.values()) > 1e-3
    rates = np.array([r.rate for r in found.rows.orderBy("doc_id").collect()])
    want = plain(p, tokens, np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]), 1e-6)
    assert np.isfinite(rates).all() and np.abs(rates - want).max() < 1e-2


@pytest.mark.parametrize("soft", [0.3, 2.0])
def test_targets_below_what_good_documents_bring(spark, soft):
    """Good documents stay whole, so the toxic target cannot be met: the steps end, and
    where the objective is least."""
    p, tokens = table(7, 500, soft)
    found = mixing.fit_rates(chances_of(spark, p, tokens), mixing.TARGETS, whole="good")
    assert found.steps < 40 and found.residuals["toxic"] > 1e-2
    rates = np.array([r.rate for r in found.rows.orderBy("doc_id").collect()])
    good = p[:, 0] >= p.max(axis=1)
    assert np.isfinite(rates).all() and (rates >= 0).all() and (rates[good] >= 1).all()
    w = tokens / tokens.sum()
    mass = w @ p
    total = max(1.0, mass[0] / mixing.TARGETS["good"])
    missed = (w * rates) @ p - total * np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    gradient = p @ (missed / mass) + 1e-6 * (rates - 1)
    least = np.where(good, 1.0, 0.0)
    assert np.abs(rates - np.maximum(least, rates - gradient)).max() < 1e-3


def test_a_domain_that_is_nowhere(spark):
    p, tokens = table(3)
    p[:, 2] = 0
    found = mixing.fit_rates(chances_of(spark, p, tokens), mixing.TARGETS)
    assert abs(found.shares["good"] - 0.9 / 0.98) < 1e-4 and found.shares["toxic"] == 0
    none = mixing.fit_rates(chances_of(spark, p, tokens * 0), mixing.TARGETS)
    assert {r.rate for r in none.rows.collect()} == {1.0}
