"""Copula prices: closed forms for two legs, identity, Monte Carlo for more, refusals."""

import math

import numpy as np

from tickline.operators import copula


def test_two_legs_are_the_bivariate_normal():
    for rho in (-0.99, -0.6, 0.0, 0.3, 0.9, 0.999):
        got, exact, reason = copula.joint(np.array([0.5, 0.5]), np.array([[1, rho], [rho, 1]]))
        assert abs(got - (0.25 + math.asin(rho) / (2 * math.pi))) < 1e-9 and exact and reason is None
    assert copula.bivariate(0.3, -0.2, 1.0) == min(float(copula._phi(0.3)), float(copula._phi(-0.2)))
    assert copula.joint(np.array([0.2, 0.3]), np.array([[1, -1.0], [-1.0, 1]]))[0] == 0.0


def test_identity_is_the_product():
    p = np.array([0.5, 0.4, 0.9, 0.31])
    got, exact, _ = copula.joint(p, np.eye(4))
    assert abs(got - p.prod()) < 1e-12 and exact


def test_many_legs_against_drawn_normals():
    rng = np.random.default_rng(2)
    for n in (3, 5):
        a = rng.normal(size=(n, n))
        c = a @ a.T
        c = c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
        p = rng.uniform(0.3, 0.8, n)
        got, exact, reason = copula.joint(p, c)
        z = rng.multivariate_normal(np.zeros(n), c, 2_000_000)
        t = copula._quantile(p).astype(float)
        drawn = float(np.all(z <= t, axis=1).mean())
        assert not exact and reason is None and abs(got - drawn) < 4 * math.sqrt(drawn * (1 - drawn) / 2e6) + 1e-3 * drawn
        back = rng.permutation(n)
        assert abs(copula.joint(p[back], c[np.ix_(back, back)])[0] - got) < 1e-9, "the order of legs doesn't matter"
    c = np.full((3, 3), 0.5) + 0.5 * np.eye(3)  # one common factor: the orthant of three has a closed form
    assert abs(copula.joint(np.full(3, 0.5), c)[0] - (0.125 + 3 * math.asin(0.5) / (4 * math.pi))) < 2e-4


def test_array_kernels():
    x = np.concatenate([np.linspace(-6, 6, 4001), [-50.0, 50.0, 0.0]])
    assert np.abs(copula.phi_array(x) - copula._phi(x).astype(float)).max() < 1e-13
    p = np.concatenate([np.linspace(1e-4, 1 - 1e-4, 999), [1e-9, 1 - 1e-9]])
    assert np.abs(copula.quantile_array(p) - copula._quantile(p).astype(float)).max() < 1e-5
    assert np.abs(copula.quantile_array(p[:-2]) - copula._quantile(p[:-2]).astype(float)).max() < 1e-9
    assert np.isfinite(copula.quantile_array(np.array([0.0, 1.0]))).all()


def test_no_price_without_convergence(monkeypatch):
    monkeypatch.setattr(copula, "REL", 1e-12)
    monkeypatch.setattr(copula, "ABS", 1e-15)
    monkeypatch.setattr(copula, "MOST_BATCHES", 1)
    c = np.full((3, 3), 0.5) + 0.5 * np.eye(3)
    assert copula.joint(np.array([0.3, 0.5, 0.6]), c) == (None, False, "not_converged")


def test_twenty_five_legs_within_seconds():
    import time

    start = time.time()
    c = np.full((25, 25), 0.2) + 0.8 * np.eye(25)
    got, exact, reason = copula.joint(np.full(25, 0.9), c)
    assert reason is None and not exact and 0.9**25 < got < 0.9 and time.time() - start < 60


def test_degenerate_and_refused():
    c = np.array([[1, 0.5, 0], [0.5, 1, 0], [0, 0, 1.0]])
    assert copula.joint(np.array([0.0, 0.5, 0.5]), c)[0] == 0.0
    assert abs(copula.joint(np.array([1.0, 0.5, 0.5]), c)[0] - 0.25) < 1e-12
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    assert copula.joint(np.full(3, 0.5), bad)[2] == "not_positive_semidefinite"
    assert copula.joint(np.full(26, 0.9), np.eye(26))[2] == "too_many_legs"
    assert copula.joint(np.array([0.5, float("nan")]), np.eye(2))[2] == "bad_marginal"


def test_teasers(spark):
    legs = spark.createDataFrame([(1, 1, 10, 1.9, 6.0, 1.4), (1, 2, 20, 1.9, 6.0, 1.5), (2, 3, 10, 1.9, 31.0, 1.4), (3, 4, 10, 1.9, 6.0, 2.0), (4, 5, 10, 2.0, 3.0, 1.6)], "wager_id long, leg_id long, selection_id long, odds double, points double, teased_odds double")
    pairs = spark.createDataFrame([(10, 20, 0.4)], "selection_a long, selection_b long, rho double")
    got = {r.wager_id: r for r in copula.teasers(legs, pairs).collect()}
    assert (got[2].reason, got[3].reason) == ("teaser_points", "teaser_not_favourable") and got[2].joint is None
    assert got[1].joint > 1 / 1.4 / 1.5 and got[1].exact and abs(got[4].joint - 1 / 1.6) < 1e-12
