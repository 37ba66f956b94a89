"""Pair copulas against numeric derivatives and inverses; vines against their own simulations."""

import numpy as np
import pytest

from riskloom.operators import vine

PAIRS = [vine.Pair("gaussian", 0, 0.6), vine.Pair("student", 0, -0.4, 5.0), vine.Pair("clayton", 90, 1.5), vine.Pair("clayton", 180, 2.0), vine.Pair("gumbel", 0, 1.8), vine.Pair("gumbel", 270, 1.4), vine.Pair("frank", 0, -4.0)]


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: f"{p.family}{p.turn}")
def test_pair_functions_agree(pair):
    rng = np.random.default_rng(0)
    u, v = rng.uniform(0.05, 0.95, (2, 200))
    table = pair.family == "student"  # its quantiles come from a table
    step = 2e-3 if table else 1e-4
    slope = (pair.given(u + step, v) - pair.given(u - step, v)) / (2 * step)
    assert np.allclose(np.log(slope), pair.density(u, v), atol=2e-2 if table else 2e-3)
    assert np.allclose(pair.inverse(pair.given(u, v), v), u, atol=1e-5)
    assert np.allclose(pair.density(u, v), pair.turned_over().density(v, u))


def test_fit_finds_the_family():
    rng = np.random.default_rng(1)
    w, v = rng.random((2, 1500))
    for pair in (vine.Pair("clayton", 0, 2.0), vine.Pair("gumbel", 90, 1.8), vine.Pair("gaussian", 0, 0.7)):
        found, likelihood = vine.fit_pair(pair.inverse(w, v), v, ("gaussian", "clayton", "gumbel", "frank"))
        assert (found.family, found.turn) == (pair.family, pair.turn) and found.theta == pytest.approx(pair.theta, rel=0.15) and likelihood > 0
    assert vine.fit_pair(w, v, ("gaussian", "frank"))[0].family in ("independence", "gaussian", "frank")


def test_vine_simulates_what_it_was_fitted_on():
    rng = np.random.default_rng(2)
    cov = np.array([[1, 0.7, 0.5, 0.2], [0.7, 1, 0.6, 0.3], [0.5, 0.6, 1, 0.4], [0.2, 0.3, 0.4, 1]])
    z = rng.standard_normal((500, 4)) @ np.linalg.cholesky(cov).T
    u = (np.argsort(np.argsort(z, axis=0), axis=0) + 0.5) / len(z)
    trees, likelihood = vine.fit_vine(u, 3, ("gaussian", "frank"))
    assert [len(t) for t in trees] == [3, 2, 1] and np.sum(vine.log_density(trees, u)) == pytest.approx(likelihood, rel=1e-6)
    drawn = vine.simulate(trees, rng.random((4000, 4)))
    for i in range(4):
        for j in range(i):
            assert vine.kendall(drawn[:1500, i], drawn[:1500, j]) == pytest.approx(vine.kendall(u[:, i], u[:, j]), abs=0.07)
    kept, reason = vine.vine_or_gaussian(u[:200], 1)
    assert reason is None and len(kept) == 1


def test_student_pairs_by_likelihood():
    rng = np.random.default_rng(4)
    w, v = rng.random((2, 2500))
    pair = vine.Pair("student", 0, 0.5, 4.0)
    found, likelihood = vine.fit_pair(pair.inverse(w, v), v)
    assert found.family == "student" and found.theta == pytest.approx(0.5, abs=0.05) and 3.0 < found.df < 5.6
    u = pair.inverse(w, v)
    nearby = [vine.Pair("student", 0, found.theta + a, found.df * b) for a in (-0.02, 0, 0.02) for b in (0.85, 1, 1.2)]
    assert all(np.sum(p.density(u, v)) <= likelihood + 0.05 for p in nearby)


def test_vine_documents():
    rng = np.random.default_rng(5)
    u = rng.random((200, 4))
    trees, _ = vine.fit_vine(u, 3, ("gaussian", "clayton"))
    document = vine.to_document(trees, list("wxyz"))
    again = vine.from_document(document)
    assert again == trees and np.allclose(vine.log_density(again, u), vine.log_density(trees, u))
    matrix = vine.structure_matrix(trees, 4)
    assert sorted(np.diag(matrix).tolist()) == [0, 1, 2, 3] and (matrix >= 0).sum() == 10
