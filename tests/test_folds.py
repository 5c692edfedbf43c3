"""Complements of folds as differences of sums, against training sets made by filters."""

import numpy as np

from strandline.operators import filters, graph


def test_moments_without_a_fold(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.integers(0, 4)), float(1e6 + rng.normal())) for k in ("a", "b") for _ in range(200)] + [("one", 0, 5.0)]
    got = filters.fold_moments(spark.createDataFrame(rows, "k string, fold int, x double"), "x", ["k"]).collect()
    assert len(got) == 9
    for r in got:
        train = np.array([x for k, f, x in rows if k == r.k and f != r.fold])
        test = np.array([x for k, f, x in rows if k == r.k and f == r.fold])
        assert (r.n_test, r.n_train) == (len(test), len(train)) and np.isclose(r.mean_test, test.mean(), rtol=1e-12)
        if len(train):
            assert np.isclose(r.mean_train, train.mean(), rtol=1e-12) and np.isclose(r.var_train, train.var(), rtol=1e-6)
        else:
            assert r.mean_train is None and r.var_train is None


def test_ridge_grid_equals_fitting_each_training_set(spark):
    rng = np.random.default_rng(3)
    n, m, folds, lambdas = 37, 4, 5, [0.05, 1.0]
    phi, y, values = np.c_[np.ones(n), rng.normal(size=(n, m - 1))], rng.normal(size=n), np.array([0, 0.1, 0.4, 0.9])
    eigen = spark.createDataFrame([("b:1", l, float(values[l]), i, float(phi[i, l])) for l in range(m) for i in range(n)], "block string, l int, value double, i long, phi double")
    targets = spark.createDataFrame([("b:1", i, float(y[i])) for i in range(n)], "block string, i long, y double")
    got = {r.lam: r for r in graph.ridge_grid(eigen, targets, lambdas, folds).collect()}
    fold = np.arange(n) * folds // n
    for lam in lambdas:
        add, err = lam * n * np.diag(values), 0.0
        for f in range(folds):
            a, b = fold != f, fold == f
            err += ((y[b] - phi[b] @ np.linalg.solve(phi[a].T @ phi[a] + add, phi[a].T @ y[a])) ** 2).sum()
        edf = np.trace(np.linalg.solve(phi.T @ phi + add, phi.T @ phi))
        assert np.isclose(got[lam].cv_error, err / n) and np.isclose(got[lam].edf, edf) and got[lam].block == "b:1"
