"""Scans over chunks against plain recursions, on series of many chunks."""

import numpy as np
import pytest

from strandline.operators import filters, kernels, ranks, scans


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [(k, t, float(rng.normal())) for k in ("a", "b") for t in range(-40, 160)]
    rows += [("gaps", int(t), float(rng.normal())) for t in np.cumsum(rng.integers(1, 30, 60))] + [("one", 5, 2.0), ("null", 1, None), ("null", 2, 1.0)]
    return rows, spark.createDataFrame(rows, "k string, t long, x double").repartition(4)


@pytest.mark.parametrize("half_life", [0.5, 2.0, 40.0])
def test_decayed_sums(series, half_life):
    rows, df = series
    got = {(r.k, r.t): r.filtered for r in scans.decayed(df, "x", ["k"], half_life).collect()}
    assert len(got) == len(rows)
    state, last = {}, {}
    for k, t, x in sorted(rows, key=lambda r: r[:2]):
        state[k] = state.get(k, 0.0) * 0.5 ** ((t - last.get(k, t)) / half_life) + (x or 0.0)
        last[k] = t
        assert abs(got[k, t] - state[k]) < 1e-12 * max(1, abs(state[k])) * 100, (k, t)


def test_previous_row_over_chunks(series):
    rows, df = series
    got = {(r.k, r.t): r.before for r in scans.previous(df, "x", ["k"], "before", length=7).collect()}
    last = {}
    for k, t, x in sorted(rows, key=lambda r: r[:2]):
        assert got[k, t] == last.get(k)
        last[k] = x


def test_covariance_follows_the_recursion_and_never_looks_ahead(spark):
    rng = np.random.default_rng(9)
    y, start, lm, lc = rng.normal(size=(150, 3)), 30, 0.5 ** (1 / 4), 0.5 ** (1 / 0.7)
    run = lambda y: {(r.t, r.i, r.j): (r.before, r.after) for r in scans.ewma_covariance(spark.createDataFrame([(t, k, float(y[t, k])) for t in range(len(y)) for k in range(3)], "t long, k int, x double"), "x", [], 4.0, 0.7, start).collect()}
    got, m, e = run(y), np.zeros(3), []
    for row in y:
        e.append(row - m)
        m = lm * m + (1 - lm) * row
    e = np.array(e)
    k = e[:start].T @ e[:start] / start
    for t in range(start, len(y)):
        after = lc * k + (1 - lc) * np.outer(e[t], e[t])
        for i in range(3):
            for j in range(i, 3):
                assert np.allclose(got[t, i, j], (k[i, j], after[i, j]), atol=1e-10)
        k = after
    changed = y.copy()
    changed[100:] += 7
    other = run(changed)
    assert all(np.allclose(got[key][0], other[key][0], atol=1e-9) for key in got if key[0] <= 100)


def test_signature_equals_its_recursion(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 2))
    df = spark.createDataFrame([("p", t, k, float(x[t, k])) for t in range(90) for k in range(2)], "v string, t long, k int, x double")
    got = {(r.t, r.level, r.i, r.j, r.l): r.filtered for r in scans.signature(df, "x", ["v"], [1.0]).collect()}
    a, s1, s2, s3 = 0.5, np.zeros(2), np.zeros((2, 2)), np.zeros((2, 2, 2))
    for t in range(90):
        s3 = a * (s3 + np.einsum("ij,k->ijk", s2, x[t]))
        s2 = a * (s2 + np.outer(s1, x[t]))
        s1 = a * s1 + x[t]
        assert np.allclose([got[t, 1, i, None, None] for i in range(2)], s1)
        assert np.allclose([[got[t, 2, i, j, None] for j in range(2)] for i in range(2)], s2)
        assert np.allclose([[[got[t, 3, i, j, k] for k in range(2)] for j in range(2)] for i in range(2)], s3)
    z = kernels.volterra_features(x, (1.0,), 3)
    last = np.r_[s1, s2.ravel(), s3.ravel()]
    raw = np.array([[got[t, 1, i, None, None] for i in range(2)] for t in range(90)])
    assert np.allclose(z[-1, :2], (last[:2] - raw.mean(axis=0)) / raw.std(axis=0))


def test_ranks_of_one_key_with_ties_equal_the_window(spark):
    rng = np.random.default_rng(6)
    x = [None if v == 7 else float(v) for v in rng.integers(0, 40, 500)]
    df = spark.createDataFrame([(("k", None)[i % 2], i, v) for i, v in enumerate(x)], "key string, id long, x double").repartition(5)
    got = {r.id: r.avg_rank for r in ranks.average_rank(df, "x", ["key"]).collect()}
    for odd in (0, 1):
        own = [(v is not None, v or 0.0) for v in x[odd::2]]
        for i, v in zip(range(odd, 500, 2), own):
            less, same = sum(w < v for w in own), sum(w == v for w in own)
            assert got[i] == less + (same + 1) / 2
    places = sorted(r.place for r in ranks.placed(df, [], ["x", "id"]).collect())
    assert places == list(range(500))
    assert filters.average_rank is ranks.average_rank
