"""The relational eigensolver against dense ones."""

import numpy as np
import pytest

from strandline.operators import graph, spectral


def dense(rows):
    out = {}
    for b in {r.block for r in rows}:
        own = [r for r in rows if r.block == b]
        ids = sorted({r.i for r in own})
        at = {x: n for n, x in enumerate(ids)}
        a = np.zeros((len(ids),) * 2)
        for r in own:
            a[at[r.i], at[r.j]] = r.a
        root = 1 / np.sqrt(a.sum(axis=1))
        values, v = np.linalg.eigh(np.eye(len(ids)) - a * root[:, None] * root)
        out[b] = (ids, values, v, root)
    return out


@pytest.fixture(scope="module")
def affinity(spark):
    rng = np.random.default_rng(4)
    rows = [("ring", i, [float(np.cos(i / 11)), float(np.sin(i / 11)), 0.01 * float(rng.normal())]) for i in range(40)]
    rows += [("cloud", i, rng.normal(size=3).tolist()) for i in range(110)]
    rows += [("small", i, [float(i * i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "block string, id long, v array<double>")
    return graph.density_normalised(graph.affinities(graph.knn_edges(df, 6), 3), 0.5).select("block", "i", "j", "a")


def test_equals_the_dense_spectrum(affinity):
    got = spectral.laplacian_eigen(affinity, 5).toPandas()
    for block, (ids, values, v, root) in dense(affinity.collect()).items():
        own = got[got["block"] == block]
        assert np.allclose(own.groupby("l")["value"].first().sort_index(), values[:5], atol=1e-8)
        phi = own.pivot(index="i", columns="l", values="phi").loc[ids].to_numpy()
        assert np.allclose((phi**2).mean(axis=0), 1) and np.allclose(phi[:, 0], 1)
        # spans agree where the next eigenvalue is apart
        x = phi / root[:, None]
        x /= np.linalg.norm(x, axis=0)
        for m in range(1, 6):
            if m < len(ids) and values[m] - values[m - 1] > 1e-2 and m <= x.shape[1]:
                gap = v[:, :m] - x[:, :m] @ (x[:, :m].T @ v[:, :m])
                assert np.abs(gap).max() < 1e-4


def test_more_cycles_where_values_are_close(spark):
    """A path of 40 places from bases of 24 columns: its largest eigenvalues differ by a hundredth."""
    n = 40
    rows = [("p", i, j, 0.5) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    edges = spark.createDataFrame(rows, "block string, i long, j long, a double")
    rng = np.random.default_rng(1)
    start = spark.createDataFrame([("p", i, rng.normal(size=6).tolist()) for i in range(n)], "block string, i long, x array<double>")
    x, values = spectral.leading(edges, start, 3, 6, steps=4)
    want = np.cos(np.arange(1, 4) * np.pi / (n + 1))
    assert np.allclose(values.first()["values"][:3], want, atol=1e-8)
    m = np.array([r.x for r in x.orderBy("i").collect()])
    assert np.allclose(m.T @ m, np.eye(6), atol=1e-6)


def test_empty(spark):
    none = spark.createDataFrame([], "block string, i long, j long, a double")
    assert spectral.laplacian_eigen(none, 3).count() == 0


def test_pieces_exchange_their_rows(spark):
    """A ring in pieces of about seven rows; an edge without its counterpart raises."""
    n = 40
    rows = [("p", i, (i + d) % n, 0.5) for i in range(n) for d in (-1, 1)]
    start = spark.createDataFrame([("p", i, np.random.default_rng(i).normal(size=6).tolist()) for i in range(n)], "block string, i long, x array<double>")
    edges = spark.createDataFrame(rows, "block string, i long, j long, a double")
    x, values = spectral.leading(edges, start, 3, 6, steps=6, size=7)
    assert np.allclose(values.first()["values"][:3], [1, np.cos(2 * np.pi / n), np.cos(2 * np.pi / n)], atol=1e-8)
    m = np.array([r.x for r in x.orderBy("i").collect()])[:, :3]
    a = np.zeros((n, n))
    for _, i, j, w in rows:
        a[i, j] = w
    assert np.allclose(a @ m, m * values.first()["values"][:3], atol=1e-5)
    lone = spark.createDataFrame([r for r in rows if r[1] % 3 or r[2] < r[1]], "block string, i long, j long, a double")
    with pytest.raises(Exception, match="not symmetric"):
        spectral.leading(lone, start, 3, 6, steps=3, size=7)


def test_settings_are_solved_together(spark, sf, monkeypatch):
    """The grid of graph_search is one eigenproblem of more blocks, not one after another."""
    from strandline.plans import registry

    seen = []

    class Enough(Exception):
        pass

    def solve(aff, count):
        seen.extend(r.block for r in aff.select("block").distinct().collect())
        raise Enough

    monkeypatch.setattr(graph, "laplacian_eigen", solve)
    with pytest.raises(Enough):
        registry.queries()["graph_search"](spark, sf)
    assert {str(b).split(":")[0] for b in seen} == {f"k={k},alpha={a}" for k in (6, 10) for a in ("0", "0.5")}
