"""The pivot search against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import knn


def brute(rows, k):
    out = set()
    for b in {r[0] for r in rows}:
        own = [(i, np.array(v)) for blk, i, v in rows if blk == b]
        for i, v in own:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in own if j != i)[:k]
            out |= {(b, i, j, round(d, 9), n + 1) for n, (d, j) in enumerate(near)}
    return out


def clustered(rng, n, centres, spread=0.02, dims=6):
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    rows = [("flat", i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 5)))]
    rows += [("groups", i, v.tolist()) for i, v in enumerate(clustered(rng, 260, 9))]
    rows += [("copies", i, [float(i % 3), 0.0]) for i in range(60)] + [("copies", 100 + i, [5.0 + i, 1.0]) for i in range(5)]
    rows += [("grid", 10 * a + b, [float(a), float(b)]) for a in range(10) for b in range(10)]  # ties
    rows += [("two", 1, [0.0]), ("two", 2, [1.0]), ("one", 1, [0.0])]
    return rows


@pytest.mark.parametrize("k, cell", [(4, None), (4, 6), (7, 25), (12, 3)])
def test_equals_all_pairs(spark, vectors, k, cell):
    df = spark.createDataFrame(vectors, "block string, id long, v array<double>").repartition(4)
    got = {(r.block, r.i, r.j, round(r.d, 9), r["rank"]) for r in knn.knn_edges(df, k, cell).collect()}
    assert got == brute(vectors, k)


def test_most_pairs_are_never_compared(spark):
    rng = np.random.default_rng(5)
    n = 6000
    rows = [("hot", i, v.tolist()) for i, v in enumerate(clustered(rng, n, 60))]
    df = spark.createDataFrame(rows, "block string, id long, v array<double>").repartition(4)
    found = knn.search(df, 8)
    pairs = found.near.count() + found.far.count()
    assert pairs < 0.1 * n * n, pairs / n**2
    assert found.top.count() == 9 * n


def test_copies_cost_no_pairs(spark):
    df = spark.range(3000).select(F.lit("b").alias("block"), "id", F.array((F.col("id") % 4).cast("double")).alias("v"))
    found = knn.search(df, 5)
    assert found.near.count() <= 16 and knn.knn_edges(df, 5).count() == 15_000


@pytest.mark.parametrize("tile", [8, 40])
def test_cells_and_visitors_in_many_tiles(spark, vectors, tile):
    """Cells larger than a tile fall into several, and visitors of a tile into several crowds; far from the origin
    the products' rounding must not decide."""
    rows = vectors + [("away", i, [1e6 + x, 1e6]) for i, x in enumerate(np.random.default_rng(3).normal(size=70).tolist())] + [("away", 99, None)]
    df = spark.createDataFrame(rows, "block string, id long, v array<double>").repartition(4)
    got = {(r.block, r.i, r.j, round(r.d, 9), r["rank"]) for r in knn.knn_edges(df, 5, 20, tile).collect()}
    assert got == brute(rows[:-1], 5)
