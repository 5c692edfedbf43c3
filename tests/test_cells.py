"""Cell covariances against numpy."""

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import cells
from strandline.plans.cells import _cells


def test_smoothing_ridge_and_balance(spark):
    rng = np.random.default_rng(7)
    p, years, obs = 3, range(2000, 2006), {}
    for region, sizes in (("a", [9, 0, 30, 4, 0, 12]), (None, [0, 0, 0, 2, 0, 0]), ("far", [50] + [0] * 5)):
        for y, n in zip(years, sizes):
            if n:
                obs[region, y] = rng.normal(size=(n, p)) @ rng.normal(size=(p, p))
    rows = [(r, y, len(x), i, j, float((x.T @ x)[i, j])) for (r, y), x in obs.items() for i in range(p) for j in range(p)]
    df = spark.createDataFrame(rows, "region string, year int, n long, i int, j int, cross double")
    out = cells.smoothed_covariances(df, 0.02, 0.1, 10.0)
    got = out.toPandas()
    whole = np.vstack(list(obs.values()))
    c = whole.T @ whole / len(whole)
    assert len(got) == 3 * 6 * p * p
    for (region, year), own in got.groupby(["region", "year"]):
        x = obs.get((None if region == "Unknown" else region, year))
        k = own.pivot(index="i", columns="j", values="cov").to_numpy()
        first = own.iloc[0]
        if x is None:
            assert first.status in ("identity_fallback", "sparse_blended") and first.rho >= 0.1
            if first.status == "identity_fallback":
                assert np.allclose(k, c)
            continue
        rho = min(0.7, 0.1 + 0.35 * max(0, 10 - len(x)) / 10)
        assert np.allclose(first.rho, rho) and first.status == ("smoothed" if len(x) >= 10 else "sparse_blended")
        assert np.allclose(k, (1 - rho) * x.T @ x / len(x) + rho * c)
    even = cells.balanced(out, cells.pooled(df)).groupBy("i", "j").agg(F.avg("cov").alias("m")).toPandas()
    assert np.allclose(even.pivot(index="i", columns="j", values="m").to_numpy(), c)


def test_no_cells(spark):
    none = spark.createDataFrame([], "region string, year int, n long, i int, j int, cross double")
    assert cells.smoothed_covariances(none, 1.0, 0.1, 10.0).count() == 0


def test_cells_are_centred(spark, sf):
    total = _cells(spark, sf).groupBy("i", "j").agg((F.sum("cross") / F.sum("n")).alias("c")).toPandas().pivot(index="i", columns="j", values="c").to_numpy()
    assert np.allclose(total, total.T) and np.all(np.linalg.eigvalsh(total) > 0)
