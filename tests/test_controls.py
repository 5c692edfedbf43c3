"""Partialling out by distributed normal equations against least squares."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import scores


def residual(y, x):
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


def test_partialled_equals_least_squares(spark):
    rng = np.random.default_rng(8)
    x = {b: np.c_[np.ones(200), 500 + np.cumsum(rng.normal(size=(200, 4)), axis=0)] for b in ("a", "b")}
    for b in x:
        x[b] = np.c_[x[b], x[b][:, 1] - x[b][:, 2]]  # depends on the others
    y = {b: rng.normal(size=(200, 3)) * 50 + 1000 for b in x}
    rows = [(b, t, np.r_[x[b][t], y[b][t]].tolist()) for b in x for t in range(200)]
    got = scores.partialled(spark.createDataFrame(rows, "block string, t long, b array<double>").repartition(5), 6).collect()
    for b in x:
        r = np.array([g.r for g in sorted(got, key=lambda g: g.t) if g.block == b])
        assert np.allclose(r, residual(y[b], x[b][:, :5]), atol=1e-6)


def test_scores_on_the_full_set(spark):
    rng = np.random.default_rng(2)
    n, lag, horizon = 90, 2, 2
    data = {c: rng.normal(size=n).cumsum() for c in ("u", "w")} | {c: rng.normal(size=n) for c in ("shock", "control", "iv")}
    names = list(data)
    df = spark.createDataFrame([("v", t, f"2000-{t}", *[float(data[c][t]) for c in names]) for t in range(n)], f"variant string, t long, date string, {', '.join(f'{c} double' for c in names)}")
    over = Window.partitionBy("variant").orderBy("t")
    got = scores.iv_scores_on(df, ["u", "w"], "shock", "iv", scores.control_set(["u", "w"], "shock", "control", lag, over), over, horizon).toPandas()
    ts = np.arange(lag + 1, n - horizon)
    level = np.c_[data["u"], data["w"]]
    cols = [np.ones(len(ts)), ts, data["control"][ts]]
    for k in range(1, lag + 1):
        cols += [data["shock"][ts - k], data["control"][ts - k], level[ts - k, 0], level[ts - k, 1], (level[ts - k] - level[ts - k - 1])[:, 0], (level[ts - k] - level[ts - k - 1])[:, 1]]
    c = np.c_[tuple(cols)]
    x, z = residual(data["shock"][ts], c), residual(data["iv"][ts], c)
    y = residual(np.hstack([level[ts + h] - level[ts - 1] for h in range(horizon + 1)]), c)
    q = (z * x).mean()
    want = z[:, None] * (y - x[:, None] * (z @ y / len(ts) / q)) / q
    table = got.pivot(index="t", columns="k", values="psi").loc[ts].to_numpy()
    assert np.allclose(table, want, rtol=1e-6, atol=1e-6)
    assert np.allclose(got["psi"], got["psi_rf"] + got["psi_fs"])


def test_one_control_equals_the_simple_scores(spark):
    rng = np.random.default_rng(5)
    n = 60
    rows = [["v", t, n, f"d{t}", *map(float, rng.normal(size=5))] for t in range(n)]
    rows[0][7] = None  # the first place has no value before it: neither form scores it
    df = spark.createDataFrame(rows, "variant string, t int, n int, date string, a double, b double, shock double, control double, iv double")
    over = Window.partitionBy("variant").orderBy("t")
    simple = scores.iv_scores(df, ["a", "b"], "shock", "iv", "control", 1, 0).toPandas().set_index(["t", "k"])
    both = scores.iv_scores_on(df, ["a", "b"], "shock", "iv", [F.lit(1.0), F.col("control")], over, 1).toPandas().set_index(["t", "k"])
    assert len(simple) == len(both) == 58 * 4
    assert np.allclose(simple["psi"], both.loc[simple.index, "psi"], atol=1e-7)
