"""Lag and lead features in long form, complete windows and influence scores by residualisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spectral import gram

KEY = ["variant"]


def melt(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(variant, t, date, j, name, y): one row for each outcome of each month; j is its place in `columns`."""
    items = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(c).alias("name"), F.col(c).cast("double").alias("y")) for j, c in enumerate(columns)])
    return panel.select("variant", "t", "date", F.explode(items).alias("o")).select("variant", "t", "date", "o.j", "o.name", "o.y")


def scaled_shocks(panel: DataFrame, shock: str, control: str | None) -> DataFrame:
    """m and c: shock and control over their population standard deviation on the whole completed panel;
    a constant one is left as it is."""
    w = Window.partitionBy(*KEY)
    scale = lambda c: F.col(c) / F.coalesce(F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(1.0))
    return panel.select("variant", "t", "n", "date", scale(shock).alias("m"), (scale(control) if control else F.lit(0.0)).alias("c"))


def lags(df: DataFrame, value: str, key: list[str], lo: int, hi: int) -> DataFrame:
    """(key, t, lag, x): value at t - lag for lag in lo..hi, by an equi-join on shifted places."""
    shifted = df.select(*key, F.col(value).alias("x"), F.col("t").alias("_s"), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("lag")).withColumn("t", F.col("_s") + F.col("lag")).drop("_s")
    return df.select(*key, "t").join(shifted, [*key, "t"])


def responses(outcomes: DataFrame, horizon: int, width: int) -> DataFrame:
    """(variant, t, date, h, j, k, dy): y[t+h] - y[t-1] for h in 0..horizon, k = h * width + j."""
    w = Window.partitionBy("variant", "j").orderBy("t")
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.lead("y", h).over(w).alias("ahead")) for h in range(horizon + 1)])
    ahead = outcomes.withColumn("back", F.lag("y", 1).over(w)).withColumn("steps", steps)
    flat = ahead.select("variant", "t", "date", "j", "back", F.explode("steps").alias("s"))
    return flat.select("variant", "t", "date", "s.h", "j", (F.col("s.h") * width + F.col("j")).alias("k"), (F.col("s.ahead") - F.col("back")).alias("dy"))


def valid_places(shocks: DataFrame, outcomes: DataFrame, width: int, horizon: int, lag: int) -> DataFrame:
    """(variant, t) with L <= t < n - H, shock and control on [t-L, t], outcomes on [t-L, t+H] and their first
    differences on [t-L, t-1] all present."""
    w = Window.partitionBy("variant").orderBy("t")
    s = shocks.withColumn("sc", F.count(F.when(F.col("m").isNotNull() & F.col("c").isNotNull(), 1)).over(w.rowsBetween(-lag, 0)))
    v = Window.partitionBy("variant", "j").orderBy("t")
    o = outcomes.withColumn("d", F.col("y") - F.lag("y").over(v))
    o = o.withColumn("yc", F.count("y").over(v.rowsBetween(-lag, horizon))).withColumn("dc", F.count("d").over(v.rowsBetween(-lag, -1)))
    full = o.filter((F.col("yc") == lag + horizon + 1) & (F.col("dc") == lag)).groupBy("variant", "t").agg(F.count("*").alias("js")).filter(F.col("js") == width)
    ok = s.filter((F.col("t") >= lag) & (F.col("t") < F.col("n") - horizon) & (F.col("sc") == lag + 1))
    return ok.join(full, ["variant", "t"], "left_semi").select("variant", "t", "date")


def design(panel: DataFrame, outcomes: list[str], shock: str, control: str, horizon: int, lag: int) -> DataFrame:
    """One row per valid month: m, controls (constant, trend, control, lags of shock, control, outcomes and their first
    differences) and responses, as arrays in a fixed order."""
    sh, ys = scaled_shocks(panel, shock, control), melt(panel, outcomes)
    ok = valid_places(sh, ys, len(outcomes), horizon, lag).select("variant", "t", "date")
    w, v = Window.partitionBy("variant").orderBy("t"), Window.partitionBy("variant", "j").orderBy("t")
    own = F.array(F.lit(1.0), F.col("t").cast("double"), F.col("c"), *[F.lag(x, k).over(w) for k in range(1, lag + 1) for x in ("m", "c")])
    lagged = sh.select("variant", "t", "m", own.alias("own"))
    d = ys.withColumn("d", F.col("y") - F.lag("y").over(v))
    per = d.select("variant", "t", "j", F.array(*[F.lag(x, k).over(v) for k in range(1, lag + 1) for x in ("y", "d")]).alias("lags"))
    outs = per.groupBy("variant", "t").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "lags"))), lambda x: x["lags"])).alias("lags"))
    resp = responses(ys, horizon, len(outcomes)).groupBy("variant", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "dy"))), lambda x: x["dy"]).alias("dy"))
    return ok.join(lagged, ["variant", "t"]).join(outs, ["variant", "t"]).join(resp, ["variant", "t"]).select("variant", "t", "date", "m", F.concat("own", "lags").alias("controls"), "dy")


def _residual(y: str, x: str, w) -> Column:
    """y less its least-squares line on x, over a window."""
    slope = F.coalesce(F.covar_pop(x, y).over(w) / F.nullif(F.var_pop(x).over(w), F.lit(0.0)), F.lit(0.0))
    return F.col(y) - F.avg(y).over(w) - slope * (F.col(x) - F.avg(x).over(w))


def fwl_scores(panel: DataFrame, outcomes: list[str], shock: str, control: str, horizon: int = 3, lag: int = 2) -> DataFrame:
    """(variant, t, date, h, j, k, psi): scores m_res * y_res / mean(m_res^2) with a constant and one control partialled out."""
    sh, ys = scaled_shocks(panel, shock, control), melt(panel, outcomes)
    ok = valid_places(sh, ys, len(outcomes), horizon, lag).select("variant", "t")
    m = sh.join(ok, ["variant", "t"], "left_semi").select("variant", "t", "m", "c")
    w = Window.partitionBy("variant")
    m = m.withColumn("mr", _residual("m", "c", w)).withColumn("q", F.avg(F.col("mr") * F.col("mr")).over(w))
    r = responses(ys, horizon, len(outcomes)).join(m, ["variant", "t"])
    v = Window.partitionBy("variant", "k")
    return r.withColumn("yr", _residual("dy", "c", v)).select("variant", "t", "date", "h", "j", "k", (F.col("mr") * F.col("yr") / F.col("q")).alias("psi"))


def iv_scores(panel: DataFrame, outcomes: list[str], policy: str, instrument: str, control: str, horizon: int = 3, lag: int = 2) -> DataFrame:
    """Exactly identified scalar instrument: q = mean(z x), beta = mean(z y) / q, psi = z (y - x beta) / q, and its split
    into a reduced-form part z y / q and a first-stage part -z x beta / q, which add up to psi."""
    base = panel.select("variant", "t", "n", "date", F.col(policy).alias("m"), F.col(control).alias("c"), F.col(instrument).alias("z0"))
    ys = melt(panel, outcomes)
    ok = valid_places(base.filter("z0 IS NOT NULL"), ys, len(outcomes), horizon, lag).select("variant", "t")
    w = Window.partitionBy("variant")
    x = base.join(ok, ["variant", "t"], "left_semi").withColumn("x", _residual("m", "c", w)).withColumn("z", _residual("z0", "c", w))
    x = x.withColumn("q", F.avg(F.col("z") * F.col("x")).over(w)).select("variant", "t", "c", "x", "z", "q")
    v = Window.partitionBy("variant", "k")
    r = responses(ys, horizon, len(outcomes)).join(x, ["variant", "t"]).withColumn("yr", _residual("dy", "c", v))
    r = r.withColumn("beta", F.avg(F.col("z") * F.col("yr")).over(v) / F.col("q"))
    rf, fs = F.col("z") * F.col("yr") / F.col("q"), -F.col("z") * F.col("x") * F.col("beta") / F.col("q")
    return r.select("variant", "t", "date", "h", "j", "k", (rf + fs).alias("psi"), rf.alias("psi_rf"), fs.alias("psi_fs"))


def exposures(panel: DataFrame, outcomes: list[str], policy: str, instrument: str, control: str, horizon: int = 3, lag: int = 2) -> DataFrame:
    """(variant, t, a2): squared exposure (z / q)^2 of each scored month."""
    base = panel.select("variant", "t", "n", "date", F.col(policy).alias("m"), F.col(control).alias("c"), F.col(instrument).alias("z0"))
    ok = valid_places(base.filter("z0 IS NOT NULL"), melt(panel, outcomes), len(outcomes), horizon, lag).select("variant", "t")
    w = Window.partitionBy("variant")
    x = base.join(ok, ["variant", "t"], "left_semi").withColumn("x", _residual("m", "c", w)).withColumn("z", _residual("z0", "c", w))
    q = F.avg(F.col("z") * F.col("x")).over(w)
    return x.select("variant", "t", (F.col("z") * F.col("z") / (q * q)).alias("a2"))


def first_stage(panel: DataFrame, policy: str, instrument: str, weak: float = 10.0) -> DataFrame:
    """q, pi, R2, F, corr and the weak flag of a demeaned first stage for each variant."""
    w = Window.partitionBy("variant")
    d = panel.filter(F.col(policy).isNotNull() & F.col(instrument).isNotNull())
    d = d.select("variant", (F.col(policy) - F.avg(policy).over(w)).alias("x"), (F.col(instrument) - F.avg(instrument).over(w)).alias("z"))
    s = d.groupBy("variant").agg(F.count("*").alias("n_obs"), F.sum(F.col("z") * F.col("x")).alias("zx"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    pi = F.col("zx") / F.col("zz")
    sse = F.col("xx") - pi * F.col("zx")
    se2 = sse / (F.col("n_obs") - 1) / F.col("zz")
    f = pi * pi / se2
    return s.select("variant", "n_obs", (F.col("zx") / F.col("n_obs")).alias("q"), pi.alias("pi"), (1 - sse / F.col("xx")).alias("r2"), f.alias("f_stat"), (F.col("zx") / F.sqrt(F.col("zz") * F.col("xx"))).alias("corr"), (f < weak).alias("weak"))


def orthogonalised(df: DataFrame, value: str, control: str, least: int = 12) -> DataFrame:
    """value less its line on control; null where fewer than `least` complete rows exist."""
    w = Window.partitionBy("variant")
    both = F.col(value).isNotNull() & F.col(control).isNotNull()
    xs, ys = F.when(both, F.col(control)), F.when(both, F.col(value))
    d = df.withColumn("_x", xs).withColumn("_y", ys)
    return d.withColumn(f"{value}_orth", F.when(F.count("_y").over(w) >= least, _residual("_y", "_x", w))).drop("_x", "_y")


def state_vector(panel: DataFrame, growth: list[str], levels: list[str], changes: list[str]) -> DataFrame:
    """Predetermined states dated t-1: 12-month log growth, levels and 3-month changes, population z-scores, long form."""
    w = Window.partitionBy("variant").orderBy("t")
    at = lambda c, k: F.lag(c, k).over(w)
    items = [(f"g12_{c}", at(c, 1) - at(c, 13)) for c in growth] + [(f"lvl_{c}", at(c, 1)) for c in levels] + [(f"d3_{c}", at(c, 1) - at(c, 4)) for c in changes]
    wide = panel.select("variant", "t", "date", *[x.alias(n) for n, x in items])
    full = wide.dropna(subset=[n for n, _ in items])
    z = Window.partitionBy("variant")
    names = [n for n, _ in items]
    zs = [((F.col(n) - F.avg(n).over(z)) / F.coalesce(F.nullif(F.stddev_pop(n).over(z), F.lit(0.0)), F.lit(1.0))).alias(n) for n in names]
    return full.select("variant", "t", "date", *zs)


def roughness(scores: DataFrame) -> DataFrame:
    """Mean squared second difference over horizons, for each outcome."""
    w = Window.partitionBy("variant", "t", "j").orderBy("h")
    d2 = F.col("psi") - 2 * F.lag("psi", 1).over(w) + F.lag("psi", 2).over(w)
    return scores.withColumn("d2", d2).groupBy("variant", "j").agg(F.avg(F.col("d2") * F.col("d2")).alias("roughness"))


def block_traces(scores: DataFrame, width: int) -> DataFrame:
    """Each outcome's share of total variance and the weight that equalises the traces of the outcomes' blocks."""
    var = scores.groupBy("variant", "j", "k").agg(F.var_pop("psi").alias("v"))
    tr = var.groupBy("variant", "j").agg(F.sum("v").alias("trace"))
    w = Window.partitionBy("variant")
    return tr.select("variant", "j", "trace", (F.col("trace") / F.sum("trace").over(w)).alias("share"), F.sqrt(F.sum("trace").over(w) / width / F.col("trace")).alias("weight"))


def sufficient_stats(scores: DataFrame, draws: DataFrame) -> DataFrame:
    """Sums over each draw's places of the score of every coordinate, counts and squares: rows resampled, not refitted."""
    counts = draws.groupBy("draw", "t").agg(F.count("*").alias("c"))
    return scores.join(counts, "t").groupBy("variant", "draw", "k").agg(F.sum("c").alias("n_rows"), F.sum(F.col("c") * F.col("psi")).alias("s1"), F.sum(F.col("c") * F.col("psi") * F.col("psi")).alias("s2"))


def partialled(rows: DataFrame, controls: int) -> DataFrame:
    """rows(block, .., b array) with r, the residuals of b's columns from number `controls` on, on those before, for any
    number of rows. The first control is a constant, so the others may be taken from their means first. Tasks sum up
    the products of the columns; a block's normal equations, whose size is that of b, are solved in a task after
    scaling, and their coefficients join the rows again. Columns that depend on others count once."""
    means = rows.select("block", F.posexplode("b").alias("at", "x")).groupBy("block", "at").agg(F.avg("x").alias("x"))
    means = means.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("at") > 0, F.col("x")).otherwise(0.0).alias("x")))).alias("mean"))
    rows = rows.join(means, "block").withColumn("b", F.zip_with("b", "mean", lambda x, m: x - m["x"])).drop("mean")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(round(len(pdf) ** 0.5))
        g = np.zeros(n * n)
        g[pdf["at"].to_numpy()] = pdf["g"].to_numpy()
        g = g.reshape(n, n)
        scale = np.sqrt(np.maximum(np.diag(g)[:controls], 1e-300))
        a = g[:controls, :controls] / scale[:, None] / scale[None]
        coef = np.linalg.lstsq(a, g[:controls, controls:] / scale[:, None], rcond=1e-12)[0] / scale[:, None]
        return pd.DataFrame({"block": [key[0]], "coef": [coef.T.tolist()]})

    kind = rows.schema["block"].dataType.simpleString()
    coef = gram(rows).groupBy("block").applyInPandas(solve, f"block {kind}, coef array<array<double>>")
    fitted = lambda c: F.aggregate(F.zip_with(c, F.slice("b", 1, controls), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rest = F.slice("b", controls + 1, F.size("b"))
    return rows.join(coef, "block").withColumn("r", F.zip_with(rest, F.transform("coef", fitted), lambda y, f: y - f)).drop("coef")


def control_set(outcomes: list[str], policy: str, control: str, lag: int, over) -> list[Column]:
    """The full set: a constant, time, the control and its lags, lags of the policy, of the outcomes and their changes.
    Time is counted in hundreds of months."""
    back = lambda c, n: F.lag(c, n).over(over)
    lags = range(1, lag + 1)
    own = [F.lit(1.0), F.col("t") / 100.0, F.col(control), *[back(c, n) for c in (policy, control) for n in lags]]
    return own + [x for n in lags for c in outcomes for x in (back(c, n), back(c, n) - back(c, n + 1))]


def iv_scores_on(panel: DataFrame, outcomes: list[str], policy: str, instrument: str, controls: list[Column], over, horizon: int = 3) -> DataFrame:
    """`iv_scores` with any set of controls, columns over the panel and the window `over` of its rows: policy, instrument and
    all responses are residuals on all of them, from rows where nothing is missing."""
    ahead = [F.lead(c, h).over(over) - F.lag(c, 1).over(over) for h in range(horizon + 1) for c in outcomes]
    b = F.array(*[x.cast("double") for x in (*controls, F.col(policy), F.col(instrument), *ahead)])
    rows = panel.select(F.col("variant").alias("block"), "t", "date", b.alias("b")).filter(F.forall("b", lambda x: x.isNotNull()))
    left = partialled(rows, len(controls))
    width = len(outcomes)
    x, z = F.col("r")[0], F.col("r")[1]
    long = left.select(F.col("block").alias("variant"), "t", "date", x.alias("x"), z.alias("z"), F.posexplode(F.slice("r", 3, F.size("r"))).alias("k", "yr"))
    means = long.groupBy("variant", "k").agg(F.avg(F.col("z") * F.col("x")).alias("q"), F.avg(F.col("z") * F.col("yr")).alias("zy"))
    long = long.join(means, ["variant", "k"])
    rf, fs = F.col("z") * F.col("yr") / F.col("q"), -F.col("z") * F.col("x") * F.col("zy") / (F.col("q") * F.col("q"))
    h, j = F.floor(F.col("k") / width).cast("int"), F.pmod("k", F.lit(width)).cast("int")
    return long.select("variant", "t", "date", h.alias("h"), j.alias("j"), "k", (rf + fs).alias("psi"), rf.alias("psi_rf"), fs.alias("psi_fs"))
