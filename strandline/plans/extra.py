"""Weighted covariances, comparisons against a base, candidate filters, resampled sums and whole-model checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compare, graph, kernels, moments, resample, scores
from ..session import settled, table
from .base import panel, psi, query, r, sql, weights
from .dense import design, vectors
from .paths import _D, _SP, BLOCK, DRAWS, _diag_spectrum

WIDTHS = [2.0, 3.0, 6.0]

_WS = {
    "wn": f"SELECT unnest([{', '.join(map(str, WIDTHS))}])::DOUBLE AS width",
    "wa": "SELECT width, s, t, r / sum(r) OVER (PARTITION BY width, s) AS w FROM (SELECT width, a.t AS s, b.t AS t, exp(-(a.t-b.t)*(a.t-b.t)/(2*width*width)) AS r FROM places a, places b, wn)",
    "pa": "SELECT width, s, sum(w*q) AS x FROM wa JOIN q USING (t) GROUP BY width, s",
    "ra": "SELECT *, row_number() OVER (PARTITION BY width ORDER BY x DESC, s) AS rk FROM pa",
}


def _paths(p):
    """(variant, t, x): the diagonal path under each width of the time kernel."""
    places = moments.months(p)
    parts = [moments.diag_tau(p, moments.kernel(places, "gaussian", width)).select(F.lit(f"width {width:g}").alias("variant"), F.col("s").alias("t"), F.col("tau").alias("x")) for width in WIDTHS]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return settled(out)


@query(sql(f"SELECT s, a.k AS i, b.k AS j, {r('(sum(w*a.psi*b.psi) - sum(w*a.psi)*sum(w*b.psi)) / sqrt(any_value(ca.c_kk)*any_value(cb.c_kk))', 'cov')} FROM psi a JOIN psi b ON b.t = a.t AND b.k >= a.k JOIN w ON w.t = a.t JOIN cd ca ON ca.k = a.k JOIN cd cb ON cb.k = b.k GROUP BY s, a.k, b.k"))
def weighted_covariance(spark, sf):
    """Covariances of the scores about their weighted means, over the reference's standard deviations."""
    p = psi(spark, sf)
    c = p.groupBy("variant", "k").agg(F.avg(F.col("psi") * F.col("psi")).alias("c"))
    scaled = p.join(c, ["variant", "k"]).withColumn("psi", F.col("psi") / F.sqrt("c"))
    return moments.weighted_covariance(scaled, weights(p)).drop("variant")


@query(sql(f"SELECT k AS basis, {r('corr(xa, xb)', 'corr')}, {r('sqrt(avg((xa-xb)*(xa-xb)))', 'rmse')}, {r('stddev_samp(xa)', 'sd_a')}, {r('stddev_samp(xb)', 'sd_b')} FROM (SELECT k, s, sum(CASE WHEN width = 3 THEN wa.w*psi*psi/c_kk END) AS xa, sum(CASE WHEN width = 6 THEN wa.w*psi*psi/c_kk END) AS xb FROM psi JOIN cd USING (k) JOIN wa USING (t) GROUP BY k, s) GROUP BY k", **_WS))
def basis_comparison(spark, sf):
    """Every coordinate's amplitude path under two widths of the time kernel."""
    p = psi(spark, sf)
    places = moments.months(p)
    amp = lambda width: moments.diagonals(p, moments.kernel(places, "gaussian", width)).select("variant", F.col("k").alias("basis"), F.col("s").alias("t"), (F.col("k_kk") / F.col("c_kk")).alias("x"))
    return compare.basis_comparison(amp(3.0), amp(6.0), ["variant"]).drop("variant")


@query(sql(f"SELECT 'width ' || a.width::INT AS variant, {r('corr(a.x, b.x)', 'corr')}, {r('sqrt(avg((a.x-b.x)*(a.x-b.x)))', 'rmse')}, {r('max(a.x)', 'largest')}, max(CASE WHEN a.rk = 1 THEN a.s END) AS place, count(CASE WHEN a.rk <= 5 AND b.rk <= 5 THEN 1 END) AS shared_top FROM ra a JOIN ra b ON b.s = a.s AND b.width = 3 GROUP BY a.width", **_WS))
def metrics_against_base(spark, sf):
    return compare.against_base(_paths(psi(spark, sf)), "width 3", 5)


@query(sql(f"SELECT 'width ' || a.width::INT AS variant, a.rk AS rank, a.s AS t, {r('a.x', 'x')}, b.rk <= 5 AS in_base, b.rk AS base_rank FROM ra a JOIN ra b ON b.s = a.s AND b.width = 3 WHERE a.rk <= 5 AND a.width <> 3", **_WS))
def top_months_with_base_rank(spark, sf):
    """Five largest months of every path, whether they are among the base's five and which rank the base gives them."""
    paths = _paths(psi(spark, sf))
    base = compare.top(paths.filter("variant = 'width 3'"), "x", ["variant"], 1 << 30).select("t", F.col("rank").alias("base_rank"))
    five = compare.top(paths.filter("variant <> 'width 3'"), "x", ["variant"], 5)
    return five.join(base, "t").select("variant", "rank", "t", "x", (F.col("base_rank") <= 5).alias("in_base"), "base_rank")


_CA = {
    "cw": "SELECT unnest(range(1, 9))::DOUBLE AS width",
    "ck": "SELECT width, s, t, r / sum(r) OVER (PARTITION BY width, s) AS w FROM (SELECT width, a.t AS s, b.t AS t, exp(-(a.t-b.t)*(a.t-b.t)/(2*width*width)) AS r FROM places a, places b, cw)",
    "cs": "SELECT width, min(ess) AS min_ess, max(hi) AS max_w FROM (SELECT width, s, 1/sum(w*w) AS ess, max(w) AS hi FROM ck GROUP BY width, s) GROUP BY width",
    "cl": "SELECT width, avg(pow(q - x, 2)) AS loss FROM (SELECT width, s, sum(w*q)/sum(w) AS x FROM ck JOIN q USING (t) WHERE s <> t GROUP BY width, s) l JOIN q ON q.t = l.s GROUP BY width",
}


@query(sql(f"SELECT width AS candidate, {r('min_ess')}, {r('max_w')}, {r('loss')}, row_number() OVER (ORDER BY loss, width) = 1 AS chosen FROM cs JOIN cl USING (width) WHERE min_ess >= 4 AND max_w <= 0.3", **_CA))
def admissible_candidates(spark, sf):
    """Kernel widths whose weights are spread enough, with their leave-one-out loss; the lowest is chosen."""
    p = psi(spark, sf)
    places = moments.months(p)
    c = p.groupBy("variant", "k").agg(F.avg(F.col("psi") * F.col("psi")).alias("c_kk"))
    q = settled(p.join(c, ["variant", "k"]).groupBy("variant", "t").agg(F.avg(F.col("psi") * F.col("psi") / F.col("c_kk")).alias("q")))
    grid = spark.createDataFrame([(float(x),) for x in range(1, 9)], "candidate double")
    d = F.col("s") - F.col("t")
    raw = places.select(F.col("t").alias("s")).join(places.select("t")).join(grid).withColumn("r", F.exp(-d * d / (2 * F.col("candidate") * F.col("candidate"))))
    w = settled(raw.select("candidate", "s", "t", (F.col("r") / F.sum("r").over(Window.partitionBy("candidate", "s"))).alias("w")))
    spread = w.groupBy("candidate", "s").agg((1 / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.max("w").alias("hi")).groupBy("candidate").agg(F.min("ess").alias("min_ess"), F.max("hi").alias("max_w"))
    left_out = w.filter("s <> t").join(q.select("t", "q"), "t").groupBy("candidate", "s").agg((F.sum(F.col("w") * F.col("q")) / F.sum("w")).alias("x"))
    loss = left_out.join(q.select(F.col("t").alias("s"), "q"), "s").groupBy("candidate").agg(F.avg((F.col("q") - F.col("x")) * (F.col("q") - F.col("x"))).alias("loss"))
    return compare.admissible(spread.join(loss, "candidate"), 4.0, 0.3, "loss")


@query(f"""
WITH s AS (SELECT r_name AS variant, c_mktsegment AS label, count(*) AS n, avg(c_acctbal) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
d AS (SELECT r_name AS variant, c_mktsegment AS label, count(*) AS n_below, min(c_acctbal) AS lowest FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < -900 GROUP BY 1, 2)
SELECT s.variant, s.label, n, {r('mean', digits=4)}, coalesce(n_below, 0) AS n_below, {r('lowest', digits=4)} FROM s LEFT JOIN d ON d.variant = s.variant AND d.label = s.label
""", digits=4)
def summary_with_diagnostics(spark, sf):
    """A summary by (variant, label) with diagnostics that some rows lack."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("label"), "c_acctbal")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    rows = c.join(n, "n_nationkey").join(table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("variant")), "r_regionkey")
    low = F.col("c_acctbal") < -900
    summary = rows.groupBy("variant", "label").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))
    diagnostics = rows.filter(low).groupBy("variant", "label").agg(F.count("*").alias("n_below"), F.min("c_acctbal").alias("lowest"))
    return summary.join(diagnostics, ["variant", "label"], "left").na.fill(0, ["n_below"])


@query(sql(f"SELECT c.s, {r('stress')}, coalesce(d.n_high, 0) AS n_high, {r('high_sum')} FROM (SELECT s, sum(q*a/(1+a)) AS stress FROM (SELECT s, q, a / sum(q*a) OVER (PARTITION BY s) AS a FROM sp) GROUP BY s) c LEFT JOIN (SELECT s, count(*) AS n_high, sum(a) AS high_sum FROM sp WHERE a >= 2 GROUP BY s) d USING (s)", **_SP))
def curves_with_spectrum(spark, sf):
    """The stress curve at one with the part of the spectrum above two, which quiet months lack."""
    sp = settled(_diag_spectrum(spark, sf))
    high = sp.filter("a >= 2").groupBy("variant", "s").agg(F.count("*").alias("n_high"), F.sum("a").alias("high_sum"))
    return graph.stress_curve(sp, [1.0], True).select("variant", "s", "stress").join(high, ["variant", "s"], "left").na.fill(0, ["n_high"]).drop("variant")


@query(sql(f"SELECT draw, sum(o)::BIGINT AS n_rows, {r('sum(o*c)', 'x', 4)}, {r('sum(o*c*c)', 'xx', 4)}, {r('sum(o*m)', 'y', 4)}, {r('sum(o*c*m)', 'xy', 4)} FROM (SELECT draw, t, count(*) AS o FROM boot GROUP BY draw, t) b JOIN mv ON mv.t = b.t + (SELECT min(t) FROM places) GROUP BY draw", **_D), digits=4)
def draw_cross_products(spark, sf):
    """Per draw the sums of x x' and x y' of a regression of the shock on a constant and the control."""
    sh = scores.scaled_shocks(panel(spark, sf), "shock", "control")
    places = moments.months(psi(spark, sf))
    lo = places.groupBy("variant").agg(F.min("t").alias("lo"))
    rows = settled(sh.join(places.select("variant", "t"), ["variant", "t"], "left_semi").join(lo, "variant").select((F.col("t") - F.col("lo")).alias("t"), "m", "c"))
    often = resample.arithmetic_blocks(spark, rows.count(), BLOCK, DRAWS).groupBy("draw", "t").agg(F.count("*").alias("o"))
    part = lambda x: F.sum(F.col("o") * x)
    return rows.join(often, "t").groupBy("draw").agg(F.sum("o").alias("n_rows"), part(F.col("c")).alias("x"), part(F.col("c") * F.col("c")).alias("xx"), part(F.col("m")).alias("y"), part(F.col("c") * F.col("m")).alias("xy"))


@query()
def model_checks(spark, sf):
    """The invariants of the full model, each with its tolerance and verdict."""
    return kernels.model_checks(vectors(spark, sf)).drop("variant")


@query()
def bootstrap_resolved_band(spark, sf):
    """Pointwise band of draws that solve the regression and fit the state space again; failed draws are left out."""
    good = kernels.bootstrap_resolved(settled(design(spark, sf)), 32, 6, 19).filter("error IS NULL")
    return resample.pointwise_band(good.drop("error")).drop("variant")


@query()
def log_alpha_search(spark, sf):
    return kernels.alpha_search(vectors(spark, sf)).drop("variant")


@query()
def log_rank_path(spark, sf):
    """The factor path of the logarithmic model under its chosen power."""
    v = settled(vectors(spark, sf))
    alpha = kernels.alpha_search(v).filter("chosen").first()["alpha"]
    return kernels.log_smoother(v, alpha).drop("variant")
