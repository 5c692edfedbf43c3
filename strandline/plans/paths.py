"""Operator-path queries: kernels, moments, probes, filters, comparisons and resampled draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compare, filters, graph, moments, resample, scores
from ..session import settled, table
from .base import blocks, panel, psi, query, r, sql, weights


def places(spark, sf):
    return moments.months(psi(spark, sf))


def tau_path(spark, sf):
    p = psi(spark, sf)
    return moments.diag_tau(p, weights(p))


def _kernel_sql(raw: str, reach: str = "true") -> str:
    return sql(f"SELECT s, t, {r('r / sum(r) OVER (PARTITION BY s)', 'w')} FROM (SELECT a.t AS s, b.t AS t, {raw} AS r FROM places a, places b WHERE {reach})")


@query(_kernel_sql("exp(-(a.t-b.t)*(a.t-b.t)/18.0)"))
def kernel_gaussian(spark, sf):
    return moments.kernel(places(spark, sf), "gaussian", 3.0).drop("variant")


@query(_kernel_sql("1 - abs(a.t-b.t)/7.0", "abs(a.t-b.t) <= 6"))
def kernel_bartlett(spark, sf):
    return moments.kernel(places(spark, sf), "bartlett", 6.0).drop("variant")


@query(_kernel_sql("1.0", "abs(a.t-b.t) <= 4"))
def kernel_boxcar(spark, sf):
    return moments.kernel(places(spark, sf), "boxcar", 4.0).drop("variant")


@query(sql(f"SELECT s, {r('1/sum(w*w)', 'ess')}, count(*) AS support FROM w GROUP BY s"))
def weight_ess(spark, sf):
    return moments.ess(weights(psi(spark, sf))).drop("variant")


@query(sql(f"SELECT {r('min(lo)', 'min_w')}, {r('max(hi)', 'max_w')}, {r('max(abs(rs-1))', 'row_error')}, {r('avg(ess)', 'mean_ess')}, {r('(SELECT max(abs(c-1)) FROM (SELECT sum(w) AS c FROM w GROUP BY t))', 'col_error')} FROM (SELECT min(w) AS lo, max(w) AS hi, sum(w) AS rs, 1/sum(w*w) AS ess FROM w GROUP BY s)"))
def weight_diagnostics(spark, sf):
    return moments.weight_diagnostics(weights(psi(spark, sf))).drop("variant")


@query(sql(f"SELECT a.k AS i, b.k AS j, {r('avg(a.psi*b.psi)', 'c', 4)} FROM psi a JOIN psi b USING (t) GROUP BY 1, 2"), digits=4)
def second_moment_coo(spark, sf):
    return moments.second_moment(psi(spark, sf)).drop("variant")


@query(sql(f"SELECT s, a.k AS i, b.k AS j, {r('sum(w*a.psi*b.psi)', 'k_ij', 3)} FROM psi a JOIN psi b USING (t) JOIN w USING (t) GROUP BY 1, 2, 3"), digits=3)
def moment_path_coo(spark, sf):
    p = psi(spark, sf)
    return moments.moment_path(p, weights(p)).drop("variant")


@query(sql(f"SELECT s, h, j, k, {r('k_kk', digits=4)}, {r('c_kk', digits=4)} FROM diag"), digits=4)
def diag_moment_path(spark, sf):
    p = psi(spark, sf)
    return moments.diagonals(p, weights(p)).drop("variant")


@query(sql(f"SELECT s, {r('tau')} FROM tau"))
def diag_tau_path(spark, sf):
    return tau_path(spark, sf).drop("variant")


def _cells(spark, sf):
    p = psi(spark, sf)
    w = weights(p)
    return moments.cell_probes(moments.diagonals(p, w), moments.diag_tau(p, w))


@query(sql(f"SELECT s, h, j, k, {r('amp')}, {r('shape')} FROM cells"))
def cell_amp(spark, sf):
    return _cells(spark, sf).drop("variant")


@query(sql(f"SELECT s, block, {r('sum(k_kk)/sum(c_kk)', 'amp')}, {r('sum(k_kk)/sum(c_kk)/any_value(tau)', 'shape')} FROM diag JOIN blk USING (k) JOIN tau USING (s) GROUP BY s, block"))
def block_amp(spark, sf):
    p = psi(spark, sf)
    w = weights(p)
    return moments.block_probes(moments.diagonals(p, w), moments.diag_tau(p, w), blocks(spark)).drop("variant")


@query(sql(f"SELECT s, {r('sqrt(avg(shape*shape))', 'shape_rms')}, {r('exp(-sum(p*ln(p)))/count(*)', 'support')} FROM (SELECT *, amp / sum(amp) OVER (PARTITION BY s) AS p FROM cells) GROUP BY s"))
def shape_metrics(spark, sf):
    return moments.shape_metrics(_cells(spark, sf)).drop("variant")


@query(sql(f"SELECT s, block, {r('sum(f)', 'share')} FROM (SELECT *, k_kk / sum(k_kk) OVER (PARTITION BY s) AS f FROM diag) JOIN blk USING (k) GROUP BY s, block"))
def share_metrics(spark, sf):
    p = psi(spark, sf)
    return moments.shares(moments.diagonals(p, weights(p)), blocks(spark)).drop("variant")


@query(sql(f"SELECT s, {r('avg(raw/c_kk)', 'total')}, {r('avg(m*m/c_kk)', 'mean_part')}, {r('avg(raw/c_kk) - avg(m*m/c_kk)', 'within_part')} FROM (SELECT s, k, sum(w*psi) AS m, sum(w*psi*psi) AS raw FROM psi JOIN w USING (t) GROUP BY s, k) JOIN cd USING (k) GROUP BY s"))
def mean_within_diag(spark, sf):
    p = psi(spark, sf)
    return moments.mean_within(p, weights(p)).drop("variant")


@query(sql(f"SELECT a, b, {r('1.0/(gap*gap)', 'conductance')} FROM (SELECT lag(t) OVER o AS a, t AS b, date_diff('month', lag(date) OVER o, date) AS gap FROM places WINDOW o AS (ORDER BY date)) WHERE a IS NOT NULL"))
def path_laplacian_edges(spark, sf):
    return moments.path_edges(places(spark, sf)).drop("variant")


_F = {
    "z": "SELECT t, (sales - avg(sales) OVER ()) / stddev_pop(sales) OVER () AS f1, (share_f - avg(share_f) OVER ()) / stddev_pop(share_f) OVER () AS f2 FROM panel WHERE t IN (SELECT t FROM places)",
    "d": "SELECT a.t AS s, b.t AS t, sqrt((a.f1-b.f1)*(a.f1-b.f1) + (a.f2-b.f2)*(a.f2-b.f2)) AS d FROM z a, z b",
}


@query(sql(f"SELECT s, t, {r('r / sum(r) OVER (PARTITION BY s)', 'w')} FROM (SELECT s, t, w * exp(-d*d / (2*(SELECT quantile_cont(d, 0.5) FROM d WHERE d > 0)*(SELECT quantile_cont(d, 0.5) FROM d WHERE d > 0))) AS r FROM w JOIN d USING (s, t))", **_F))
def kernel_feature_blend(spark, sf):
    p = psi(spark, sf)
    pl = moments.months(p)
    x = panel(spark, sf).join(pl.select("variant", "t"), ["variant", "t"], "left_semi")
    w = Window.partitionBy("variant")
    z = x.select("variant", "t", *[((F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).alias(n) for c, n in (("sales", "f1"), ("share_f", "f2"))])
    return moments.blended(weights(p), z, ["f1", "f2"]).drop("variant")


# --- ordered filters ---------------------------------------------------------------------------------------------


@query(sql(f"SELECT t, k, {r('f', 'filtered')} FROM (SELECT t, k, sum(psi) OVER (PARTITION BY k ORDER BY t ROWS 6 PRECEDING)/sqrt(7) AS f, count(*) OVER (PARTITION BY k ORDER BY t ROWS 6 PRECEDING) AS c FROM psi) WHERE c = 7"))
def bartlett_filter(spark, sf):
    return filters.bartlett(psi(spark, sf).select("t", "k", "psi"), "psi", ["k"], 6).select("t", "k", "filtered")


@query(sql(f"SELECT a.t, a.k, {r('sum(pow(pow(0.5, 1.0/3), a.t-b.t)*b.psi)', 'filtered')} FROM psi a JOIN psi b ON a.k = b.k AND b.t <= a.t GROUP BY a.t, a.k"))
def exp_filter_closed_form(spark, sf):
    return filters.exponential(psi(spark, sf).select("t", "k", "psi"), "psi", ["k"], 3.0)


@query(sql(f"SELECT t, k, {r('after')}, {r('coalesce(lag(after) OVER (PARTITION BY k ORDER BY t), 0)', 'before')} FROM (SELECT a.t, a.k, (1-pow(0.5, 1.0/6))*sum(pow(pow(0.5, 1.0/6), a.t-b.t)*b.psi) AS after FROM psi a JOIN psi b ON a.k = b.k AND b.t <= a.t GROUP BY a.t, a.k)"))
def ewma_mean(spark, sf):
    return filters.ewma(psi(spark, sf).select("t", "k", "psi"), "psi", ["k"], 6.0)


@query(sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT a.t, a.k, {h}::DOUBLE AS half_life, {r(f'sum(pow(pow(0.5, 1.0/{h}), a.t-b.t)*b.psi)', 'filtered')} FROM psi a JOIN psi b ON a.k = b.k AND b.t <= a.t GROUP BY a.t, a.k" for h in (3, 12)) + ")"))
def volterra_level_one(spark, sf):
    return filters.volterra_level_one(psi(spark, sf).select("t", "k", "psi"), "psi", ["k"], [3.0, 12.0])


@query(sql(f"SELECT s, {r('sum(tau) OVER o', 'running')}, {r('sum(tau) OVER o / sum(tau) OVER ()', 'running_share')} FROM tau WINDOW o AS (ORDER BY s)"))
def cumulative_shares(spark, sf):
    t = tau_path(spark, sf).withColumnRenamed("s", "t")
    return filters.cumulative(t, "tau", ["variant"]).select(F.col("t").alias("s"), "running", "running_share")


_PCT = {
    "pct": "SELECT date, t, shock, control, (rank() OVER (ORDER BY shock) + (count(*) OVER (PARTITION BY shock) - 1)/2.0) / count(*) OVER () AS ps, (rank() OVER (ORDER BY control) + (count(*) OVER (PARTITION BY control) - 1)/2.0) / count(*) OVER () AS pc FROM panel",
    "lab": "SELECT *, CASE WHEN ps - pc > 0.1 THEN 'first' WHEN ps - pc < -0.1 THEN 'second' ELSE 'balanced' END AS driver, CASE WHEN ps >= 0.75 AND pc >= 0.75 THEN 'both' WHEN ps >= 0.75 THEN 'first_only' WHEN pc >= 0.75 THEN 'second_only' ELSE 'neither' END AS quadrant FROM pct",
    "isl": "SELECT *, t - row_number() OVER (ORDER BY t) AS g FROM lab WHERE ps >= 0.6",
    "cnt": "SELECT g, driver, count(*) AS n FROM isl GROUP BY g, driver",
}


def _labelled(spark, sf):
    p = panel(spark, sf).select("variant", "t", "date", "shock", "control")
    p = filters.percentile_rank(filters.percentile_rank(p, "shock", ["variant"], "ps"), "control", ["variant"], "pc")
    return filters.driver_labels(p, "ps", "pc")


@query(sql(f"SELECT date, {r('ps')}, {r('pc')}, driver, quadrant FROM lab", **_PCT))
def driver_quadrants(spark, sf):
    """Percentile ranks with average ties, and the labels made from them."""
    return _labelled(spark, sf).select("date", "ps", "pc", "driver", "quadrant")


@query(sql(f"""
SELECT min(t) AS start_t, max(t) AS end_t, count(*) AS length, {r('max(ps)', 'peak')}, arg_min(t, (-ps, t)) AS peak_t, {r('quantile_cont(ps, 0.5)', 'median')},
  CASE WHEN (SELECT n FROM cnt c WHERE c.g = i.g AND c.driver = arg_min(i.driver, (-ps, t))) = (SELECT max(n) FROM cnt c WHERE c.g = i.g) THEN arg_min(driver, (-ps, t))
    ELSE (SELECT arg_min(c.driver, (-c.n, c.driver)) FROM cnt c WHERE c.g = i.g) END AS dominant FROM isl i GROUP BY g
""", **_PCT))
def episodes_islands(spark, sf):
    l = _labelled(spark, sf).withColumn("high", F.col("ps") >= 0.6)
    return filters.episodes(l, "high", ["variant"], "ps", "driver").drop("variant")


@query(sql(f"SELECT driver, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')}, count(*) = max(count(*)) OVER () AS is_mode FROM lab GROUP BY driver", **_PCT))
def mode_shares(spark, sf):
    return compare.mode_shares(_labelled(spark, sf), ["variant"], "driver").drop("variant")


@query(sql("SELECT t, (row_number() OVER (ORDER BY t) * 5 - 1) // count(*) OVER () AS fold FROM places"))
def time_folds(spark, sf):
    return filters.time_folds(places(spark, sf), ["variant"], 5).select("t", "fold")


@query(
    sql(
        f"SELECT rank, s AS t, {r('tau')} FROM (SELECT unnest(chosen) AS s, generate_subscripts(chosen, 1) AS rank FROM (SELECT chosen FROM pick ORDER BY rk DESC LIMIT 1)) JOIN tau USING (s)",
        ordered="SELECT s, row_number() OVER (ORDER BY tau DESC, s) AS rk FROM tau",
        pick="SELECT rk, [s] AS chosen FROM ordered WHERE rk = 1 UNION ALL SELECT o.rk, CASE WHEN len(chosen) < 6 AND len(list_filter(chosen, lambda x: abs(x - o.s) < 6)) = 0 THEN list_append(chosen, o.s) ELSE chosen END FROM pick p JOIN ordered o ON o.rk = p.rk + 1",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def spaced_top_months(spark, sf):
    """Six largest months at least six apart."""
    return filters.spaced_top(tau_path(spark, sf).withColumnRenamed("s", "t"), "tau", ["variant"], 6, 6).drop("variant")


# --- comparisons -------------------------------------------------------------------------------------------------

_B = {
    "wb": "SELECT s, t, r / sum(r) OVER (PARTITION BY s) AS w FROM (SELECT a.t AS s, b.t AS t, 1 - abs(a.t-b.t)/7.0 AS r FROM places a, places b WHERE abs(a.t-b.t) <= 6)",
    "taub": "SELECT s, sum(w*q) AS tau FROM wb JOIN q USING (t) GROUP BY s",
    "pa": "SELECT s AS t, date, tau AS x FROM tau JOIN places ON s = t",
    "pb": "SELECT s AS t, date, tau AS x FROM taub JOIN places ON s = t",
    "ab": "SELECT t, pa.date, pa.x AS xa, pb.x AS xb, rank() OVER (ORDER BY pa.x) + (count(*) OVER (PARTITION BY pa.x) - 1)/2.0 AS ra, rank() OVER (ORDER BY pb.x) + (count(*) OVER (PARTITION BY pb.x) - 1)/2.0 AS rb FROM pa JOIN pb USING (t)",
    "topa": "SELECT row_number() OVER (ORDER BY x DESC, t) AS rank, t, x FROM pa QUALIFY rank <= 10",
    "topb": "SELECT row_number() OVER (ORDER BY x DESC, t) AS rank, t, x FROM pb QUALIFY rank <= 10",
}


def _two_paths(spark, sf):
    p = psi(spark, sf)
    pl = moments.months(p)
    path = lambda w: moments.diag_tau(p, w).select("variant", F.col("s").alias("t"), F.col("tau").alias("x")).join(pl, ["variant", "t"])
    return path(weights(p)), path(moments.kernel(pl, "bartlett", 6.0))


@query(sql(f"""
SELECT count(*) AS n, {r('corr(xa, xb)', 'corr')}, {r('corr(ra, rb)', 'spearman')}, {r('sqrt(avg((xa-xb)*(xa-xb)))', 'rmse')},
  {r('corr(CASE WHEN year(date) IN (1998,1999,2007,2008,2020) THEN xa END, CASE WHEN year(date) IN (1998,1999,2007,2008,2020) THEN xb END)', 'crisis_corr')},
  {r('avg(xa)', 'mean_a')}, {r('avg(xb)', 'mean_b')}, arg_min(date, (-xa, t)) AS peak_a, arg_min(date, (-xb, t)) AS peak_b FROM ab
""", **_B))
def path_comparison(spark, sf):
    """Correlation, Spearman, RMSE, crisis correlation, means and peak months of two kernels' paths."""
    a, b = _two_paths(spark, sf)
    return compare.path_comparison(a, b, ["variant"]).drop("variant")


@query(sql(f"SELECT source, rank, t, {r('x')}, count(*) OVER (PARTITION BY t) = 2 AS in_both FROM (SELECT 'a' AS source, * FROM topa UNION ALL SELECT 'b', * FROM topb)", **_B))
def topk_overlap(spark, sf):
    a, b = _two_paths(spark, sf)
    return compare.top_overlap(a, b, ["variant"], 10).drop("variant")


@query(sql(f"SELECT rank, t, {r('x')} FROM topb WHERE t NOT IN (SELECT t FROM topa)", **_B))
def anti_new_months(spark, sf):
    a, b = _two_paths(spark, sf)
    return compare.new_places(b, a, ["variant"], 10).select("rank", "t", "x")


@query(sql(f"""
SELECT {r('corr(xa, xb)', 'corr')}, {r('avg(xb)/avg(xa)', 'retention')}, {r('stddev_pop(xa)', 'sd_full')}, {r('stddev_pop(xb)', 'sd_part')}, {r('max(xa)', 'max_full')}, {r('max(xb)', 'max_part')},
  arg_min(t, (-xa, t)) AS peak_full, arg_min(t, (-xb, t)) AS peak_part, (SELECT count(*) FROM (SELECT t FROM pa ORDER BY x DESC, t LIMIT 12) JOIN (SELECT t FROM pb ORDER BY x DESC, t LIMIT 12) USING (t)) AS overlap FROM ab
""", **_B))
def survival_table(spark, sf):
    a, b = _two_paths(spark, sf)
    return compare.survival(a, b, ["variant"]).drop("variant")


@query(sql(f"SELECT a.series AS a, b.series AS b, count(*) AS n, {r('corr(a.x, b.x)', 'corr')} FROM l a JOIN l b USING (t) WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2", l="SELECT t, 'sales' AS series, sales AS x FROM panel UNION ALL SELECT t, 'ticket', ticket FROM panel UNION ALL SELECT t, 'shock', shock FROM panel"))
def corr_matrix(spark, sf):
    p = panel(spark, sf)
    long = p.select("t", F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("x")) for c in ("sales", "ticket", "shock")])).alias("o")).select("t", "o.series", "o.x")
    return compare.correlation_matrix(long, "series")


@query(sql(f"SELECT name, named_t, arg_min(t, (abs(t - named_t), rank)) AS nearest_t, min(abs(t - named_t)) AS distance FROM (VALUES ('early', 12), ('middle', 40), ('late', 66)) v(name, named_t), topa GROUP BY 1, 2", **_B))
def named_state_nearest(spark, sf):
    a, _ = _two_paths(spark, sf)
    named = spark.createDataFrame([("early", 12), ("middle", 40), ("late", 66)], "name string, named_t long")
    return compare.nearest_state(named, compare.top(a, "x", ["variant"], 10))


@query(sql(f"SELECT coalesce(pa.t, pb.t) AS t, {r('pa.x', 'gauss')}, {r('pb.x', 'bart')}, {r('least(pa.x, pb.x)', 'lo')}, {r('greatest(pa.x, pb.x)', 'hi')}, {r('greatest(pa.x, pb.x) - least(pa.x, pb.x)', 'spread')} FROM (SELECT * FROM pa WHERE t < 50) pa FULL JOIN (SELECT * FROM pb WHERE t > 10) pb USING (t)", **_B))
def envelope_min_max(spark, sf):
    a, b = _two_paths(spark, sf)
    return compare.envelope([a.filter("t < 50"), b.filter("t > 10")], ["gauss", "bart"], ["t"])


_M = {
    "ms": "SELECT t, 'm' || j AS model, sum(psi) / 10 AS score FROM psi GROUP BY t, j",
    "pd": "SELECT a.model || '-' || b.model AS pair, a.t, a.score - b.score AS diff FROM ms a JOIN ms b USING (t) WHERE (a.model, b.model) IN (('m1', 'm0'), ('m2', 'm0'), ('m2', 'm1'), ('m3', 'm0'), ('m4', 'm0'))",
    "pr": "SELECT *, row_number() OVER (PARTITION BY pair ORDER BY abs(diff) DESC, t) AS rk FROM pd",
}
PAIRS = [("m1", "m0"), ("m2", "m0"), ("m2", "m1"), ("m3", "m0"), ("m4", "m0")]


def _model_scores(spark, sf):
    return psi(spark, sf).groupBy("t", F.concat(F.lit("m"), F.col("j")).alias("model")).agg((F.sum("psi") / 10).alias("score"))


@query(sql(f"SELECT pair, t, {r('diff')} FROM pd", **_M))
def pair_diff_decomposition(spark, sf):
    return compare.pair_differences(_model_scores(spark, sf), PAIRS)


@query(sql(f"SELECT pair, count(*) AS n, {r('avg(diff)', 'mean')}, {r('stddev_samp(diff)', 'sd')}, {r('quantile_cont(diff, 0.5)', 'median')}, {r('min(diff)', 'lo')}, {r('max(diff)', 'hi')}, " + ", ".join(r(f"quantile_cont(diff, {q})", f"q{round(100 * q):02d}") for q in compare.QUANTILES) + ", " + ", ".join(r(f"sum(CASE WHEN rk <= {k} THEN abs(diff) END) / sum(abs(diff))", f"top{k}_share") for k in (1, 5, 10)) + " FROM pr GROUP BY pair", **_M))
def pair_summary(spark, sf):
    return compare.pair_summary(compare.pair_differences(_model_scores(spark, sf), PAIRS))


@query(sql(f"SELECT pair, t, {r('diff')}, {r('abs(diff) / tot', 'abs_share')}, rk AS rank FROM (SELECT *, sum(abs(diff)) OVER (PARTITION BY pair) AS tot FROM pr) WHERE rk <= 5", **_M))
def influential_rows(spark, sf):
    return compare.influential(compare.pair_differences(_model_scores(spark, sf), PAIRS), 5)


@query(sql(f"SELECT model, count(*) AS n, {r('avg(score)', 'mean')}, {r('sum(score)', 'total')}, {r('min(score)', 'lo')}, {r('max(score)', 'hi')}, row_number() OVER (ORDER BY sum(score) DESC, model) AS rank FROM ms GROUP BY model", **_M))
def model_summary(spark, sf):
    return compare.model_summary(_model_scores(spark, sf))


@query(f"SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_size, p_partkey)) AS p_partkey, {r('min(p_retailprice)', 'p_retailprice', 2)}, arg_min(p_size, (p_retailprice, p_size, p_partkey))::BIGINT AS p_size FROM part GROUP BY p_brand", digits=2)
def best_candidate(spark, sf):
    return compare.best_candidate(table(spark, sf, "part"), ["p_brand"], "p_retailprice", "p_size", ["p_partkey"])


_S = {
    "sm": "SELECT s, sqrt(avg(shape*shape)) AS rms FROM cells GROUP BY s",
    "st": "SELECT s AS t, date, tau, rms, sqrt(ln(tau)*ln(tau) + rms*rms) AS neutral FROM tau JOIN sm USING (s) JOIN places ON s = t",
    "pk": "SELECT 'neutral' AS label, arg_min(t, (neutral, t)) AS t FROM st UNION ALL SELECT 'peak', arg_min(t, (-tau, t)) FROM st UNION ALL SELECT 'shape', arg_min(t, (-rms, t)) FROM st UNION ALL SELECT 'fixed', min(t) FROM st WHERE date = DATE '1998-08-01'",
}


def _states(spark, sf):
    p = psi(spark, sf)
    w = weights(p)
    tau = moments.diag_tau(p, w)
    cells = moments.cell_probes(moments.diagonals(p, w), tau)
    rms = moments.shape_metrics(cells).select("variant", "s", F.col("shape_rms").alias("rms"))
    return tau.join(rms, ["variant", "s"]).withColumnRenamed("s", "t").join(moments.months(p), ["variant", "t"])


@query(sql(f"SELECT t, date, label, {r('tau')}, {r('rms')} FROM (SELECT t, string_agg(label, '+' ORDER BY label) AS label FROM pk WHERE t IS NOT NULL GROUP BY t) JOIN st USING (t)", **_S))
def episode_selection(spark, sf):
    return compare.selected_episodes(_states(spark, sf), ["variant"], "1998-08-01").select("t", "date", "label", "tau", "rms")


_WIN = [("early", "1995-06-01", "1996-12-01"), ("middle", "1997-01-01", "1998-12-01"), ("late", "1999-01-01", "2001-06-01")]


@query(sql(f"""
SELECT 'fixed ' || strftime(date, '%Y-%m') AS label, date, {r('x')} FROM pa WHERE date IN (DATE '1997-03-01', DATE '2000-02-01')
UNION ALL SELECT label, arg_min(date, (-x, date)) AS d, round(max(x), 6) + 0.0 FROM pa JOIN (VALUES {', '.join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in _WIN)}) v(label, lo, hi) ON date BETWEEN lo AND hi
GROUP BY label HAVING arg_min(date, (-x, date)) NOT IN (DATE '1997-03-01', DATE '2000-02-01')
""", **_B))
def window_peaks(spark, sf):
    a, _ = _two_paths(spark, sf)
    return compare.window_peaks(a, _WIN, ["1997-03-01", "2000-02-01"])


# --- draws -------------------------------------------------------------------------------------------------------

DRAWS, BLOCK = 60, 6
_D = {
    "qi": "SELECT row_number() OVER (ORDER BY t) - 1 AS t, q FROM q",
    "nn": "SELECT count(*) AS n FROM qi",
    "boot": f"SELECT draw, pos, (((draw * 7919 + (pos // {BLOCK}) * 104729) % n) + pos % {BLOCK}) % n AS t FROM (SELECT unnest(range({DRAWS})) AS draw), nn, LATERAL (SELECT unnest(range(n)) AS pos)",
    "wi": "SELECT s - (SELECT min(t) FROM places) AS s, t - (SELECT min(t) FROM places) AS t, w FROM w",
    "dr": "SELECT draw, s, sum(w*qi.q) AS tau FROM boot JOIN qi USING (t) JOIN wi ON wi.t = boot.pos GROUP BY draw, s",
    "ce": "SELECT s, sum(w*q) AS tau FROM wi JOIN qi USING (t) GROUP BY s",
}


def _path_draws(spark, sf):
    """(variant, draw, s, tau) and the centre, with places renumbered from 0."""
    p = psi(spark, sf)
    cols = p.groupBy("variant", "k").agg(F.avg(F.col("psi") * F.col("psi")).alias("c"))
    q = p.join(cols, ["variant", "k"]).groupBy("variant", "t").agg(F.avg(F.col("psi") * F.col("psi") / F.col("c")).alias("q"))
    lo = q.groupBy("variant").agg(F.min("t").alias("lo"))
    qi = settled(q.join(lo, "variant").select("variant", (F.col("t") - F.col("lo")).alias("t"), "q"))
    w = weights(p).join(lo, "variant").select("variant", (F.col("s") - F.col("lo")).alias("s"), (F.col("t") - F.col("lo")).alias("t"), "w")
    n = qi.count()
    draws = settled(resample.path_draws(qi, w, resample.arithmetic_blocks(spark, n, BLOCK, DRAWS)))
    centre = w.join(qi, ["variant", "t"]).groupBy("variant", "s").agg(F.sum(F.col("w") * F.col("q")).alias("tau"))
    return draws, centre


@query(sql(f"SELECT draw, s, {r('tau')} FROM dr", **_D))
def block_bootstrap_path(spark, sf):
    return _path_draws(spark, sf)[0].drop("variant")


@query(sql(f"SELECT s, {r('quantile_cont(tau, 0.05)', 'lo')}, {r('quantile_cont(tau, 0.5)', 'mid')}, {r('quantile_cont(tau, 0.95)', 'hi')}, {r('stddev_samp(tau)', 'sd')} FROM dr GROUP BY s", **_D))
def pointwise_band(spark, sf):
    return resample.pointwise_band(_path_draws(spark, sf)[0]).drop("variant")


@query(sql(f"SELECT s, {r('exp(ln(tau) - crit*sd)', 'lo')}, {r('exp(ln(tau) + crit*sd)', 'hi')}, {r('crit')} FROM ce JOIN sd USING (s), cr", **_D, s0="SELECT s, stddev_samp(ln(tau)) AS sd0 FROM dr GROUP BY s", sd="SELECT s, greatest(sd0, (SELECT 0.1*quantile_cont(sd0, 0.5) FROM s0 WHERE sd0 > 0)) AS sd FROM s0", cr="SELECT quantile_cont(sup, 0.9) AS crit FROM (SELECT draw, max(abs(ln(dr.tau) - ln(ce.tau)) / sd) AS sup FROM dr JOIN ce USING (s) JOIN sd USING (s) GROUP BY draw)"))
def simultaneous_band_log(spark, sf):
    d, c = _path_draws(spark, sf)
    return resample.simultaneous_band(d, c).drop("variant")


_EP = [("early", 0, 20), ("middle", 21, 45), ("late", 46, 90)]


@query(sql(f"SELECT episode, {r('avg((best = 1)::INT)', 'prob_peak')}, {r('avg(best)', 'mean_rank')}, {r('quantile_cont(peak, 0.5)', 'median_peak')} FROM (SELECT draw, episode, min(rk) AS best, max(tau) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY tau DESC, s) AS rk FROM dr) JOIN (VALUES {', '.join(map(str, _EP))}) v(episode, lo, hi) ON s BETWEEN lo AND hi GROUP BY draw, episode) GROUP BY episode", **_D))
def episode_probability(spark, sf):
    return resample.episode_probability(_path_draws(spark, sf)[0], spark.createDataFrame(_EP, "episode string, lo long, hi long")).drop("variant")


@query(sql(f"SELECT s, {r('avg((rk <= 10)::INT)', 'prob')}, {r('quantile_cont(rk, 0.05)', 'rank_p05')}, {r('quantile_cont(rk, 0.95)', 'rank_p95')} FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY tau DESC, s) AS rk FROM dr) GROUP BY s", **_D))
def rank_membership(spark, sf):
    return resample.membership(_path_draws(spark, sf)[0]).drop("variant")


_PB = {"pi": "SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY t) - 1 AS t, diff FROM pd", "bm": "SELECT pair, draw, avg(diff) AS mean, count(*) AS n FROM pi JOIN boot USING (t) GROUP BY pair, draw"}


def _pairs(spark, sf):
    d = compare.pair_differences(_model_scores(spark, sf), PAIRS)
    return d.select("pair", (F.row_number().over(Window.partitionBy("pair").orderBy("t")) - 1).cast("long").alias("t"), "diff")


@query(sql(f"SELECT pair, draw, {r('mean')}, n FROM bm", **_D, **_M, **_PB))
def paired_bootstrap_contrast(spark, sf):
    d = _pairs(spark, sf)
    n = d.filter(F.col("pair") == "m1-m0").count()
    return resample.draw_means(d, resample.arithmetic_blocks(spark, n, BLOCK, DRAWS), ["pair"], "diff")


@query(sql(f"SELECT pair, {r('(SELECT avg(diff) FROM pi p WHERE p.pair = bm.pair)', 'mean')}, {r('quantile_cont(mean, 0.05)', 'lo')}, {r('quantile_cont(mean, 0.95)', 'hi')}, {r('avg((mean > 0)::INT)', 'prob_positive')} FROM bm GROUP BY pair", **_D, **_M, **_PB))
def block_bootstrap_mean_ci(spark, sf):
    d = _pairs(spark, sf)
    n = d.filter(F.col("pair") == "m1-m0").count()
    return resample.mean_interval(d, resample.arithmetic_blocks(spark, n, BLOCK, DRAWS), ["pair"], "diff")


@query(sql(f"SELECT pair, {r('avg(mean)', 'mean')}, {r('quantile_cont(mean, 0.05)', 'p05')}, {r('quantile_cont(mean, 0.95)', 'p95')}, {r('avg((mean > 0)::INT)', 'prob_positive')}, {r('avg(mean)/20', 'per_dim')} FROM bm GROUP BY pair", **_D, **_M, **_PB))
def comparison_summary(spark, sf):
    d = _pairs(spark, sf)
    n = d.filter(F.col("pair") == "m1-m0").count()
    return compare.comparison_summary(resample.draw_means(d, resample.arithmetic_blocks(spark, n, BLOCK, DRAWS), ["pair"], "diff"), 20)


@query(sql(f"SELECT draw, k, sum(c)::BIGINT AS n_rows, {r('sum(c*psi)', 's1', 3)}, {r('sum(c*psi*psi)', 's2', 3)} FROM (SELECT draw, t, count(*) AS c FROM boot GROUP BY draw, t) b JOIN psi ON psi.t = b.t + (SELECT min(t) FROM places) GROUP BY draw, k", **_D), digits=3)
def draw_sufficient_stats(spark, sf):
    """Per draw and coordinate: resampled counts, sums and squares."""
    p = psi(spark, sf)
    lo = p.groupBy("variant").agg(F.min("t").alias("lo"))
    pi = p.join(lo, "variant").withColumn("t", F.col("t") - F.col("lo"))
    n = moments.months(p).count()
    return scores.sufficient_stats(pi, resample.arithmetic_blocks(spark, n, BLOCK, DRAWS)).drop("variant")


# --- graph and spectra -------------------------------------------------------------------------------------------

_G = {
    "v": "SELECT label AS block, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings",
    "e": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, i ORDER BY d, j) AS rk FROM (SELECT a.block, a.id AS i, b.id AS j, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1]-p[2])*(p[1]-p[2])))) AS d FROM v a JOIN v b ON a.block = b.block AND a.id <> b.id)) WHERE rk <= 8",
    "sg": "SELECT block, i AS n, d AS sigma FROM e WHERE rk = 8",
    "a1": "SELECT e.block, e.i, e.j, exp(-d*d/(x.sigma*y.sigma)) AS a FROM e JOIN sg x ON x.block = e.block AND x.n = e.i JOIN sg y ON y.block = e.block AND y.n = e.j",
    "af": "SELECT block, i, j, max(a) AS a FROM (SELECT * FROM a1 UNION ALL SELECT block, j, i, a FROM a1) GROUP BY block, i, j",
    "dg": "SELECT block, i, sum(a) AS d FROM af GROUP BY block, i",
}


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").alias("block"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _graph_sql(select: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in _G.items()) + "\n" + select


@query(_graph_sql(f"SELECT block, i, j, {r('d')}, rk AS rank FROM e"))
def knn_edges(spark, sf):
    return graph.knn_edges(_vectors(spark, sf), 8)


@query(_graph_sql(f"SELECT block, i, j, {r('a')} FROM af"))
def self_tuning_affinity(spark, sf):
    return graph.affinities(graph.knn_edges(_vectors(spark, sf), 8), 8)


@query(_graph_sql(f"SELECT block, i, j, {r('a')}, {r('sum(a) OVER (PARTITION BY block, i)', 'degree')} FROM (SELECT af.block, af.i, af.j, af.a / sqrt(x.d * y.d) AS a FROM af JOIN dg x ON x.block = af.block AND x.i = af.i JOIN dg y ON y.block = af.block AND y.i = af.j)"))
def density_degree(spark, sf):
    return graph.density_normalised(graph.affinities(graph.knn_edges(_vectors(spark, sf), 8), 8), 0.5)


@query("SELECT label AS block, count(*) AS n, least(30, greatest(10, floor(sqrt(count(*)))))::BIGINT AS k FROM embeddings GROUP BY label")
def knn_default(spark, sf):
    n = F.count("*")
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("block")).agg(n.alias("n"), F.least(F.lit(30), F.greatest(F.lit(10), F.floor(F.sqrt(n)))).cast("long").alias("k"))


@query(f"""
WITH c AS (SELECT r_name AS region, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT region, target, {r('mass', digits=4)}, {r('effective', digits=4)}, own, CASE WHEN own = 0 THEN 'empty' WHEN effective < 100 THEN 'thin' ELSE 'ok' END AS status FROM (
  SELECT region, target, sum(w) AS mass, sum(w)*sum(w)/sum(w*w/n) AS effective, sum(CASE WHEN year = target THEN n ELSE 0 END)::BIGINT AS own FROM (
    SELECT c.region, y.target, c.year, c.n, exp(-pow(c.year - y.target, 2)/4.5)*c.n AS w FROM c, (SELECT DISTINCT year AS target FROM c) y) GROUP BY region, target)
""", digits=4)
def region_year_weights(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    counts = o.join(c, "o_custkey").join(n, "n_nationkey").join(table(spark, sf, "region"), "r_regionkey").groupBy(F.col("r_name").alias("region"), "year").agg(F.count("*").alias("n"))
    return graph.region_year_weights(counts, 1.5, 100)


_SP = {"sp": "SELECT s, k AS i, k_kk / c_kk AS a, c_kk / sum(c_kk) OVER (PARTITION BY s) AS q FROM diag"}
LAMBDAS = [0.1, 0.5, 1.0, 2.0, 5.0]


def _diag_spectrum(spark, sf):
    p = psi(spark, sf)
    d = moments.diagonals(p, weights(p))
    return d.select("variant", "s", F.col("k").alias("i"), (F.col("k_kk") / F.col("c_kk")).alias("a"), (F.col("c_kk") / F.sum("c_kk").over(Window.partitionBy("variant", "s"))).alias("q"))


@query(sql(f"SELECT s, lam, {r('sum(q*a/(lam+a))', 'stress')}, {r('1/(1+lam)', 'neutral')} FROM (SELECT s, q, a / sum(q*a) OVER (PARTITION BY s) AS a FROM sp), (SELECT unnest([{', '.join(map(str, LAMBDAS))}])::DOUBLE AS lam) GROUP BY s, lam", **_SP))
def stress_curve(spark, sf):
    return graph.stress_curve(_diag_spectrum(spark, sf), LAMBDAS, True).drop("variant")


@query(sql(f"SELECT s, x, {r('f')}, {r('dv', 'derivative')}, row_number() OVER (PARTITION BY s ORDER BY dv DESC, x) = 1 AS peak FROM (SELECT s, x, sum(q*a/(x+a)) AS f, sum(x*a*q/pow(x+a, 2)) AS dv FROM sp, (SELECT unnest([{', '.join(map(str, LAMBDAS))}])::DOUBLE AS x) GROUP BY s, x)", **_SP))
def spectral_derivative(spark, sf):
    return graph.spectral_derivative(_diag_spectrum(spark, sf), LAMBDAS).drop("variant")
