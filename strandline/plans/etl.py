"""Panel queries: scans, nulls, calendars, joins, filters, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import calendar, compare, scores
from ..session import table
from .base import HORIZON, LAG, OUTCOMES, WIDTH, blocks, monthly_shocks, panel, psi, query, r, sql

EV = "SELECT l_shipdate AS ts, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END AS p, l_discount AS s FROM lineitem"


def events(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("p"), F.col("l_discount").alias("s"))


@query(f"""
WITH e AS (SELECT date_trunc('month', ts)::DATE AS date, p, s FROM ({EV})), g AS (
  SELECT date, coalesce(sum(coalesce(p, s)), 0) AS used_sum, coalesce(sum(p), 0) AS primary_sum, coalesce(sum(s), 0) AS second_sum, bool_or(p IS NULL) AS fallback_event,
    count(*) AS n_events, count(p) AS nonmissing_events, count(*) - count(p) AS missing_events FROM e GROUP BY date),
c AS (SELECT unnest(generate_series((SELECT min(date) FROM g)::TIMESTAMP, (SELECT max(date) FROM g)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS date)
SELECT date, {r('coalesce(used_sum, 0)', 'used_sum', 4)}, {r('coalesce(primary_sum, 0)', 'primary_sum', 4)}, {r('coalesce(second_sum, 0)', 'second_sum', 4)}, coalesce(fallback_event, false) AS fallback_event,
  coalesce(n_events, 0) AS n_events, coalesce(nonmissing_events, 0) AS nonmissing_events, coalesce(missing_events, 0) AS missing_events,
  coalesce(nonmissing_events > 0 AND missing_events > 0, false) AS mixed_events FROM c LEFT JOIN g USING (date)
""", digits=4)
def monthly_event_rollup(spark, sf):
    """Events with null fallback summed by month over the completed calendar."""
    return calendar.events_by_month(events(spark, sf), "ts", "p", "s")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_discount ELSE l_tax END AS used, l_returnflag = 'R' AS fallback FROM lineitem")
def null_fallback(spark, sf):
    li = table(spark, sf, "lineitem")
    p = F.when(F.col("l_returnflag") != "R", F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", scalars.fallback(p, F.col("l_discount")).alias("used"), p.isNull().alias("fallback"))


@query(sql(f"SELECT cal.date, {r('sales')}, {r('ticket')} FROM cal LEFT JOIN (SELECT * FROM om WHERE month(date) <> 5) o USING (date)"))
def calendar_complete(spark, sf):
    """A month dropped from every year comes back as nulls."""
    return calendar.complete_months(panel(spark, sf).filter("month(date) <> 5").select("date", "sales", "ticket"))


@query(sql(f"SELECT date, {r('sales')}, {r('shock')}, {r('control')} FROM om LEFT JOIN (SELECT * FROM lm WHERE year(date) > 1995) USING (date)"))
def panel_left_join(spark, sf):
    shocks = monthly_shocks(spark, sf).filter("year(date) > 1995")
    return calendar.fold_left(panel(spark, sf).select("date", "sales"), [shocks.select("date", "shock"), shocks.select("date", "control")])


@query(sql(f"SELECT date, {r('sales')}, {r('shock')} FROM om JOIN (SELECT * FROM lm WHERE year(date) > 1995 AND month(date) <> 2) USING (date) WHERE shock IS NOT NULL"))
def panel_overlap_inner(spark, sf):
    return panel(spark, sf).select("date", "sales").join(monthly_shocks(spark, sf).filter("year(date) > 1995 AND month(date) <> 2").select("date", "shock"), "date").dropna(subset=["shock"])


@query("SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS date, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1, 2")
def dedupe_keep_last(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", scalars.month_start("o_orderdate").alias("date"), "o_orderdate", "o_orderkey", "o_totalprice")
    return calendar.keep_last(o, ["o_custkey", "date"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query(f"""
WITH d AS (SELECT o_orderdate::DATE AS day, max(o_totalprice) AS x FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
m AS (SELECT date_trunc('month', day)::DATE AS date, arg_max(x, day) AS eom FROM d GROUP BY 1)
SELECT date, {r('eom', digits=4)}, {r('eom - lag(eom) OVER (ORDER BY date)', 'diff', 4)} FROM m
""", digits=4)
def month_end_last(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("x"))
    return calendar.month_end_last(o, "day", "x")


@query("""
WITH q AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT y, q, n, (make_date(y, 3*q-2, 1) + to_months(k::INT))::DATE AS date FROM q, (SELECT unnest(range(3)) AS k)
""")
def quarter_to_month(spark, sf):
    q = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count("*").alias("n"))
    return calendar.quarter_to_months(q, "y", "q")


@query(f"SELECT c_custkey, {r('CASE WHEN c_acctbal > 0 THEN 100*ln(c_acctbal) END', 'log_bal')} FROM customer")
def log100_transform(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalars.log100("c_acctbal").alias("log_bal"))


@query(sql(f"SELECT a.t, a.date, {r('a.shock', 'shock')}, {r('b.shock', 'shock_shifted')} FROM panel a JOIN panel b ON a.t = (b.t + 7) % b.n"))
def circular_shift(spark, sf):
    p = panel(spark, sf).select("variant", "t", "n", "date", "shock")
    return calendar.circular_shift(p, "shock", 7, ["variant"]).select("t", "date", "shock", "shock_shifted")


@query(sql(f"SELECT date, {r('CASE WHEN date BETWEEN lo AND hi THEN coalesce(z, 0) END', 'z')} FROM p, (SELECT min(date) AS lo, max(date) AS hi FROM p WHERE z IS NOT NULL)", p="SELECT date, CASE WHEN year(date) BETWEEN 1996 AND 1999 AND month(date) % 3 <> 0 THEN shock END AS z FROM panel"))
def range_zero_fill(spark, sf):
    p = panel(spark, sf).select("date", F.when(F.year("date").between(1996, 1999) & (F.month("date") % 3 != 0), F.col("shock")).alias("z"))
    return calendar.in_range_zero(p, "z", p)


@query(sql("SELECT CASE WHEN a >= 12 THEN 'rare' WHEN b >= 12 THEN 'shock' END AS preferred, a AS n_rare, b AS n_shock FROM (SELECT count(CASE WHEN year(date) = 1996 AND month(date) < 4 THEN shock END) AS a, count(shock) AS b FROM panel)"))
def preferred_instrument(spark, sf):
    p = panel(spark, sf).withColumn("rare", F.when((F.year("date") == 1996) & (F.month("date") < 4), F.col("shock")))
    return calendar.preferred_column(p, ["rare", "shock"])


@query(sql("""
SELECT series, min(CASE WHEN x IS NOT NULL THEN date END) AS first_date, max(CASE WHEN x IS NOT NULL THEN date END) AS last_date, count(x) AS n_finite, count(*) - count(x) AS n_missing,
  coalesce(string_agg(CASE WHEN x IS NULL AND date BETWEEN lo AND hi THEN strftime(date, '%Y-%m') END, ', ' ORDER BY date), '') AS gap_months
FROM (SELECT *, min(CASE WHEN x IS NOT NULL THEN date END) OVER (PARTITION BY series) AS lo, max(CASE WHEN x IS NOT NULL THEN date END) OVER (PARTITION BY series) AS hi FROM l) GROUP BY series
""", l="SELECT 'sales' AS series, date, CASE WHEN month(date) <> 5 THEN sales END AS x FROM panel UNION ALL SELECT 'shock', date, CASE WHEN year(date) > 1996 THEN shock END FROM panel"))
def coverage_summary(spark, sf):
    p = panel(spark, sf).select("date", F.when(F.month("date") != 5, F.col("sales")).alias("sales"), F.when(F.year("date") > 1996, F.col("shock")).alias("shock"))
    return calendar.coverage(p, ["sales", "shock"])


@query(sql(f"SELECT date, {r('sales')}, {r('ticket')} FROM panel WHERE sales IS NOT NULL AND ticket IS NOT NULL AND year(date) IN (1998, 1999, 2007, 2008, 2020)"))
def balanced_crisis_filter(spark, sf):
    """Column pruning, rows complete in all outcomes, crisis years."""
    return panel(spark, sf).dropna(subset=["sales", "ticket"]).filter(compare.crisis("date")).select("date", "sales", "ticket")


@query("SELECT make_date(year(o_orderdate), month(o_orderdate), 1) AS date, 12 * year(o_orderdate) + month(o_orderdate) AS month_number, strftime(min(o_orderdate), '%Y-%m') AS label, count(*) AS n FROM orders GROUP BY 1, 2")
def month_keys(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(scalars.month_from_parts(F.year("o_orderdate"), F.month("o_orderdate")).alias("date"), scalars.month_number("o_orderdate").alias("month_number")).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("label"), F.count("*").alias("n"))


@query(f"""
SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, (DATE '1899-12-30' + (35000 + p_size)::INT)::DATE AS serial_date,
  {r('coalesce(pow(0.5, 1.0 / nullif(p_size % 4, 0)), 1)', 'decay')}, {r('sqrt(p_size * p_size + p_retailprice / 1000 * (p_retailprice / 1000))', 'norm')} FROM part
""")
def scalar_functions(spark, sf):
    """Slugs, serial dates, half-life decay and norms."""
    h = F.nullif(F.col("p_size") % 4, F.lit(0))
    return table(spark, sf, "part").select("p_partkey", scalars.slug("p_type").alias("slug"), scalars.excel_date(F.col("p_size") + 35000).alias("serial_date"), scalars.half_life_decay(h).alias("decay"), F.hypot(F.col("p_size").cast("double"), F.col("p_retailprice") / 1000).alias("norm"))


@query("""
SELECT * FROM (VALUES (0, 'sales', '100 ln', 'volumes'), (1, 'n_orders', '100 ln', 'volumes'), (2, 'ticket', 'level', 'volumes'), (3, 'share_f', 'level', 'shares'), (4, 'share_urgent', 'level', 'shares')) v(pos, "column", transform, grp)
WHERE "column" IN ('sales', 'ticket', 'share_f')
""")
def outcome_registry(spark, sf):
    """The registered outcomes that a table has, in registry order."""
    dim = spark.createDataFrame([(0, "sales", "100 ln", "volumes"), (1, "n_orders", "100 ln", "volumes"), (2, "ticket", "level", "volumes"), (3, "share_f", "level", "shares"), (4, "share_urgent", "level", "shares")], "pos int, column string, transform string, grp string")
    have = panel(spark, sf).select("date", "sales", "ticket", "share_f").columns
    return dim.filter(F.col("column").isin(have))


@query(sql("SELECT k, block FROM blk"))
def block_selectors(spark, sf):
    return blocks(spark)


@query(sql(f"SELECT date, {r('a')}, {r('b')} FROM d WHERE abs(a - b) > 1e-12", d="SELECT date, shock AS a, CASE WHEN month(date) IN (3, 9) THEN shock * 1.5 ELSE shock END AS b FROM panel"))
def difference_filter(spark, sf):
    p = panel(spark, sf).select("date", F.col("shock").alias("a"), F.when(F.month("date").isin(3, 9), F.col("shock") * 1.5).otherwise(F.col("shock")).alias("b"))
    return p.filter(F.abs(F.col("a") - F.col("b")) > 1e-12)


@query(sql("""
SELECT 'shock' AS variant, date, round(shock, 6) + 0.0 AS x, NULL AS source FROM panel WHERE shock IS NOT NULL
UNION ALL SELECT 'control', date, round(control, 6) + 0.0, 'tax' FROM panel WHERE control IS NOT NULL
"""))
def setop_union_by_name(spark, sf):
    p = panel(spark, sf)
    return compare.union_named({"shock": p.select("date", F.col("shock").alias("x")).filter("x IS NOT NULL"), "control": p.select(F.lit("tax").alias("source"), "date", F.col("control").alias("x")).filter("x IS NOT NULL")})


@query(sql(f"SELECT date, {r('arg_max(x, o)', 'x')} FROM (SELECT date, shock AS x, 0 AS o FROM panel WHERE year(date) <= 1998 UNION ALL SELECT date, control, 1 FROM panel WHERE year(date) BETWEEN 1998 AND 1999) GROUP BY date"))
def union_keep_last(spark, sf):
    p = panel(spark, sf)
    return compare.union_keep_last(p.filter("year(date) <= 1998").select("date", F.col("shock").alias("x")), p.filter("year(date) BETWEEN 1998 AND 1999").select("date", F.col("control").alias("x")), ["date"])


@query(sql(f"SELECT a.t, lag, {r('b.m', 'x')} FROM sh a, (SELECT unnest(range(1, 4)) AS lag) JOIN sh b ON b.t = a.t - lag"))
def lag_controls_long(spark, sf):
    return scores.lags(scores.scaled_shocks(panel(spark, sf), "shock", "control"), "m", ["variant"], 1, 3).select("t", "lag", "x")


@query(sql(f"SELECT t, date, h, j, k, {r('dy')} FROM resp"))
def lead_responses_long(spark, sf):
    return scores.responses(scores.melt(panel(spark, sf), OUTCOMES), HORIZON, WIDTH).drop("variant")


@query(sql("SELECT t, date FROM valid"))
def valid_window(spark, sf):
    p = panel(spark, sf)
    return scores.valid_places(scores.scaled_shocks(p, "shock", "control"), scores.melt(p, OUTCOMES), WIDTH, HORIZON, LAG).select("t", "date")


@query(sql(f"SELECT date FROM valid WHERE date IN (SELECT date FROM om WHERE month(date) IN (1, 6))"))
def sample_months_semi(spark, sf):
    p = panel(spark, sf)
    ok = scores.valid_places(scores.scaled_shocks(p, "shock", "control"), scores.melt(p, OUTCOMES), WIDTH, HORIZON, LAG)
    return ok.select("date").join(p.filter("month(date) IN (1, 6)").select("date"), "date", "left_semi")


_Z = ["lag(sales, 1) OVER o - lag(sales, 13) OVER o AS g12_sales", "lag(ticket, 1) OVER o AS lvl_ticket", "lag(share_f, 1) OVER o - lag(share_f, 4) OVER o AS d3_share_f"]


@query(sql("SELECT t, date, " + ", ".join(r(f"({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER ()", n) for n in ("g12_sales", "lvl_ticket", "d3_share_f")) + f" FROM (SELECT t, date, {', '.join(_Z)} FROM panel WINDOW o AS (ORDER BY t)) WHERE g12_sales IS NOT NULL AND lvl_ticket IS NOT NULL AND d3_share_f IS NOT NULL"))
def state_vector_z(spark, sf):
    return scores.state_vector(panel(spark, sf), ["sales"], ["ticket"], ["share_f"]).drop("variant")


@query(sql(f"SELECT t, date, h, j, k, {r('psi')} FROM psi"))
def fwl_scores_one_control(spark, sf):
    return psi(spark, sf).drop("variant")


_IV = {
    "x0": "SELECT t, shock, control AS c, instrument AS z FROM sh WHERE t IN (SELECT t FROM valid)",
    "xr": "SELECT t, c, shock - (a1 + b1*c) AS x, z - (a2 + b2*c) AS z FROM x0, (SELECT regr_slope(shock, c) AS b1, regr_intercept(shock, c) AS a1, regr_slope(z, c) AS b2, regr_intercept(z, c) AS a2 FROM x0)",
    "xq": "SELECT avg(z*x) AS q FROM xr",
    "ry": "SELECT r.t, r.date, r.h, r.j, r.k, r.dy, xr.x, xr.z, xr.c FROM resp r JOIN xr USING (t)",
    "ryc": "SELECT k, regr_slope(dy, c) AS b, regr_intercept(dy, c) AS a FROM ry GROUP BY k",
    "rr": "SELECT t, date, h, j, k, x, z, dy - (a + b*c) AS yr, q FROM ry JOIN ryc USING (k), xq",
    "iv": "SELECT t, date, h, j, k, z*yr/q AS rf, -z*x*(avg(z*yr) OVER (PARTITION BY k) / q)/q AS fs FROM rr",
}


@query(sql(f"SELECT t, date, h, j, k, {r('rf + fs', 'psi', 4)}, {r('rf', 'psi_rf', 4)}, {r('fs', 'psi_fs', 4)} FROM iv", **_IV), digits=4)
def iv_scores(spark, sf):
    """Scalar-instrument influence scores and their additive split."""
    return scores.iv_scores(panel(spark, sf), OUTCOMES, "shock", "instrument", "control", HORIZON, LAG).drop("variant")


@query(sql(f"SELECT t, {r('sum(pow(rf+fs,2))', 'energy', 2)}, {r('sum(rf*rf)', 'rf', 2)}, {r('sum(fs*fs)', 'fs', 2)}, {r('2*sum(rf*fs)', 'cross', 2)} FROM iv GROUP BY t", **_IV), digits=2)
def score_energy(spark, sf):
    return compare.score_energy(scores.iv_scores(panel(spark, sf), OUTCOMES, "shock", "instrument", "control", HORIZON, LAG)).drop("variant")


@query(sql(f"""
SELECT n AS n_obs, {r('zx/n', 'q')}, {r('zx/zz', 'pi')}, {r('1-(xx-zx*zx/zz)/xx', 'r2')}, {r('pow(zx/zz,2)/((xx-zx*zx/zz)/(n-1)/zz)', 'f_stat')}, {r('zx/sqrt(zz*xx)', 'corr')}, pow(zx/zz,2)/((xx-zx*zx/zz)/(n-1)/zz) < 10 AS weak
FROM (SELECT count(*) AS n, sum(x*z) AS zx, sum(z*z) AS zz, sum(x*x) AS xx FROM (SELECT shock - avg(shock) OVER () AS x, instrument - avg(instrument) OVER () AS z FROM panel WHERE shock IS NOT NULL AND instrument IS NOT NULL))
"""))
def iv_first_stage(spark, sf):
    return scores.first_stage(panel(spark, sf), "shock", "instrument").drop("variant")


@query(sql(f"SELECT date, {r('shock - (a + b*control)', 'shock_orth')} FROM panel, (SELECT regr_slope(shock, control) AS b, regr_intercept(shock, control) AS a FROM panel)"))
def orthogonalised_surprise(spark, sf):
    return scores.orthogonalised(panel(spark, sf), "shock", "control").select("date", "shock_orth")


@query(sql(f"SELECT j, {r('avg(d*d)', 'roughness', 4)} FROM (SELECT j, psi - 2*lag(psi,1) OVER o + lag(psi,2) OVER o AS d FROM psi WINDOW o AS (PARTITION BY t, j ORDER BY h)) GROUP BY j"), digits=4)
def second_diff_roughness(spark, sf):
    return scores.roughness(psi(spark, sf)).drop("variant")


@query(sql(f"SELECT j, {r('trace', digits=4)}, {r('trace / sum(trace) OVER ()', 'share', 4)}, {r('sqrt(sum(trace) OVER () / 5 / trace)', 'weight', 4)} FROM (SELECT j, sum(v) AS trace FROM (SELECT j, k, var_pop(psi) AS v FROM psi GROUP BY j, k) GROUP BY j)"), digits=4)
def equalizing_weights(spark, sf):
    return scores.block_traces(psi(spark, sf), WIDTH).drop("variant")


@query(f"SELECT n_name, year(o_orderdate) AS year, count(*) AS n, {r('sum(o_totalprice * c_acctbal) / 1e9', 'cross', 4)} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2", digits=4)
def region_year_moments(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return o.join(c, "o_custkey").join(n, "c_nationkey").groupBy("n_name", "year").agg(F.count("*").alias("n"), (F.sum(F.col("o_totalprice") * F.col("c_acctbal")) / 1e9).alias("cross"))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 5")
def first_n_per_group(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    return table(spark, sf, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 5").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("SELECT \"column\", round(max(d), 6) + 0.0 AS max_abs_diff, 0 AS unmatched FROM (SELECT 'l_tax' AS \"column\", abs(l_tax - l_tax * 1.25) AS d FROM lineitem UNION ALL SELECT 'l_discount', 0.0 FROM lineitem) GROUP BY 1")
def table_difference(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_tax").alias("l_tax"), F.max("l_discount").alias("l_discount"))
    return compare.numeric_difference(a, a.withColumn("l_tax", F.col("l_tax") * 1.25), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])
