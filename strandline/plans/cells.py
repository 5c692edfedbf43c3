"""Covariances of orders by the customers' region and year."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..operators import cells
from ..session import table
from .base import query, r

_WIDTH, _RIDGE, _LEAST = 1.5, 0.05, 2500.0
_COLUMNS = ["price", "balance", "urgent"]


def _cells(spark, sf):
    """(region, year, n, i, j, cross), centred: orders are summed up by customer and year before they meet the customers, and
    the means taken off the sums."""
    x = {"price": F.col("o_totalprice") / 1e5, "urgent": (F.col("o_orderpriority") == "1-URGENT").cast("double")}
    sums = [F.count("*").alias("n"), *[F.sum(x[c]).alias(c) for c in x], *[F.sum(x[a] * x[b]).alias(f"{a}_{b}") for a, b in (("price", "price"), ("price", "urgent"), ("urgent", "urgent"))]]
    by = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(*sums)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), (F.col("c_acctbal") / 1e4).alias("b"))
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    m = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
    rows = by.join(c, "o_custkey").join(n, "n_nationkey").join(m, "r_regionkey")
    balance = [F.sum(F.col("n") * F.col("b")).alias("balance"), F.sum(F.col("n") * F.col("b") * F.col("b")).alias("balance_balance"), F.sum(F.col("price") * F.col("b")).alias("price_balance"), F.sum(F.col("urgent") * F.col("b")).alias("urgent_balance")]
    agg = rows.groupBy("region", "year").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("price", "urgent", "price_price", "price_urgent", "urgent_urgent")], *balance)
    name = lambda a, b: f"{a}_{b}" if f"{a}_{b}" in agg.columns else f"{b}_{a}"
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(a).alias("si"), F.col(b).alias("sj"), F.col(name(a, b)).alias("sij")) for (i, a), (j, b) in product(enumerate(_COLUMNS), repeat=2)])
    long = agg.select("region", "year", "n", F.explode(each).alias("e")).select("region", "year", "n", "e.*")
    means = long.groupBy("i", "j").agg((F.sum("si") / F.sum("n")).alias("mi"), (F.sum("sj") / F.sum("n")).alias("mj"))
    cross = F.col("sij") - F.col("mj") * F.col("si") - F.col("mi") * F.col("sj") + F.col("n") * F.col("mi") * F.col("mj")
    return long.join(means, ["i", "j"]).select("region", "year", "n", "i", "j", cross.alias("cross"))


_SQL = f"""
WITH o AS (SELECT r_name AS region, year(o_orderdate) AS year, [o_totalprice/1e5, c_acctbal/1e4, (o_orderpriority = '1-URGENT')::INT::DOUBLE] AS x
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT [avg(x[1]), avg(x[2]), avg(x[3])] AS mu FROM o),
ij AS (SELECT i, j FROM (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)),
c AS (SELECT region, year, i, j, count(*) AS n, sum((x[i+1] - mu[i+1]) * (x[j+1] - mu[j+1])) AS cross FROM o, m, ij GROUP BY ALL),
p AS (SELECT i, j, sum("cross") / sum(n) AS c FROM c GROUP BY i, j),
y AS (SELECT unnest(range((SELECT min(year) FROM c), (SELECT max(year) FROM c) + 1)) AS target),
s AS (SELECT region, target AS year, i, j, sum(w*n) AS weight_sum, sum(w*n)*sum(w*n)/sum(w*w*n) AS effective, sum(w*"cross") AS x FROM (SELECT c.*, target, exp(-0.5*pow((c.year - target)/{_WIDTH}, 2)) AS w FROM c, y) GROUP BY ALL),
q AS (SELECT *, least(0.70, {_RIDGE} + 0.35 * greatest(0, {_LEAST} - effective) / {_LEAST}) AS rho FROM s)
SELECT region, year, i::BIGINT AS i, j::BIGINT AS j, {r('(1 - rho) * x / weight_sum + rho * c', 'cov')}, {r('weight_sum', digits=4)}, {r('effective', digits=4)}, {r('rho')}, CASE WHEN effective < {_LEAST} THEN 'sparse_blended' ELSE 'smoothed' END AS status
FROM q JOIN p USING (i, j)
"""


@query(_SQL)
def region_year_covariances(spark, sf):
    out = cells.smoothed_covariances(_cells(spark, sf), _WIDTH, _RIDGE, _LEAST)
    return out.withColumns({c: F.round(c, 4) for c in ("weight_sum", "effective")})


@query()
def region_year_balanced(spark, sf):
    """The same, turned so that their mean is the pooled covariance."""
    own = _cells(spark, sf)
    return cells.balanced(cells.smoothed_covariances(own, _WIDTH, _RIDGE, _LEAST), cells.pooled(own)).select("region", "year", "i", "j", "cov", "rho", "status")
