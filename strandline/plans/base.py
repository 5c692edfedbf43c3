"""The panel that the queries share, in DataFrames and, for the comparison, as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import log100, month_start
from ..operators import calendar, moments, scores
from ..session import settled, table

OUTCOMES = ["sales", "n_orders", "ticket", "share_f", "share_urgent"]
HORIZON, LAG, WIDTH = 3, 2, len(OUTCOMES)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Register a query under its function's name, its doubles rounded and its integers widened; sql is its comparison."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            out = []
            for x in df.schema:
                c = F.col(x.name)
                if isinstance(x.dataType, (T.DoubleType, T.FloatType)):
                    c = F.round(c.cast("double"), digits) + F.lit(0.0)
                elif isinstance(x.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
                    c = c.cast("long")
                out.append(c.alias(x.name))
            return df.select(*out)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """(variant, t, n, date, five outcomes, shock, control, instrument) by month over the completed calendar: the fact
    tables are read once each, and what follows is bounded by the calendar."""
    om = (
        table(spark, sf, "orders")
        .groupBy(month_start("o_orderdate").alias("date"))
        .agg(
            log100(F.sum("o_totalprice")).alias("sales"),
            log100(F.count("*")).alias("n_orders"),
            (F.avg("o_totalprice") / 1000).alias("ticket"),
            F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share_f"),
            F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("share_urgent"),
        )
    )
    full = calendar.complete_months(om).join(monthly_shocks(spark, sf), "date", "left")
    return settled(calendar.indexed(full.withColumn("variant", F.lit("headline")), ["variant"]))


def monthly_shocks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(month_start("l_shipdate").alias("date")).agg(F.avg("l_discount").alias("shock"), F.avg("l_tax").alias("control"), F.avg("l_quantity").alias("instrument"))


def psi(spark: SparkSession, sf: str) -> DataFrame:
    return settled(scores.fwl_scores(panel(spark, sf), OUTCOMES, "shock", "control", HORIZON, LAG))


def weights(p: DataFrame, width: float = 3.0) -> DataFrame:
    return settled(moments.kernel(moments.months(p), "gaussian", width))


def blocks(spark: SparkSession) -> DataFrame:
    """(k, block): the coordinate selectors by outcome group and horizon band."""
    rows = []
    for h in range(HORIZON + 1):
        for j, name in enumerate(OUTCOMES):
            k = h * WIDTH + j
            rows.append((k, "shares" if name.startswith("share") else "volumes"))
            rows.append((k, "impact" if h == 0 else "later"))
    return spark.createDataFrame(rows, "k int, block string")


BLOCKS_SQL = "SELECT k, b AS block FROM (SELECT unnest(range(20)) AS k), LATERAL (SELECT unnest([CASE WHEN k % 5 >= 3 THEN 'shares' ELSE 'volumes' END, CASE WHEN k < 5 THEN 'impact' ELSE 'later' END]) AS b)"

_CTES = {
    "om": """SELECT date_trunc('month', o_orderdate)::DATE AS date, 100*ln(sum(o_totalprice)) AS sales, 100*ln(count(*)) AS n_orders, avg(o_totalprice)/1000 AS ticket,
      avg((o_orderstatus='F')::INT) AS share_f, avg((o_orderpriority='1-URGENT')::INT) AS share_urgent FROM orders GROUP BY 1""",
    "lm": "SELECT date_trunc('month', l_shipdate)::DATE AS date, avg(l_discount) AS shock, avg(l_tax) AS control, avg(l_quantity) AS instrument FROM lineitem GROUP BY 1",
    "cal": "SELECT unnest(generate_series((SELECT min(date) FROM om)::TIMESTAMP, (SELECT max(date) FROM om)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS date",
    "panel": "SELECT 'headline' AS variant, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n, * FROM cal LEFT JOIN om USING (date) LEFT JOIN lm USING (date)",
    "y": "SELECT t, date, 0 AS j, sales AS y FROM panel UNION ALL SELECT t, date, 1, n_orders FROM panel UNION ALL SELECT t, date, 2, ticket FROM panel UNION ALL SELECT t, date, 3, share_f FROM panel UNION ALL SELECT t, date, 4, share_urgent FROM panel",
    "sh": "SELECT t, n, date, shock / stddev_pop(shock) OVER () AS m, control / stddev_pop(control) OVER () AS c, shock, control, instrument FROM panel",
    "resp": "SELECT b.t, a2.date, h.h, b.j, h.h*5+b.j AS k, a.y - b1.y AS dy FROM y b JOIN (SELECT unnest(range(4)) AS h) h ON true JOIN y a2 ON a2.t=b.t AND a2.j=b.j LEFT JOIN y a ON a.t=b.t+h.h AND a.j=b.j LEFT JOIN y b1 ON b1.t=b.t-1 AND b1.j=b.j",
    "yd": "SELECT *, y - lag(y) OVER (PARTITION BY j ORDER BY t) AS d FROM y",
    "yv": "SELECT t, j, count(y) OVER (PARTITION BY j ORDER BY t ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS yc, count(d) OVER (PARTITION BY j ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS dc FROM yd",
    "sv": "SELECT t, n, date, count(CASE WHEN m IS NOT NULL AND c IS NOT NULL THEN 1 END) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sc FROM sh",
    "valid": "SELECT t, date FROM sv WHERE t >= 2 AND t < n - 3 AND sc = 3 AND t IN (SELECT t FROM yv WHERE yc = 6 AND dc = 2 GROUP BY t HAVING count(*) = 5)",
    "mv": "SELECT t, m, c FROM sh WHERE t IN (SELECT t FROM valid)",
    "mr": "SELECT t, m - (a + b*c) AS mr, c FROM mv, (SELECT regr_slope(m, c) AS b, regr_intercept(m, c) AS a FROM mv)",
    "mq": "SELECT avg(mr*mr) AS q FROM mr",
    "rv": "SELECT r.*, mr.mr, mr.c FROM resp r JOIN mr USING (t)",
    "rc": "SELECT k, regr_slope(dy, c) AS b, regr_intercept(dy, c) AS a FROM rv GROUP BY k",
    "psi": "SELECT t, date, h, j, k, mr * (dy - (a + b*c)) / q AS psi FROM rv JOIN rc USING (k), mq",
    "places": "SELECT DISTINCT t, date FROM psi",
    "w": "SELECT s, t, r / sum(r) OVER (PARTITION BY s) AS w FROM (SELECT a.t AS s, b.t AS t, exp(-(a.t-b.t)*(a.t-b.t)/18.0) AS r FROM places a, places b)",
    "cd": "SELECT k, avg(psi*psi) AS c_kk FROM psi GROUP BY k",
    "q": "SELECT t, avg(psi*psi/c_kk) AS q FROM psi JOIN cd USING (k) GROUP BY t",
    "tau": "SELECT s, sum(w*q) AS tau FROM w JOIN q USING (t) GROUP BY s",
    "diag": "SELECT s, h, j, k, sum(w*psi*psi) AS k_kk, any_value(c_kk) AS c_kk FROM psi JOIN w USING (t) JOIN cd USING (k) GROUP BY s, h, j, k",
    "cells": "SELECT s, h, j, k, k_kk/c_kk AS amp, ln(k_kk/c_kk/tau) AS shape FROM diag JOIN tau USING (s)",
    "blk": BLOCKS_SQL,
}


def sql(select: str, **more: str) -> str:
    """select over the shared expressions (and `more`, which may use them)."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in (_CTES | more).items()) + "\n" + select


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """A rounded double under a name."""
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name or expr}"
