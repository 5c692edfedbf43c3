"""Instrumented scores on sets of controls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scores
from .base import HORIZON, LAG, OUTCOMES, panel, query, r, sql

_IC = {
    "cc": "SELECT t, date, shock AS x, instrument AS z, control AS c1, lag(control) OVER (ORDER BY t) AS c2 FROM panel",
    "ok": "SELECT cc.* FROM cc JOIN (SELECT t FROM resp GROUP BY t HAVING count(dy) = 20) g USING (t) WHERE x IS NOT NULL AND z IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL",
    "vs": "SELECT t, date, c1, c2, -2 AS k, x AS v FROM ok UNION ALL SELECT t, date, c1, c2, -1, z FROM ok UNION ALL SELECT ok.t, ok.date, c1, c2, k, dy FROM ok JOIN resp ON resp.t = ok.t",
    "bs": "SELECT k, avg(v) AS mv, avg(c1) AS m1, avg(c2) AS m2, (var_pop(c2)*covar_pop(v, c1) - covar_pop(c1, c2)*covar_pop(v, c2)) / (var_pop(c1)*var_pop(c2) - pow(covar_pop(c1, c2), 2)) AS b1, (var_pop(c1)*covar_pop(v, c2) - covar_pop(c1, c2)*covar_pop(v, c1)) / (var_pop(c1)*var_pop(c2) - pow(covar_pop(c1, c2), 2)) AS b2 FROM vs GROUP BY k",
    "es": "SELECT t, date, k, v - mv - b1*(c1 - m1) - b2*(c2 - m2) AS e FROM vs JOIN bs USING (k)",
    "xz": "SELECT a.t, a.e AS x, b.e AS z FROM es a JOIN es b USING (t) WHERE a.k = -2 AND b.k = -1",
    "yz": "SELECT es.t, es.date, es.k, es.e AS yr, x, z, avg(z*es.e) OVER (PARTITION BY es.k) AS zy, avg(z*x) OVER (PARTITION BY es.k) AS q FROM es JOIN xz ON xz.t = es.t WHERE es.k >= 0",
}


@query(sql(f"SELECT t, date, (k // 5)::BIGINT AS h, (k % 5)::BIGINT AS j, k::BIGINT AS k, {r('z*yr/q - z*x*zy/(q*q)', 'psi', 4)}, {r('z*yr/q', 'psi_rf', 4)}, {r('-z*x*zy/(q*q)', 'psi_fs', 4)} FROM yz", **_IC), digits=4)
def iv_scores_two_controls(spark, sf):
    """Scores on a constant, the control and its last value."""
    over = Window.partitionBy("variant").orderBy("t")
    two = [F.lit(1.0), F.col("control"), F.lag("control", 1).over(over)]
    return scores.iv_scores_on(panel(spark, sf), OUTCOMES, "shock", "instrument", two, over, HORIZON).drop("variant")


@query(digits=4)
def iv_scores_full(spark, sf):
    """Scores on the full set of controls."""
    over = Window.partitionBy("variant").orderBy("t")
    every = scores.control_set(OUTCOMES, "shock", "control", LAG, over)
    return scores.iv_scores_on(panel(spark, sf), OUTCOMES, "shock", "instrument", every, over, HORIZON).drop("variant")
