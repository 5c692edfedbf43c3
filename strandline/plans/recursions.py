"""Decaying covariances and signatures of paths, by scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters, scans
from .base import OUTCOMES, panel, psi, query, r, sql

_TRAIN, _MEAN, _COV = 24, 12, 6

_EC = {
    "em": f"SELECT a.t, a.k, any_value(a.psi) - coalesce((1 - pow(0.5, 1.0/{_MEAN})) * sum(pow(0.5, (a.t - 1 - b.t) / {_MEAN}.0) * b.psi), 0) AS e FROM psi a LEFT JOIN psi b ON a.k = b.k AND b.t < a.t GROUP BY a.t, a.k",
    "ee": "SELECT t, x.k AS i, y.k AS j, x.e * y.e AS p FROM em x JOIN em y USING (t) WHERE x.k <= y.k",
    "st": f"SELECT min(t) + {_TRAIN} AS start FROM psi",
    "ef": "SELECT i, j, avg(p) AS first FROM ee, st WHERE t < start GROUP BY i, j",
    "es": f"SELECT a.t, a.i, a.j, (1 - pow(0.5, 1.0/{_COV})) * sum(pow(0.5, (a.t - b.t) / {_COV}.0) * b.p) AS after, (1 - pow(0.5, 1.0/{_COV})) * coalesce(sum(pow(0.5, (a.t - 1 - b.t) / {_COV}.0) * b.p) FILTER (b.t < a.t), 0) AS before FROM ee a JOIN ee b ON a.i = b.i AND a.j = b.j AND b.t <= a.t, st WHERE a.t >= start AND b.t >= start GROUP BY a.t, a.i, a.j",
}


@query(sql(f"SELECT t, i, j, {r(f'pow(0.5, (t - start) / {_COV}.0) * first + before', 'before', 3)}, {r(f'pow(0.5, (t - start + 1) / {_COV}.0) * first + after', 'after', 3)} FROM es JOIN ef USING (i, j), st", **_EC), digits=3)
def ewma_covariance(spark, sf):
    """Forecast covariances of all coordinates, from a training span on."""
    p = psi(spark, sf).select("t", "k", "psi")
    start = p.agg(F.min("t")).first()[0] + _TRAIN
    return scans.ewma_covariance(p, "psi", [], _MEAN, _COV, start)


_SG = {
    "sz": "SELECT t, j AS k, coalesce((y - avg(y) OVER (PARTITION BY j)) / stddev_pop(y) OVER (PARTITION BY j), 0) AS x FROM y",
    "hl": "SELECT unnest([3.0, 12.0]) AS hl",
    "s1": "SELECT hl, a.t, a.k, any_value(a.x) AS x, sum(pow(0.5, (a.t - b.t) / hl) * b.x) AS v FROM hl, sz a JOIN sz b ON a.k = b.k AND b.t <= a.t GROUP BY hl, a.t, a.k",
    "u2": "SELECT hl, t, s1.k AS i, sz.k AS j, (v - s1.x) * sz.x AS u FROM s1 JOIN sz USING (t)",
    "s2": "SELECT a.hl, a.t, a.i, a.j, any_value(a.u) AS u, sum(pow(0.5, (a.t - b.t) / a.hl) * b.u) AS v FROM u2 a JOIN u2 b ON a.hl = b.hl AND a.i = b.i AND a.j = b.j AND b.t <= a.t GROUP BY a.hl, a.t, a.i, a.j",
    "u3": "SELECT hl, t, i, j, sz.k AS l, (v - u) * sz.x AS u FROM s2 JOIN sz USING (t)",
    "s3": "SELECT a.hl, a.t, a.i, a.j, a.l, sum(pow(0.5, (a.t - b.t) / a.hl) * b.u) AS v FROM u3 a JOIN u3 b ON a.hl = b.hl AND a.i = b.i AND a.j = b.j AND a.l = b.l AND b.t <= a.t GROUP BY a.hl, a.t, a.i, a.j, a.l",
    "sall": "SELECT hl, 1 AS level, t, k AS i, NULL AS j, NULL AS l, v FROM s1 UNION ALL SELECT hl, 2, t, i, j, NULL, v FROM s2 UNION ALL SELECT hl, 3, t, i, j, l, v FROM s3",
}


@query(sql(f"SELECT t, hl::DOUBLE AS half_life, level::BIGINT AS level, i::BIGINT AS i, coalesce(j, -1)::BIGINT AS j, coalesce(l, -1)::BIGINT AS l, {r('v', 'filtered')} FROM sall", **_SG))
def signature_levels(spark, sf):
    """Signature of the standardised path of all outcomes, levels 1 to 3, at two half-lives; -1 where a level has no index."""
    long = panel(spark, sf).select("t", F.posexplode(F.array(*OUTCOMES)).alias("k", "y"))
    own = Window.partitionBy("k")
    path = long.select("t", "k", F.coalesce((F.col("y") - F.avg("y").over(own)) / F.stddev_pop("y").over(own), F.lit(0.0)).alias("x"))
    out = scans.signature(path, "x", [], [3.0, 12.0])
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("j", "l")})


@query(sql(f"SELECT k, f.fold, count(*) FILTER (fd.fold = f.fold) AS n_test, {r('avg(psi) FILTER (fd.fold = f.fold)', 'mean_test')}, count(*) FILTER (fd.fold <> f.fold) AS n_train, {r('avg(psi) FILTER (fd.fold <> f.fold)', 'mean_train')}, {r('var_pop(psi) FILTER (fd.fold <> f.fold)', 'var_train', 4)} FROM psi JOIN fd USING (t), (SELECT DISTINCT fold FROM fd) f GROUP BY k, f.fold", fd="SELECT t, (row_number() OVER (ORDER BY t) * 5 - 1) // count(*) OVER () AS fold FROM places"))
def fold_moments(spark, sf):
    """Training moments of each coordinate without each fold, from one pass."""
    p = psi(spark, sf)
    folds = filters.time_folds(p.select("variant", "t").distinct(), ["variant"], 5)
    out = filters.fold_moments(p.join(folds, ["variant", "t"]).select("k", "fold", "psi"), "psi", ["k"])
    return out.withColumn("var_train", F.round("var_train", 4))
