"""Queries whose kernels are dense linear algebra: checked by invariants and brute force in the tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compare, graph, kernels, scores
from ..session import settled
from .base import HORIZON, LAG, OUTCOMES, WIDTH, panel, psi, query
from .paths import _vectors


def design(spark, sf):
    return scores.design(panel(spark, sf), OUTCOMES, "shock", "control", HORIZON, LAG)


def full_psi(spark, sf):
    return kernels.ridge_scores(design(spark, sf), HORIZON, WIDTH)


def vectors(spark, sf):
    return kernels.score_vectors(full_psi(spark, sf))


@query()
def full_scores(spark, sf):
    """Ridge-residualised scores on the full control set."""
    return full_psi(spark, sf).drop("variant")


@query()
def smoothed_scores(spark, sf):
    return kernels.smoothed_scores(psi(spark, sf), 0.5).drop("variant")


@query()
def tau_soft_resolvent(spark, sf):
    """The flagship: amplification of every month under graph-resolvent weights."""
    return kernels.tau_resolvent(vectors(spark, sf))


@query()
def resolvent_weights(spark, sf):
    return kernels.resolvent_kernel(vectors(spark, sf)).drop("variant")


@query()
def resolvent_weights_plain(spark, sf):
    """Without the balancing to row and column sums of one."""
    return kernels.resolvent_kernel(vectors(spark, sf), balance=False).drop("variant")


@query()
def reference_geometry(spark, sf):
    return kernels.reference_summary(vectors(spark, sf))


@query()
def hac_target(spark, sf):
    return kernels.hac_target(vectors(spark, sf), 6).drop("variant")


@query()
def volterra_target(spark, sf):
    return kernels.volterra_target(vectors(spark, sf)).drop("variant")


@query()
def target_top_months(spark, sf):
    """The ten largest months of each target, in one table."""
    v = vectors(spark, sf)
    frames = {"diagonal": kernels.tau_resolvent(v), "hac": kernels.hac_target(v, 6), "volterra": kernels.volterra_target(v)}
    every = compare.union_named({k: f.select("t", F.col("tau").alias("x")) for k, f in frames.items()}, "target")
    return compare.top(every, "x", ["target"], 10)


@query()
def basis_energy(spark, sf):
    """Energy of the leading eigenvectors by outcome, with each basis vector's peak horizon."""
    b = kernels.basis_energy(vectors(spark, sf), 3, WIDTH)
    e = b.groupBy("basis", "j").agg(F.sum(F.col("v") * F.col("v")).alias("energy"))
    peak = b.groupBy("basis", "h").agg(F.sum(F.col("v") * F.col("v")).alias("e")).groupBy("basis").agg(F.min_by("h", F.struct(-F.col("e"), F.col("h"))).alias("peak_h"))
    return e.withColumn("dominant", F.row_number().over(Window.partitionBy("basis").orderBy(F.col("energy").desc(), "j")) == 1).join(peak, "basis")


@query()
def subspace_angles(spark, sf):
    return kernels.subspace_angles(vectors(spark, sf), 3).drop("variant")


@query()
def stress_spectrum(spark, sf):
    return kernels.stress_spectrum(vectors(spark, sf)).drop("variant")


@query()
def yosida_stress(spark, sf):
    """Stress and shape curves over a grid from the emitted spectrum."""
    s = kernels.stress_spectrum(vectors(spark, sf))
    a = graph.stress_curve(s, [0.1, 1.0, 10.0]).withColumnRenamed("stress", "level")
    b = graph.stress_curve(s, [0.1, 1.0, 10.0], True).select("variant", "s", "lam", F.col("stress").alias("shape"))
    return a.join(b, ["variant", "s", "lam"]).drop("variant")


@query()
def ritz_certificate(spark, sf):
    return kernels.ritz_certificate(vectors(spark, sf), (2, 5, 10)).drop("variant")


@query()
def ritz_rank_curve(spark, sf):
    return graph.rank_curve(kernels.ritz_certificate(vectors(spark, sf), (1, 2, 3, 5, 8, 12))).drop("variant")


@query()
def ritz_certified_rank(spark, sf):
    curve = graph.rank_curve(kernels.ritz_certificate(vectors(spark, sf), (1, 2, 3, 5, 8, 12, 20)))
    return graph.certified_rank(curve, 0.10).join(graph.certified_rank(curve, 0.05).withColumnRenamed("certified_rank", "rank_05"), "variant", "left")


@query()
def interval_spectrum(spark, sf):
    return kernels.interval_spectrum(vectors(spark, sf), (1.2, 2.0)).drop("variant")


@query()
def eta_grid(spark, sf):
    return kernels.eta_grid(vectors(spark, sf), points=13).drop("variant")


def half_life_grid(v):
    """(setting, kind, half_life, score, best): mean validation score of each candidate; a grid of four settings."""
    grid = {f"{kind}_{h:g}": kernels.nested_scores(v, 45, h if kind == "mean" else None, h if kind == "cov" else None, 40).filter(F.col("model") == ("M2" if kind == "mean" else "M1")) for kind in ("mean", "cov") for h in (6.0, 24.0)}
    every = compare.union_named(grid, "setting").groupBy("setting").agg(F.avg("score").alias("score"))
    kind = F.substring_index("setting", "_", 1)
    every = every.withColumn("kind", kind).withColumn("half_life", F.substring_index("setting", "_", -1).cast("double"))
    return every.withColumn("best", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("score").desc(), "setting")) == 1)


def nested(v, estimator: str = "ledoit_wolf", floor: float = 1e-8, tuned: tuple[float, float] | None = None):
    """Scores of the four models under the half-lives of mean and covariance that validation chooses."""
    mean, cov = tuned or chosen_half_lives(v)
    return kernels.nested_scores(v, 50, mean, cov, 40, estimator, floor)


def chosen_half_lives(v) -> tuple[float, float]:
    best = {r.kind: r.half_life for r in half_life_grid(v).filter("best").collect()}  # two rows
    return best["mean"], best["cov"]


@query()
def nested_log_scores(spark, sf):
    return nested(settled(vectors(spark, sf))).drop("variant")


@query()
def nested_pair_summary(spark, sf):
    s = nested(settled(vectors(spark, sf)))
    return compare.pair_summary(compare.pair_differences(s, [("M1", "M0"), ("M2", "M0"), ("M3", "M0"), ("M3", "M1"), ("M3", "M2"), ("M2", "M1")]))


@query()
def nested_half_life_tuning(spark, sf):
    """Mean validation score over a grid of half-lives, as rows, and the best of each kind."""
    return half_life_grid(settled(vectors(spark, sf))).select("setting", "score", "best")


@query()
def kalman_rank_path(spark, sf):
    return kernels.robust_smoother(vectors(spark, sf)).drop("variant")


@query()
def state_draw_bands(spark, sf):
    from ..operators.resample import pointwise_band

    return pointwise_band(kernels.state_draws(vectors(spark, sf), 32)).drop("variant")


@query()
def bootstrap_tau_band(spark, sf):
    """Simultaneous band of the flagship path from seeded block draws."""
    from ..operators.resample import simultaneous_band

    v = vectors(spark, sf)
    centre = kernels.tau_resolvent(v).select("variant", F.col("t").alias("s"), "tau")
    return simultaneous_band(kernels.bootstrap_tau(v, 128, 6, 17), centre).drop("variant")


@query()
def laplacian_eigs(spark, sf):
    return graph.laplacian_eigen(graph.density_normalised(graph.affinities(graph.knn_edges(_vectors(spark, sf), 8), 8), 0.5), 5)


@query()
def graph_ridge_grid(spark, sf):
    """Cross-validation of ridge on Laplacian eigenfunctions over penalties, and each block's choice."""
    v = _vectors(spark, sf)
    eig = graph.laplacian_eigen(graph.density_normalised(graph.affinities(graph.knn_edges(v, 8), 8), 0.5), 6)
    targets = v.select("block", F.col("id").alias("i"), F.element_at("v", 1).alias("y"))
    g = graph.ridge_grid(eig, targets, [0.01, 0.1, 1.0], 4)
    return g.withColumn("chosen", F.row_number().over(Window.partitionBy("block").orderBy("cv_error", "lam")) == 1)


@query()
def local_gradients(spark, sf):
    v = _vectors(spark, sf)
    aff = graph.affinities(graph.knn_edges(v, 8), 8)
    return graph.local_gradients(v, aff, v.select("block", F.col("id").alias("i"), F.element_at("v", 1).alias("y")))
