"""A made-up score table for smoke runs: asked for by name, never a silent stand-in for missing data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def synthetic_scores(spark: SparkSession, months: int, width: int, horizon: int, seed: int, variants: int = 1) -> DataFrame:
    """(variant, t, date, h, j, k, psi) with a volatility burst in the middle; a variant's rows depend on (seed, variant)."""

    def make(batches):
        for pdf in batches:
            for v in pdf["id"]:
                rng = np.random.default_rng([seed, int(v)])
                n, p = months, width * (horizon + 1)
                scale = 1 + 2 * np.exp(-((np.arange(n) - n / 2) ** 2) / (0.02 * n * n))
                decay = np.exp(-np.repeat(np.arange(horizon + 1), width) / (horizon + 1))
                psi = rng.standard_normal((n, p)) * scale[:, None] * decay
                k = np.tile(np.arange(p), n)
                date = (np.datetime64("2000-01") + np.repeat(np.arange(n), p)).astype("datetime64[D]").astype(object)
                yield type(pdf)({"variant": f"synthetic_{v}", "t": np.repeat(np.arange(n), p), "date": date, "h": k // width, "j": k % width, "k": k, "psi": psi.ravel()})

    return spark.range(variants).mapInPandas(make, "variant string, t long, date date, h int, j int, k int, psi double")
