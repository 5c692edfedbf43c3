"""Every registered query outside the corpus operators against its SQL, and the invariants of the dense ones."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def canonical(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (float, np.floating)):
            return f"{v + 0.0:.8g}"
        return str(v).replace(" 00:00:00", "")

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, db, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = db.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def rows(spark, sf, name):
    return registry.queries()[name](spark, sf).toPandas()


def test_mean_tau_is_one_under_balanced_weights(spark, sf):
    w = rows(spark, sf, "resolvent_weights")
    assert np.allclose(w.groupby("s")["w"].sum(), 1, atol=1e-4) and np.allclose(w.groupby("t")["w"].sum(), 1, atol=1e-4)
    assert abs(registry.flagship(spark, sf).toPandas()["tau"].mean() - 1) < 1e-4


def test_certificates_hold_and_fall_with_rank(spark, sf):
    c = rows(spark, sf, "ritz_certificate")
    assert (c["error"] <= c["bound"] + 1e-5).all() and c["stress"].between(0, 1).all()
    kept = c.groupby("r")["retained"].mean()
    assert kept.is_monotonic_increasing


def test_spectrum_gives_the_stress(spark, sf):
    s, c = rows(spark, sf, "stress_spectrum"), rows(spark, sf, "ritz_certificate")
    stress = (s["q"] * s["a"] / (1 + s["a"])).groupby(s["s"]).sum()
    exact = c[c["r"] == c["r"].max()].set_index("s")["stress"]
    assert np.allclose(stress, exact.loc[stress.index], atol=1e-3)


def test_nested_models_agree_with_the_constant_one_at_no_decay(spark, sf):
    from strandline.operators import kernels
    from strandline.plans.dense import vectors

    s = kernels.nested_scores(vectors(spark, sf), 50, None, None, 40).toPandas().pivot(index="t", columns="model", values="score")
    for m in ("M1", "M2", "M3"):
        assert np.allclose(s[m], s["M0"])


def test_spaced_months_are_apart(spark, sf):
    t = np.sort(rows(spark, sf, "spaced_top_months")["t"].to_numpy())
    assert len(t) == 6 and (np.diff(t) >= 6).all()


def test_every_rows_only_query_gives_finite_rows(spark, sf):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        df = rows(spark, sf, name)
        assert len(df) > 0, name
        for c in df.select_dtypes("number"):
            if c != "rank_05":
                assert np.isfinite(df[c].dropna()).all() and df[c].notna().all(), (name, c)


def test_bands_contain_the_path(spark, sf):
    b, p = rows(spark, sf, "bootstrap_tau_band").set_index("s"), rows(spark, sf, "tau_soft_resolvent").set_index("t")
    p = p.loc[b.index]
    assert ((b["lo"] <= p["tau"] + 1e-5) & (p["tau"] <= b["hi"] + 1e-5)).all()


def test_model_checks_pass_and_resolved_draws_hold_the_centre(spark, sf):
    c = rows(spark, sf, "model_checks")
    assert len(c) == 11 and c["passed"].all(), c
    band = rows(spark, sf, "bootstrap_resolved_band")
    assert (band["lo"] <= band["mid"]).all() and (band["mid"] <= band["hi"]).all() and (band["lo"] >= 0).all()
    a = rows(spark, sf, "log_alpha_search")
    assert a["chosen"].sum() == 1 and a.loc[a["chosen"], "score"].iloc[0] == a["score"].max()
    path = rows(spark, sf, "log_rank_path")
    assert (path["tau"] > 0).all() and abs(path["tau"].mean() - 1) < 1e-4
