"""Linear algebra, kernels, sources, sinks and streams on small cases."""

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import la, scalars
from strandline.operators import calendar, compare, filters, graph, kernels, moments, resample
from strandline.sources import scan, sinks
from strandline.streaming import rollup


def test_spectral_kit_round_trips():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, 6))
    a = x.T @ x + np.eye(6)
    assert np.allclose(la.spd_exp(la.spd_log(a)), a) and np.allclose(la.spd_sqrt(a) @ la.spd_sqrt(a), a)
    assert np.allclose(la.from_half_vec(la.half_vec(a), 6), a)
    values, v = la.psd_eigen(a)
    assert (np.diff(values) <= 0).all() and np.allclose(v * values @ v.T, a)
    assert (v[np.abs(v).argmax(axis=0), np.arange(6)] > 0).all()
    with pytest.raises(ValueError):
        la.psd_eigen(np.diag([1.0, -0.5]))


def test_lyapunov_and_generalised_eigen():
    rng = np.random.default_rng(1)
    f, q = 0.4 * rng.standard_normal((4, 4)) / 2, np.eye(4)
    p = la.stationary_cov(f, q)
    assert np.allclose(p, f @ p @ f.T + q)
    x = rng.standard_normal((20, 5))
    k, d = x.T @ x, np.diag(rng.uniform(1, 2, 5))
    values, v, worst = la.generalised_above(k, d, 5.0)
    assert worst < 1e-8 and np.allclose(v.T @ d @ v, np.eye(len(values))) and (values >= 5).all()
    assert len(values) == (np.linalg.eigvals(np.linalg.solve(d, k)).real >= 5).sum()


def test_ledoit_wolf_formula_by_loops():
    x = np.random.default_rng(2).standard_normal((12, 4))
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n**2 / p)
    got, shrink = la.ledoit_wolf(x)
    assert np.isclose(shrink, b2 / d2) and np.allclose(got, (1 - shrink) * s + shrink * mu * np.eye(p))


def test_matching_is_exhaustive_best():
    import itertools

    rng = np.random.default_rng(3)
    a, b = np.linalg.qr(rng.standard_normal((8, 4)))[0], np.linalg.qr(rng.standard_normal((8, 4)))[0]
    order, _ = la.match_columns(a, b)
    o = np.abs(a.T @ b)
    assert np.isclose(o[range(4), order].sum(), max(o[range(4), list(p)].sum() for p in itertools.permutations(range(4))))


def test_trace_shortcut_equals_full_operators():
    rng = np.random.default_rng(4)
    psi = rng.standard_normal((24, 5))
    w = la.resolvent_weights(np.arange(24), 0.08)
    assert np.allclose(w.sum(axis=0), 1) and np.allclose(w, w.T)
    c, rho, d, d_rho = la.reference(psi)
    tau = la.tau_from_scores(psi, w)
    for s in range(24):
        k = (psi * w[s][:, None]).T @ psi
        assert np.isclose(np.trace(np.linalg.solve(d, k)) / d_rho, tau[s])
    assert np.isclose(tau.mean(), 1)


def test_spline_lowers_roughness_and_keeps_lines():
    y = np.random.default_rng(5).standard_normal((3, 20))
    rough = lambda z: (np.diff(z, 2) ** 2).sum()
    assert rough(la.smoothing_spline(y, 2.0)) < 0.3 * rough(y)
    line = np.arange(20.0)[None] * 2 + 1
    assert np.allclose(la.smoothing_spline(line, 5.0), line)


def test_smoother_follows_a_level_shift():
    rng = np.random.default_rng(6)
    level = np.r_[np.zeros(60), np.ones(60)]
    y = np.column_stack([level + 0.3 * rng.standard_normal(120), rng.standard_normal(120)])
    x = kernels.em_smooth(y, 4, 7.0, 1).xs
    assert x[80:, 0].mean() - x[:40, 0].mean() > 0.6 and ((x[:, 0] - level) ** 2).mean() < ((y[:, 0] - level) ** 2).mean()


def joint_law(n, mu, f, q, r):
    """Mean and covariance of all states and of all observations, built entry by entry."""
    p = len(mu)
    v = [la.stationary_cov(f, q)]
    for _ in range(n - 1):
        v.append(f @ v[-1] @ f.T + q)
    c = np.zeros((n * p, n * p))
    for i in range(n):
        for j in range(i, n):
            c[j * p : (j + 1) * p, i * p : (i + 1) * p] = np.linalg.matrix_power(f, j - i) @ v[i]
            c[i * p : (i + 1) * p, j * p : (j + 1) * p] = c[j * p : (j + 1) * p, i * p : (i + 1) * p].T
    return c, c + np.kron(np.eye(n), r)


def test_smoother_and_draws_match_gaussian_conditioning():
    rng = np.random.default_rng(3)
    n, p, mu = 7, 2, np.array([1.0, -2.0])
    f, q, r = np.array([[0.8, 0.1], [0.0, 0.5]]), np.array([[1.0, 0.3], [0.3, 0.6]]), np.array([[0.5, 0.1], [0.1, 0.9]])
    y = rng.standard_normal((n, p)) * 2 + mu
    m = kernels.smooth(y, mu, f, q, r, None)
    c, s = joint_law(n, mu, f, q, r)
    gain = np.linalg.solve(s, c).T
    mean = (gain @ (y - mu).ravel()).reshape(n, p) + mu
    cov = c - gain @ c
    assert np.allclose(m.xs, mean) and all(np.allclose(m.ps[i], cov[p * i : p * i + p, p * i : p * i + p]) for i in range(n))
    sign, logdet = np.linalg.slogdet(s)
    d = (y - mu).ravel()
    assert np.isclose(m.gaussian, -0.5 * (n * p * np.log(2 * np.pi) + logdet + d @ np.linalg.solve(s, d)))
    draw = kernels.backward_sampler(m)
    some = np.stack([draw(rng).ravel() for _ in range(20_000)])
    assert np.abs(some.mean(axis=0) - mean.ravel()).max() < 0.05
    assert np.abs(np.cov(some.T) - cov).max() < 0.05  # with the covariances between months


def test_transition_shrinks_between_the_blocks_only():
    f = np.array([[0.5, 0.2, 0.4], [0.1, 0.3, 0.2], [0.2, 0.4, 0.1]])
    got = kernels.shrunk_transition(f, 2)
    want = np.array([[0.5, 0.18, 0.054], [0.09, 0.3, 0.027], [0.027, 0.054, 0.1]])
    assert np.allclose(got, want)
    assert np.isclose(np.abs(np.linalg.eigvals(kernels.shrunk_transition(10 * f, 2))).max(), 0.965)


def test_log_states_invert_log_observations():
    z = np.random.default_rng(2).standard_normal((40, 2))
    a = kernels.log_states(kernels.log_observations(z, 0.2), 2)
    want = 0.8 * z[:, :, None] * z[:, None, :] + 0.2 * np.eye(2)
    assert np.allclose(a, kernels.mean_identity(want)) and np.allclose(a.mean(axis=0), np.eye(2))


def test_volterra_features_by_double_sums():
    x = np.random.default_rng(7).standard_normal((15, 2))
    f = kernels.volterra_features(x, (3.0,), 2)
    a = 2 ** (-1 / 3)
    h1 = np.array([sum(a ** (t - s) * x[s] for s in range(t + 1)) for t in range(15)])
    h2 = np.array([sum(a ** (t - s) * np.outer(h1[s - 1], x[s]) * a for s in range(1, t + 1)) if t else np.zeros((2, 2)) for t in range(15)])
    assert np.allclose(f, kernels.zscore(np.concatenate([h1, h2.reshape(15, 4)], axis=1)))


def series(spark, values, **extra):
    return spark.createDataFrame([("v", t, float(x)) for t, x in enumerate(values)], "variant string, t long, x double")


def test_no_look_ahead(spark):
    a = series(spark, [1, 2, 3, 4, 5, 6])
    b = series(spark, [1, 2, 3, 99, 99, 99])
    for f in (lambda d: filters.ewma(d, "x", ["variant"], 2.0), lambda d: filters.exponential(d, "x", ["variant"], 2.0)):
        x, y = (f(d).filter("t <= 2").orderBy("t").drop("variant").collect() for d in (a, b))
        assert np.allclose(np.array(x, float), np.array(y, float))  # the order of summing may differ
    m, got = 0.0, {r.t: r for r in filters.ewma(a, "x", ["variant"], 2.0).collect()}
    for t, x in enumerate([1, 2, 3, 4, 5, 6]):
        assert np.isclose(got[t].before, m)
        m = 0.5**0.5 * m + (1 - 0.5**0.5) * x
        assert np.isclose(got[t].after, m)
    assert all(r.after == 0 for r in filters.ewma(a, "x", ["variant"], None).collect())


def test_bartlett_modes(spark):
    d = series(spark, [1, 2, 3])
    by = lambda mode: [r.filtered for r in filters.bartlett(d, "x", ["variant"], 1, mode).orderBy("t").collect()]
    assert np.allclose(by("drop"), [3 / 2**0.5, 5 / 2**0.5]) and np.allclose(by("zero")[0], 1 / 2**0.5) and np.allclose(by("available")[0], 1)


def test_ties_and_percentile_ranks(spark):
    d = series(spark, [5, 1, 5, 2])
    got = {r.t: r.pct for r in filters.percentile_rank(d, "x", ["variant"]).collect()}
    assert got == {0: 3.5 / 4, 2: 3.5 / 4, 1: 0.25, 3: 0.5}
    assert [r.t for r in compare.top(d, "x", ["variant"], 2).orderBy("rank").collect()] == [0, 2]


def test_kernel_without_mass_keeps_to_itself(spark):
    places = spark.createDataFrame([("v", 0), ("v", 50)], "variant string, t long")
    for kind in ("bartlett", "boxcar", "identity"):
        w = {(r.s, r.t): r.w for r in moments.kernel(places, kind, 3).collect()}
        assert w == {(0, 0): 1.0, (50, 50): 1.0}
    with pytest.raises(ValueError):
        moments.kernel(places, "other", 1)


def test_episode_probability_of_a_spike(spark):
    draws = spark.createDataFrame([("v", d, s, 5.0 if s == 7 else 1.0) for d in range(5) for s in range(24)], "variant string, draw long, s long, tau double")
    windows = spark.createDataFrame([("spike", 6, 8), ("calm", 10, 20)], "episode string, lo long, hi long")
    assert {r.episode: r.prob_peak for r in resample.episode_probability(draws, windows).collect()} == {"spike": 1.0, "calm": 0.0}


def test_seeded_blocks_repeat_and_are_circular(spark):
    a, b = (resample.seeded_blocks(spark, 20, 6, 3, 5).orderBy("draw", "pos").collect() for _ in range(2))
    assert a == b and len(a) == 60
    for x, y in zip(a, a[1:]):
        if x.draw == y.draw and y.pos % 6:
            assert y.t == (x.t + 1) % 20


def test_graph_defaults():
    assert graph.default_k(16) == 10 and graph.default_k(400) == 20 and graph.default_k(10**6) == 30 and graph.k_candidates(400) == [15, 20, 25]


def test_csv_dialects_and_nan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("observation_date,MICH\n1990-01-01,3.5\n1990-02-01,.\n1990-03-15,NaN\n1990-01-20,4\n")
    got = {str(r.date): r.mich for r in scan.read_series(spark, str(tmp_path / "a.csv"), "MICH", "mich").collect()}
    assert got == {"1990-01-01": 4.0, "1990-02-01": None, "1990-03-01": None}
    df = scan.read_csv(spark, str(tmp_path / "a.csv"), "observation_date string, MICH double")
    assert df.filter("MICH IS NULL").count() == 2
    with pytest.raises(scan.MissingColumns, match="date column"):
        scan.read_series(spark, str(tmp_path / "a.csv"), "CPI", "cpi")
    with pytest.raises(scan.MissingColumns, match="nope"):
        scan.require(df, ["nope"], "table")
    (tmp_path / "empty.csv").write_text("date,x\n")
    assert scan.read_series(spark, str(tmp_path / "empty.csv"), "x", "x").count() == 0


def workbook(rows) -> bytes:
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="s"><v>{v}</v></c>' if isinstance(v, int) and v >= 0 else f'<c r="{chr(65 + c)}{r}"><v>{-v}</v></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Year</t></si><si><r><t>CP</t></r><r><t>I10</t></r></si><si><t>note</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_cells_and_header_search(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook([[2], [0, None, 1], [-1990.0, None, -2.5], [-1991.0]]))
    rows = scan.read_workbook(spark, str(tmp_path / "w.xlsx"))
    assert [r.cells for r in rows.orderBy("row").collect()][1:3] == [["Year", None, "CPI10"], ["1990.0", None, "2.5"]]
    got = scan.workbook_table(rows, ["year", "cpi10"]).orderBy("row").collect()
    assert [(r.year, r.cpi10) for r in got] == [("1990.0", "2.5"), ("1991.0", None)]
    assert scan.column_index("A1") == 0 and scan.column_index("AB7") == 27
    assert scan.choose_column(["date", "MPS_orth", "policy surprise"]) == "policy surprise"
    with pytest.raises(scan.MissingColumns):
        scan.choose_column(["year", "other"])


def test_serial_dates(spark):
    d = spark.createDataFrame([("35000",), ("1995-10-28",), ("x",)], "d string")
    assert [str(r[0]) for r in d.select(scan.date_or_serial("d")).collect()] == ["1995-10-28", "1995-10-28", "None"]


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/x.csv", "a\n1\n")
    assert scan.extract_archive(spark, str(tmp_path / "a.zip"), ["x.csv"]).collect()[0].name == "data/x.csv"
    with pytest.raises(Exception, match="missing members"):
        scan.extract_archive(spark, str(tmp_path / "a.zip"), ["y.csv"]).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k int, x double")
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_table(df, str(tmp_path / "pq"), ["k"])
    sinks.write_json(df, str(tmp_path / "js"))
    assert scan.read_csv(spark, str(tmp_path / "csv"), "k int, x double").count() == spark.read.parquet(str(tmp_path / "pq")).count() == spark.read.json(str(tmp_path / "js")).count() == 2
    assert sinks.as_json(df).filter(F.col("json") == '{"k":1,"x":2.0}').count() == 1
    m = sinks.manifest(spark, str(tmp_path / "csv")).collect()
    assert any(r.file.startswith("part-") and len(r.sha256) == 64 for r in m)
    assert scan.read_path_table(spark, str(tmp_path / "pq"), {"x": "tau"}, ["tau", "k"]).columns == ["tau", "k"]


def test_gap_months_are_not_scored_as_neighbours(spark):
    d = spark.createDataFrame([("v", pd.Timestamp(f"2000-{m:02d}-01").date(), 1.0) for m in (1, 2, 4)], "variant string, date date, x double")
    full = calendar.complete_months(d, by=["variant"]).orderBy("date").collect()
    assert [r.x for r in full] == [1.0, 1.0, None, 1.0]
    assert calendar.complete_months(d.limit(0), by=["variant"]).count() == 0


def test_scalars(spark):
    d = spark.createDataFrame([("A - b!!", -0.0, float("nan"))], "s string, z double, n double")
    r = d.select(scalars.slug("s"), scalars.plain_zero("z"), scalars.null_if_nan("n"), scalars.log100("z"), scalars.half_life_label(F.lit(None).cast("double"))).collect()[0]
    assert r[0] == "a_b" and str(r[1]) == "0.0" and r[2] is None and r[3] is None and r[4] == "inf"


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=5 * i)).to_pydatetime(), "ab"[i % 2], float(i) if i % 3 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, kind string, value double")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = rollup.windowed_rollup(stream, "ts", "kind", "value").writeStream.outputMode("complete").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("rolled").collect())) == sorted(map(str, rollup.windowed_rollup(df, "ts", "kind", "value").collect()))


def test_stateful_mean_spans_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    values = [(0, "a", 4.0), (1, "a", None), (2, "a", 8.0), (3, "b", 1.0)]
    for i in (0, 2):
        spark.createDataFrame(values[i : i + 2], "o long, k string, x double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("o long, k string, x double").option("maxFilesPerTrigger", 1).parquet(src)
    q = rollup.causal_mean(stream, "k", "o", "x", 1.0).writeStream.outputMode("update").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    last = {r.k: (r.n, r.mean) for r in spark.table("means").orderBy("n").collect()}
    assert last == {"a": (2, 5.0), "b": (1, 0.5)}


def test_first_existing_and_resolve(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text("1")
    folders = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert scan.resolve(spark, ["y.csv", "x.csv"], folders, "NO_SUCH_VARIABLE") == folders[1] + "/x.csv"
    assert scan.resolve(spark, ["z.csv"], folders) is None
    monkeypatch.setenv("MY_SOURCE", str(tmp_path / "a"))
    assert scan.resolve(spark, ["x.csv"], folders, "MY_SOURCE") == folders[0]
    monkeypatch.setenv("MY_SOURCE", str(tmp_path / "gone"))
    with pytest.raises(FileNotFoundError):
        scan.resolve(spark, ["x.csv"], folders, "MY_SOURCE")


def test_arrays_of_npz_files(spark, tmp_path):
    a, b = np.arange(12.0).reshape(3, 2, 2), np.array([1, 2])
    np.savez(tmp_path / "x.npz", a=a, b=b)
    got = {(r.name, r.row): (r.shape, r["values"]) for r in scan.read_arrays(spark, str(tmp_path / "x.npz")).collect()}
    assert got["a", 1] == ([3, 2, 2], [4.0, 5.0, 6.0, 7.0]) and got["b", 1] == ([2], [2.0]) and len(got) == 5


def test_surprises_by_month(spark):
    rows = spark.createDataFrame([("2020-03-03", "0.5", "1"), ("2020-03-15", "0.25", "2"), ("43952", "-1", "3"), ("x", "9", "4"), ("2020-03-20", None, "5")], "meeting_date string, mp_surprise string, information_component string")
    got = {str(r.date): (r.value, r.n) for r in scan.surprises_by_month(rows).collect()}
    assert got == {"2020-03-01": (0.75, 2), "2020-05-01": (-1.0, 1)}
    with pytest.raises(scan.MissingColumns):
        scan.surprises_by_month(rows.drop("meeting_date"))


def test_best_sheet():
    content = workbook([[2], [0, None, 1]])
    assert scan.best_sheet(content, ["year", "cpi10"]) == 0
    with pytest.raises(scan.MissingColumns):
        scan.best_sheet(content, ["nothing"])


def test_command_line(spark, sf, tmp_path, capsys):
    from strandline.__main__ import main

    assert main(["list"]) == 0 and "tau_soft_resolvent" in capsys.readouterr().out
    assert main(["run", "nothing", "--data", sf]) == 2
    assert main(["run", "month_keys", "--data", sf, "--out", str(tmp_path / "out"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() > 0
