"""Dense kernels: one grouped-map call for each (variant[, draw]), numpy inside, rows out.

A group is one variant's score matrix: its months times its coordinates, a size set by the calendar and not by the
corpus of events below it. Parallelism comes from variants, draws, states and hyper-parameters as rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import la


def score_vectors(scores: DataFrame) -> DataFrame:
    """(variant, t, month, psi array): scores of a month in coordinate order."""
    items = F.array_sort(F.collect_list(F.struct("k", "psi")))
    g = scores.groupBy("variant", "t", "date").agg(items.alias("v"))
    return g.select("variant", "t", (12 * F.year("date") + F.month("date")).alias("month"), F.transform("v", lambda x: x["psi"]).alias("psi"))


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("t")
    return pdf["t"].to_numpy(), pdf["month"].to_numpy(), np.stack(pdf["psi"].to_numpy())


def _grouped(vectors: DataFrame, run, schema: str) -> DataFrame:
    def one(key, pdf):
        out = run(*_matrix(pdf))
        out.insert(0, "variant", key[0])
        return out

    return vectors.groupBy("variant").applyInPandas(one, f"variant string, {schema}")


def ridge_scores(design: DataFrame, horizon: int, width: int, ridge: float = 1e-8) -> DataFrame:
    """Scores by ridge residualisation on many controls. design(variant, t, date, m, controls array, dy array) has one
    row per valid month; controls are z-scored here, except the constant, which comes first."""

    def run(key, pdf):
        pdf = pdf.sort_values("t")
        x = np.stack(pdf["controls"].to_numpy())
        sd = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
        z[:, 0] = 1
        y = np.stack(pdf["dy"].to_numpy())
        both = la.ridge_residual(np.column_stack([pdf["m"].to_numpy(), y]), z, ridge)
        m, yr = both[:, :1], both[:, 1:]
        psi = m * yr / np.mean(m**2)
        n, p = psi.shape
        k = np.tile(np.arange(p), n)
        return pd.DataFrame({"variant": key[0], "t": np.repeat(pdf["t"].to_numpy(), p), "date": np.repeat(pdf["date"].to_numpy(), p), "h": k // width, "j": k % width, "k": k, "psi": psi.ravel()})

    return design.groupBy("variant").applyInPandas(run, "variant string, t long, date date, h int, j int, k int, psi double")


def smoothed_scores(scores: DataFrame, strength: float) -> DataFrame:
    """Scores smoothed over horizons for each month and outcome."""

    def run(key, pdf):
        pdf = pdf.sort_values(["t", "j", "h"])
        n = pdf["h"].nunique()
        pdf["psi"] = la.smoothing_spline(pdf["psi"].to_numpy().reshape(-1, n), strength).ravel()
        return pdf[["variant", "t", "date", "h", "j", "k", "psi"]]

    return scores.select("variant", "t", "date", "h", "j", "k", "psi").groupBy("variant").applyInPandas(run, "variant string, t long, date date, h int, j int, k int, psi double")


def tau_resolvent(vectors: DataFrame, eta: float = 0.08) -> DataFrame:
    """The soft-whitened trace path under graph-resolvent weights, with each state's effective sample size."""

    def run(t, month, psi):
        w = la.resolvent_weights(month, eta)
        return pd.DataFrame({"t": t, "tau": la.tau_from_scores(psi, w), "ess": 1 / (w**2).sum(axis=1)})

    return _grouped(vectors, run, "t long, tau double, ess double")


def resolvent_kernel(vectors: DataFrame, eta: float = 0.08, balance: bool = True) -> DataFrame:
    """The weights w(variant, s, t) themselves."""

    def run(t, month, psi):
        w = la.resolvent_weights(month, eta, balance)
        n = len(t)
        return pd.DataFrame({"s": np.repeat(t, n), "t": np.tile(t, n), "w": w.ravel()})

    return _grouped(vectors, run, "s long, t long, w double")


def bartlett_factor(psi: np.ndarray, lag: int) -> np.ndarray:
    """Sums of each row and the `lag` before it over sqrt(lag + 1); the first `lag` rows have none."""
    return np.apply_along_axis(lambda x: np.convolve(x, np.ones(lag + 1), "valid"), 0, psi) / math.sqrt(lag + 1)


def hac_target(vectors: DataFrame, lag: int, eta: float = 0.08) -> DataFrame:
    """tau of Bartlett-filtered scores: Z_t = sum of the last lag + 1 scores over sqrt(lag + 1), first rows dropped."""

    def run(t, month, psi):
        z = bartlett_factor(psi, lag)
        w = la.resolvent_weights(month[lag:], eta)
        return pd.DataFrame({"t": t[lag:], "tau": la.tau_from_scores(z, w)})

    return _grouped(vectors, run, "t long, tau double")


def volterra_features(x: np.ndarray, half_lives: tuple[float, ...], level: int) -> np.ndarray:
    """Fading-memory signature features of a path, levels 1 to 3, for each half-life, z-scored: what `scans.signature` says
    of a long table, for one short path. A level's terms are what the level below holds from before times the path."""
    age = np.subtract.outer(np.arange(len(x)), np.arange(len(x)))
    out = []
    for half in half_lives:
        decay = np.where(age >= 0, 0.5 ** (np.maximum(age, 0) / half), 0.0)
        terms = x
        for depth in range(level):
            held = decay @ terms
            out.append(held)
            if depth + 1 < level:
                terms = ((held - terms)[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    return zscore(np.concatenate(out, axis=1))


def zscore(x: np.ndarray) -> np.ndarray:
    sd = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)


def volterra_target(vectors: DataFrame, lag: int = 2, rank: int = 3, level: int = 2, half_lives: tuple[float, ...] = (3.0, 12.0, 36.0), eta: float = 0.08, most_features: int = 100, pca: int = 10) -> DataFrame:
    """tau of the Bartlett-filtered scores under weights that blend the time kernel with nearness of signature features
    of the leading score paths; the reference is weighted as the states' weights average."""

    def run(t, month, psi):
        x, months = psi[lag:], month[lag:]
        lead = la.psd_eigen(x.T @ x / len(x))[1][:, :rank]
        f = volterra_features(zscore(x @ lead), half_lives, level)
        if f.shape[1] > most_features:
            u, s, _ = np.linalg.svd(f - f.mean(axis=0), full_matrices=False)
            f = u[:, :pca] * s[:pca]
        d2 = np.maximum(0, (f**2).sum(1)[:, None] + (f**2).sum(1)[None] - 2 * f @ f.T)
        np.fill_diagonal(d2, 0)
        d = np.sqrt(d2)
        h = np.median(d[d > 0])
        w = la.resolvent_weights(months, eta) * np.exp(-d2 / (2 * h * h))
        w /= w.sum(axis=1, keepdims=True)
        return pd.DataFrame({"t": t[lag:], "tau": la.tau_from_scores(bartlett_factor(psi, lag), w, w.mean(axis=0)), "ess": 1 / (w**2).sum(axis=1)})

    return _grouped(vectors, run, "t long, tau double, ess double")


def stress_spectrum(vectors: DataFrame, eta: float = 0.08) -> DataFrame:
    """(variant, s, i, a, q): eigenvalues of A(s) = D^-1/2 K(s) D^-1/2 and the soft probe's mass on each, from which
    stress curves, shape curves and spectral derivatives follow in SQL."""

    def run(t, month, psi):
        c, rho, d, d_rho = la.reference(psi)
        half = la.spd_inv_sqrt(d)
        q = c @ np.linalg.inv(d) / d_rho
        w = la.resolvent_weights(month, eta)
        rows = []
        for s in range(len(t)):
            a, v = la.psd_eigen(half @ ((psi * w[s][:, None]).T @ psi) @ half)
            rows.append(pd.DataFrame({"s": t[s], "i": np.arange(len(a)), "a": a, "q": np.einsum("pi,pq,qi->i", v, q, v)}))
        return pd.concat(rows)

    return _grouped(vectors, run, "s long, i int, a double, q double")


def ritz_certificate(vectors: DataFrame, ranks: tuple[int, ...], lam: float = 1.0, eta: float = 0.08) -> DataFrame:
    """For each state and rank R: exact stress tr[Q A (lam I + A)^-1], its compression to the leading R reference
    directions, the error, the retained probe mass, and the bound omitted mass + ||A V - V Theta|| / lam, capped at 1."""

    def run(t, month, psi):
        c, rho, d, d_rho = la.reference(psi)
        _, v = la.psd_eigen(c)
        half = la.spd_inv_sqrt(d)
        q = v.T @ (c @ np.linalg.inv(d) / d_rho) @ v
        w = la.resolvent_weights(month, eta)
        rows = []
        for s in range(len(t)):
            a = v.T @ (half @ ((psi * w[s][:, None]).T @ psi) @ half) @ v
            p = len(a)
            exact = float(np.trace(q @ a @ np.linalg.inv(lam * np.eye(p) + a)))
            for r in ranks:
                theta, qr = a[:r, :r], q[:r, :r]
                part = float(np.trace(qr @ theta @ np.linalg.inv(lam * np.eye(r) + theta)))
                residual = float(np.linalg.norm(a[r:, :r], 2)) if r < p else 0.0
                kept = float(np.trace(qr))
                bound = 1 - kept + residual / lam
                if abs(exact - part) > bound + 2e-7:
                    raise ValueError("the certificate is violated")
                rows.append((t[s], r, exact, part, abs(exact - part), kept, bound, min(1.0, bound)))
        return pd.DataFrame(rows, columns=["s", "r", "stress", "compressed", "error", "retained", "bound", "capped_bound"])

    return _grouped(vectors, run, "s long, r int, stress double, compressed double, error double, retained double, bound double, capped_bound double")


def interval_spectrum(vectors: DataFrame, thresholds: tuple[float, ...] = (2.0, 4.0), eta: float = 0.08) -> DataFrame:
    """For each state and threshold: how many eigenvalues of K v = x D v reach it, their sum, and the worst residual."""

    def run(t, month, psi):
        _, _, d, _ = la.reference(psi)
        w = la.resolvent_weights(month, eta)
        rows = []
        for s in range(len(t)):
            k = (psi * w[s][:, None]).T @ psi
            for x in thresholds:
                values, _, worst = la.generalised_above(k, d, x)
                rows.append((t[s], x, len(values), float(values.sum()), worst))
        return pd.DataFrame(rows, columns=["s", "threshold", "n_above", "total", "residual"])

    return _grouped(vectors, run, "s long, threshold double, n_above int, total double, residual double")


def eta_grid(vectors: DataFrame, points: int = 31, block: int = 12, extensions: int = 4) -> DataFrame:
    """Blocked predictive loss over a logarithmic grid of eta: the block's own months are left out of the weights."""

    def run(t, month, psi):
        n, p = psi.shape
        lam = np.linalg.eigvalsh(la.path_laplacian(month))
        lo, hi = max(1e-12, 1e-4 * lam[lam > 1e-10].min()), min(1e6, 1e2 * lam.max())
        c, rho, _, _ = la.reference(psi, ridge=1e-2)

        def loss(eta):
            w = la.resolvent_weights(month, eta, balance=False)
            total = 0.0
            for b in range(0, n, block):
                own = np.arange(b, min(n, b + block))
                for s in own:
                    x = w[s].copy()
                    x[own] = 0
                    k = (psi * (x / max(x.sum(), 1e-300))[:, None]).T @ psi + rho * np.eye(p)
                    total -= la.log_gaussian(psi[s], k)
            return total / n

        seen = {e: loss(e) for e in np.geomspace(lo, hi, points)}
        for _ in range(extensions):
            best = min(seen, key=seen.get)
            if best not in (min(seen), max(seen)):
                break
            more = np.geomspace(best / 100, best, 5)[:-1] if best == min(seen) else np.geomspace(best, best * 100, 5)[1:]
            seen |= {e: loss(e) for e in more if 1e-12 <= e <= 1e6}
        best = min(seen, key=seen.get)
        return pd.DataFrame({"eta": list(seen), "loss": list(seen.values()), "chosen": [e == best for e in seen]}).sort_values("eta")

    return _grouped(vectors, run, "eta double, loss double, chosen boolean")


#: Ways to make a moving second moment fit for a density.
ESTIMATORS = ("ledoit_wolf", "diagonal", "add_floor")


def nested_scores(vectors: DataFrame, start: int, half_life_mean: float | None, half_life_cov: float | None, train: int, estimator: str = "ledoit_wolf", floor: float = 1e-8) -> DataFrame:
    """Predictive log scores of the four nested causal models (constant, moving covariance, moving mean, both) from
    place `start`. States are updated only after a month is scored."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator}")

    def fit(k: np.ndarray, shrink: float, constant: np.ndarray) -> np.ndarray:
        if estimator == "add_floor":  # a fixed share of the training months' moment, then a floor for every direction
            k = 0.9 * k + 0.1 * constant
            return la.sym(k) + floor * np.trace(k) / len(k) * np.eye(len(k))
        return la.regularised(np.diag(np.diag(k)) if estimator == "diagonal" else k, shrink if estimator == "ledoit_wolf" else 0.0, floor)

    rates = {"M0": (None, None), "M1": (None, half_life_cov), "M2": (half_life_mean, None), "M3": (half_life_mean, half_life_cov)}

    def run(t, month, psi):
        head = psi[:train]
        centre = head.mean(axis=0)
        c = (head - centre).T @ (head - centre) / train
        d = c + (1e-8 * np.trace(c) / len(c) + 1e-12) * np.eye(len(c))
        low = np.linalg.cholesky(d)
        y = np.linalg.solve(low, (psi - centre).T).T
        base, shrink = la.ledoit_wolf(y[:train])
        jac = np.log(np.diag(low)).sum()
        rows = []
        for name, (hm, hc) in rates.items():
            am, ac = (1.0 if h is None else 0.5 ** (1 / h) for h in (hm, hc))
            constant = y[:train].T @ y[:train] / train
            mean, k = np.zeros(y.shape[1]), constant
            for i in range(train, len(y)):
                e = y[i] - mean
                if i >= start:
                    rows.append((t[i], name, la.log_gaussian(e, fit(k, shrink, constant)) - jac))
                k = ac * k + (1 - ac) * np.outer(e, e)
                mean = am * mean + (1 - am) * y[i]
        return pd.DataFrame(rows, columns=["t", "model", "score"])

    return _grouped(vectors, run, "t long, model string, score double")


def robust_smoother(vectors: DataFrame, rank: int = 2, rounds: int = 4, nu: float = 7.0) -> DataFrame:
    """The factor path of a state-space model on half-vectorised outer products: robust Kalman filter with Student
    weights, backward smoother and EM-style updates; decoded by projection to positive matrices, tau = tr(A) / rank."""

    def run(t, month, psi):
        z = _factors(psi, rank)
        states = em_smooth(la.half_vec(z[:, :, None] * z[:, None, :]), rounds, nu, rank).xs
        a = np.stack([la.apply_spectral(m, lambda x: np.clip(x, 0, None)) for m in la.from_half_vec(states, rank)])
        return pd.DataFrame({"t": t, "tau": np.trace(a, axis1=1, axis2=2) / rank, "lead": np.linalg.eigvalsh(a)[:, -1]})

    return _grouped(vectors, run, "t long, tau double, lead double")


def log_smoother(vectors: DataFrame, alpha: float, rank: int = 2, rounds: int = 4, nu: float = 7.0) -> DataFrame:
    """As `robust_smoother` on logarithmic observations, decoded by the matrix exponential: every state is positive."""

    def run(t, month, psi):
        z = _factors(psi, rank)
        a = log_states(em_smooth(log_observations(z, alpha), rounds, nu, rank).xs, rank)
        return pd.DataFrame({"t": t, "tau": np.trace(a, axis1=1, axis2=2) / rank, "lead": np.linalg.eigvalsh(a)[:, -1]})

    return _grouped(vectors, run, "t long, tau double, lead double")


class StateSpace(NamedTuple):
    """A fitted model y_t = x_t + noise, x_t = mu + f (x_{t-1} - mu) + noise: filtered (xf, pf), predicted (xp, pp)
    and smoothed (xs, ps) moments, the weights of the observations and the log-likelihoods."""

    mu: np.ndarray
    f: np.ndarray
    q: np.ndarray
    r: np.ndarray
    xf: np.ndarray
    pf: np.ndarray
    xp: np.ndarray
    pp: np.ndarray
    xs: np.ndarray
    ps: np.ndarray
    w: np.ndarray
    gaussian: float
    robust: float


def shrunk_transition(f: np.ndarray, rank: int, cross: float = 0.15, diag: float = 0.10, most: float = 0.965) -> np.ndarray:
    """Entries between the first `rank` coordinates (diagonal of the half-vectorised matrix) and the others are
    shrunk by `cross`, all off-diagonal ones by `diag`; the spectral radius is capped at `most`."""
    first = np.arange(len(f)) < rank
    f = np.where(first[:, None] == first[None, :], f, cross * f)
    f = (1 - diag) * f + diag * np.diag(np.diag(f))
    return f * min(1.0, most / max(float(np.abs(np.linalg.eigvals(f)).max()), 1e-300))


def em_smooth(y: np.ndarray, rounds: int, nu: float | None, rank: int, weights: np.ndarray | None = None) -> StateSpace:
    """The robust state space of half-vectorised observations after `rounds` of updates. `weights` of the months have
    mean one in the objective; by default all count alike."""
    n, p = y.shape
    ow = np.ones(n) if weights is None else weights / weights.mean()
    tw = ow[1:]
    moment = lambda e, w: la.regularised((e.T * w) @ e / w.sum())
    mu = ow @ y / ow.sum()
    x0, x1 = y[:-1] - mu, y[1:] - mu
    f = shrunk_transition(np.linalg.solve((x0.T * tw) @ x0 + 0.5 * np.eye(p), (x0.T * tw) @ x1).T, rank)
    e = x1 - x0 @ f.T
    sigma = moment(e - tw @ e / tw.sum(), tw)
    q, r = 0.35 * sigma + 1e-5 * np.eye(p), 0.65 * sigma + 1e-5 * np.eye(p)
    base = moment(y - mu, ow)
    now = smooth(y, mu, f, q, r, nu, ow)
    for _ in range(rounds):
        xs, ps = now.xs, now.ps
        mu = ow @ xs / ow.sum()
        x0, x1 = xs[:-1] - mu, xs[1:] - mu
        held = (x0.T * tw) @ x0 + np.tensordot(tw, ps[:-1], 1) + 0.5 * np.eye(p)
        f = shrunk_transition(np.linalg.solve(la.sym(held), ((x1.T * tw) @ x0).T).T, rank)
        e = x1 - x0 @ f.T
        q = la.regularised((e.T * tw) @ e / tw.sum() + 0.05 * np.average(ps[1:], axis=0, weights=tw) + 0.08 * base)
        o, w = y - xs, now.w * ow
        r = la.regularised((o.T * w) @ o / w.sum() + 0.05 * np.average(ps, axis=0, weights=ow) + 0.01 * base)
        now = smooth(y, mu, f, q, r, nu, ow)
    return now


def smooth(y: np.ndarray, mu: np.ndarray, f: np.ndarray, q: np.ndarray, r: np.ndarray, nu: float | None, ow: np.ndarray | None = None) -> StateSpace:
    """Filter with observation weights clip((nu + p) / (nu + mahalanobis), 1/4, 1), then smooth backwards; without nu
    all observations weigh one, which is the plain Kalman smoother."""
    n, p = y.shape
    ow, eye = np.ones(n) if ow is None else ow, np.eye(p)
    xf, pf, xp, pp, w = np.zeros((n, p)), np.zeros((n, p, p)), np.zeros((n, p)), np.zeros((n, p, p)), np.ones(n)
    x, c, gaussian, robust = mu, la.stationary_cov(f, q), 0.0, 0.0
    for i in range(n):
        if i:
            x, c = mu + f @ (x - mu), la.sym(f @ c @ f.T + q)
        xp[i], pp[i] = x, c
        e, s0 = y[i] - x, la.sym(c + r)
        if nu is not None:
            w[i] = np.clip((nu + p) / (nu + e @ np.linalg.solve(s0, e)), 0.25, 1)
        rt = r / max(w[i] * ow[i], 1e-12)
        gain = np.linalg.solve(la.sym(c + rt), c).T
        gaussian += ow[i] * la.log_gaussian(e, la.sym(c + rt))
        robust += ow[i] * (la.log_gaussian(e, s0) if nu is None else la.log_student(e, s0, nu))
        x = x + gain @ e
        c = la.sym((eye - gain) @ c @ (eye - gain).T + gain @ rt @ gain.T)
        xf[i], pf[i] = x, c
    xs, ps = xf.copy(), pf.copy()
    for i in range(n - 2, -1, -1):
        j = np.linalg.solve(pp[i + 1], f @ pf[i]).T
        xs[i] = xf[i] + j @ (xs[i + 1] - xp[i + 1])
        ps[i] = la.sym(pf[i] + j @ (ps[i + 1] - pp[i + 1]) @ j.T)
    return StateSpace(mu, f, q, r, xf, pf, xp, pp, xs, ps, w, gaussian, robust)


def backward_sampler(m: StateSpace):
    """A function of a random generator that draws a whole path of states given all observations: the last state from
    its filtered law, every other from its law given the state after it."""
    n, p = m.xf.shape
    gains, roots = np.zeros((n, p, p)), np.zeros((n, p, p))
    roots[-1] = np.linalg.cholesky(la.regularised(m.pf[-1]))
    for i in range(n - 1):
        gains[i] = np.linalg.solve(m.pp[i + 1], m.f @ m.pf[i]).T
        roots[i] = np.linalg.cholesky(la.regularised(m.pf[i] - gains[i] @ m.pp[i + 1] @ gains[i].T))

    def draw(rng: np.random.Generator) -> np.ndarray:
        z = np.einsum("tij,tj->ti", roots, rng.standard_normal((n, p)))
        x = m.xf + z
        for i in range(n - 2, -1, -1):
            x[i] += gains[i] @ (x[i + 1] - m.xp[i + 1])
        return x

    return draw


def _factors(psi: np.ndarray, rank: int) -> np.ndarray:
    """The scores' leading `rank` coordinates, each scaled to unit second moment."""
    c = psi.T @ psi / len(psi)
    values, v = la.psd_eigen(c)
    return psi @ v[:, :rank] / np.sqrt(values[:rank] + 1e-8 * np.trace(c) / len(c))


#: The candidates for the power of the identity in the logarithmic observations.
ALPHAS = (0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35)


def mean_identity(a: np.ndarray) -> np.ndarray:
    """Positive matrices mapped so that their mean is the identity."""
    root = la.spd_inv_sqrt(a.mean(axis=0))
    return root @ a @ root


def log_observations(z: np.ndarray, alpha: float) -> np.ndarray:
    """Half-vectorised logarithms of (1 - alpha) z z' + alpha I, mapped to the mean I first."""
    a = (1 - alpha) * z[:, :, None] * z[:, None, :] + alpha * np.eye(z.shape[1])
    return la.half_vec(np.stack([la.spd_log(m) for m in mean_identity(a)]))


def log_states(x: np.ndarray, rank: int) -> np.ndarray:
    """The positive matrices, of mean I, whose half-vectorised logarithms are x up to that map."""
    return mean_identity(np.stack([la.spd_exp(m) for m in la.from_half_vec(x, rank)]))


def predictive_score(z: np.ndarray, m: StateSpace, nu: float) -> float:
    """The Student log density of every month's factors under the matrix predicted for it on the logarithmic scale."""
    rank = z.shape[1]
    return sum(la.log_student(e, a, nu) for e, a in zip(z, log_states(m.xp, rank)))


def alpha_search(vectors: DataFrame, rank: int = 2, rounds: int = 4, nu: float = 7.0) -> DataFrame:
    """(alpha, score, chosen): the logarithmic model under each candidate, fitted with half the rounds and judged by
    its one-step-ahead scores of the factors; the largest score is chosen, the first of equals."""

    def run(t, month, psi):
        z = _factors(psi, rank)
        scores = [predictive_score(z, em_smooth(log_observations(z, a), max(2, rounds // 2), nu, rank), nu) for a in ALPHAS]
        return pd.DataFrame({"alpha": ALPHAS, "score": scores, "chosen": np.arange(len(ALPHAS)) == int(np.argmax(scores))})

    return _grouped(vectors, run, "alpha double, score double, chosen boolean")


def state_draws(vectors: DataFrame, draws: int, rank: int = 2, seed: int = 11, nu: float = 7.0) -> DataFrame:
    """Forward-filter backward-sample draws of the factor path as tau rows; draws are made in chunks as parallel groups."""
    spark = vectors.sparkSession
    chunks = spark.range(-(-draws // 16)).withColumnRenamed("id", "chunk")

    def run(key, pdf):
        t, _, psi = _matrix(pdf)
        z = _factors(psi, rank)
        draw = backward_sampler(em_smooth(la.half_vec(z[:, :, None] * z[:, None, :]), 4, nu, rank))
        rows = []
        for b in range(16 * int(key[1]), min(draws, 16 * int(key[1]) + 16)):
            x = draw(np.random.default_rng([seed, b]))
            a = np.stack([la.apply_spectral(m, lambda u: np.clip(u, 0, None)) for m in la.from_half_vec(x, rank)])
            rows.append(pd.DataFrame({"variant": key[0], "draw": b, "s": t, "tau": np.trace(a, axis1=1, axis2=2) / rank}))
        return pd.concat(rows)

    return vectors.join(F.broadcast(chunks)).groupBy("variant", "chunk").applyInPandas(run, "variant string, draw long, s long, tau double")


def bootstrap_tau(vectors: DataFrame, draws: int, block: int, seed: int, eta: float = 0.08, chunk: int = 64) -> DataFrame:
    """Draws of the tau path: months stay, score rows are resampled in circular blocks and the reference is re-made."""
    spark = vectors.sparkSession
    chunks = spark.range(-(-draws // chunk)).withColumnRenamed("id", "chunk")

    def run(key, pdf):
        t, month, psi = _matrix(pdf)
        w, n = la.resolvent_weights(month, eta), len(t)
        rows = []
        for b in range(chunk * int(key[1]), min(draws, chunk * int(key[1]) + chunk)):
            starts = np.random.default_rng([seed, b]).integers(0, n, -(-n // block))
            at = ((starts[:, None] + np.arange(block)) % n).ravel()[:n]
            rows.append(pd.DataFrame({"variant": key[0], "draw": b, "s": t, "tau": la.tau_from_scores(psi[at], w)}))
        return pd.concat(rows)

    return vectors.join(F.broadcast(chunks)).groupBy("variant", "chunk").applyInPandas(run, "variant string, draw long, s long, tau double")


def reference_summary(vectors: DataFrame) -> DataFrame:
    """rho, d_rho, trace, extreme eigenvalues, numerical rank and Ledoit-Wolf shrinkage of each variant's scores."""

    def run(t, month, psi):
        c, rho, _, d_rho = la.reference(psi)
        lam = np.linalg.eigvalsh(c)
        return pd.DataFrame([(rho, d_rho, float(np.trace(c)), float(lam[-1]), float(lam[0]), int((lam > 1e-10 * lam[-1]).sum()), la.ledoit_wolf(psi)[1])], columns=["rho", "d_rho", "trace", "max_eig", "min_eig", "num_rank", "shrinkage"])

    return _grouped(vectors, run, "rho double, d_rho double, trace double, max_eig double, min_eig double, num_rank int, shrinkage double")


def basis_energy(vectors: DataFrame, rank: int, width: int) -> DataFrame:
    """(variant, basis, k, h, j, v): leading eigenvectors of C in long form."""

    def run(t, month, psi):
        _, v = la.psd_eigen(psi.T @ psi / len(psi))
        p = len(v)
        k = np.tile(np.arange(p), rank)
        return pd.DataFrame({"basis": np.repeat(np.arange(rank), p), "k": k, "h": k // width, "j": k % width, "v": v[:, :rank].T.ravel()})

    return _grouped(vectors, run, "basis int, k int, h int, j int, v double")


def subspace_angles(vectors: DataFrame, rank: int) -> DataFrame:
    """Cosines of the angles between the leading score subspaces of the first and the second half of the months."""

    def run(t, month, psi):
        h = len(psi) // 2
        a, b = (la.psd_eigen(x.T @ x / len(x))[1][:, :rank] for x in (psi[:h], psi[h:]))
        order, _ = la.match_columns(a, b)
        return pd.DataFrame({"i": np.arange(rank), "cosine": la.principal_angles(a, b), "matched": order})

    return _grouped(vectors, run, "i int, cosine double, matched int")


def psd_diagnostics(vectors: DataFrame, eta: float = 0.08) -> DataFrame:
    """Symmetry error, extreme eigenvalues and numerical rank of K(s) at every state."""

    def run(t, month, psi):
        w = la.resolvent_weights(month, eta)
        rows = []
        for s in range(len(t)):
            k = (psi * w[s][:, None]).T @ psi
            lam = np.linalg.eigvalsh(la.sym(k))
            rows.append((t[s], float(np.abs(k - k.T).max()), float(lam[0]), float(lam[-1]), int((lam > 1e-10 * lam[-1]).sum())))
        return pd.DataFrame(rows, columns=["s", "asymmetry", "min_eig", "max_eig", "num_rank"])

    return _grouped(vectors, run, "s long, asymmetry double, min_eig double, max_eig double, num_rank int")


def surface_shape(vectors: DataFrame, rank: int, width: int, eta: float = 0.08) -> DataFrame:
    """Scale tau = tr(A) / rank, distance of A / tau from the identity, and the leverage-weighted root mean square of the
    log relative variance of coordinates in the leading reduced basis."""

    def run(t, month, psi):
        c, rho, _, _ = la.reference(psi)
        values, v = la.psd_eigen(c)
        base = v[:, :rank] * np.sqrt(values[:rank])
        z = psi @ v[:, :rank] / np.sqrt(values[:rank] + rho)
        lever = (base**2).sum(axis=1)
        w = la.resolvent_weights(month, eta)
        rows = []
        for s in range(len(t)):
            a = (z * w[s][:, None]).T @ z
            tau = max(float(np.trace(a)) / rank, 1e-12)
            shape = a / tau
            rel = np.maximum(np.einsum("kr,rs,ks->k", base, shape, base), 1e-14) / np.maximum(lever, 1e-14)
            rows.append((t[s], tau, float(np.linalg.norm(shape - np.eye(rank))), float(np.sqrt((lever / lever.sum() * np.log(rel) ** 2).sum()))))
        return pd.DataFrame(rows, columns=["s", "tau", "shape_distance", "surface_rms"])

    return _grouped(vectors, run, "s long, tau double, shape_distance double, surface_rms double")


def severe_capture(vectors: DataFrame, thresholds: tuple[float, ...], rank: int = 5, eta: float = 0.08) -> DataFrame:
    """For each state and threshold: the number of severe directions and the share of their space that the leading
    `rank` reference directions capture; null where there is none."""

    def run(t, month, psi):
        c, rho, d, _ = la.reference(psi)
        values, v = la.psd_eigen(c)
        z = psi @ v / np.sqrt(values + rho)
        w = la.resolvent_weights(month, eta)
        rows = []
        for s in range(len(t)):
            x, u = np.linalg.eigh(la.sym((z * w[s][:, None]).T @ z))
            for thr in thresholds:
                some = u[:, x >= thr - 5e-8]
                n = some.shape[1]
                rows.append((t[s], thr, n, float((some[:rank] ** 2).sum() / n) if n else None))
        return pd.DataFrame(rows, columns=["s", "threshold", "n_severe", "capture"])

    return _grouped(vectors, run, "s long, threshold double, n_severe int, capture double")


def eta_sensitivity(vectors: DataFrame, chosen: float, etas: tuple[float, ...], rank: int = 5, lam: float = 1.0) -> DataFrame:
    """The chosen eta and its neighbours at least 1.5 times away: median effective size and largest rank-R error."""

    def run(t, month, psi):
        lower, upper = [e for e in etas if e < chosen / 1.5], [e for e in etas if e > chosen * 1.5]
        roles = [("selected", chosen)] + [("more_smoothed", max(lower))] * bool(lower) + [("less_smoothed", min(upper))] * bool(upper)
        c, rho, d, d_rho = la.reference(psi)
        values, v = la.psd_eigen(c)
        z = psi @ v / np.sqrt(values + rho)
        q = values / (values + rho) / d_rho
        rows = []
        for role, eta in roles:
            w = la.resolvent_weights(month, eta, balance=False)
            worst = 0.0
            for s in range(len(t)):
                a = (z * w[s][:, None]).T @ z
                p, r = len(a), min(rank, len(a))
                exact = np.trace(np.diag(q) @ a @ np.linalg.inv(lam * np.eye(p) + a))
                part = np.trace(np.diag(q[:r]) @ a[:r, :r] @ np.linalg.inv(lam * np.eye(r) + a[:r, :r]))
                worst = max(worst, abs(float(exact - part)))
            rows.append((role, eta, float(np.median(1 / (w**2).sum(axis=1))), worst))
        return pd.DataFrame(rows, columns=["role", "eta", "median_ess", "max_error"])

    return _grouped(vectors, run, "role string, eta double, median_ess double, max_error double")


def structural_rank(vectors: DataFrame, levels: tuple[float, ...] = (0.5, 0.8, 0.95, 0.99)) -> DataFrame:
    """Singular values of the scores: how many carry each share of the total energy."""

    def run(t, month, psi):
        e = np.linalg.svd(psi, compute_uv=False) ** 2
        share = np.cumsum(e) / e.sum()
        return pd.DataFrame({"level": levels, "directions": [int(np.searchsorted(share, x - 1e-12) + 1) for x in levels]})

    return _grouped(vectors, run, "level double, directions int")


def model_checks(vectors: DataFrame, eta: float = 0.08) -> DataFrame:
    """(check, value, tolerance, passed) of the full model of each variant: symmetry and positivity of the reference C,
    the path K(s) and its relative form A(s), the soft dimension, the weights' sums, that K(s) averages to C and tau
    to one, and how many cells have too little reference variance to divide by."""

    def run(t, month, psi):
        c, _, d, d_rho = la.reference(psi)
        w = la.resolvent_weights(month, eta)
        half = la.spd_inv_sqrt(d)
        low, asym, least = np.inf, 0.0, np.inf
        mean = np.zeros_like(c)
        for row in w:
            k = (psi * row[:, None]).T @ psi
            asym = max(asym, float(np.abs(k - k.T).max()))
            least = min(least, float(np.linalg.eigvalsh(la.sym(k))[0]))
            low = min(low, float(np.linalg.eigvalsh(la.sym(half @ k @ half))[0]))
            mean += k / len(w)
        tau = la.tau_from_scores(psi, w)
        small = np.diag(c) <= 1e-12 * max(float(np.diag(c).mean()), 1.0)
        rows = [
            ("reference_symmetric", float(np.abs(c - c.T).max()), 1e-10, 1),
            ("path_symmetric", asym, 1e-10 * max(1.0, float(np.abs(c).max())), 1),
            ("reference_smallest_eigenvalue", float(np.linalg.eigvalsh(c)[0]), -1e-8 * max(1.0, float(np.abs(c).max())), -1),
            ("path_smallest_eigenvalue", least, -1e-8 * max(1.0, float(np.abs(c).max())), -1),
            ("relative_smallest_eigenvalue", low, -1e-8, -1),
            ("soft_dimension", d_rho, 0.0, -1),
            ("mean_path_is_reference", float(np.linalg.norm(mean - c) / np.linalg.norm(c)), 1e-8, 1),
            ("mean_tau_is_one", abs(float(tau.mean()) - 1), 1e-8, 1),
            ("row_sums", float(np.abs(w.sum(axis=1) - 1).max()), 1e-8, 1),
            ("column_sums", float(np.abs(w.sum(axis=0) - 1).max()), 1e-8, 1),
            ("cells_without_variance", float(small.sum()), 0.0, 1),
        ]
        out = pd.DataFrame(rows, columns=["check", "value", "tolerance", "side"])
        out["passed"] = np.where(out["side"] > 0, out["value"] <= out["tolerance"], out["value"] >= out["tolerance"])
        return out.drop(columns="side")

    return _grouped(vectors, run, "check string, value double, tolerance double, passed boolean")


def bootstrap_resolved(design: DataFrame, draws: int, block: int, seed: int, rank: int = 2, rounds: int = 2, nu: float = 7.0, ridge: float = 1e-8, chunk: int = 8) -> DataFrame:
    """(variant, draw, s, tau, error): the whole pipeline again in every draw. Months are resampled in circular blocks;
    the regression is solved anew from the sums of the rows' x x' and x y', its residuals give scores, and the robust
    state space is fitted to them. Months stay in place. A draw whose fit fails is one row with its error."""
    chunks = design.sparkSession.range(-(-draws // chunk)).withColumnRenamed("id", "chunk")

    def run(key, pdf):
        pdf = pdf.sort_values("t")
        t, x = pdf["t"].to_numpy(), np.stack(pdf["controls"].to_numpy())
        sd = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
        x[:, 0] = 1
        y = np.column_stack([pdf["m"].to_numpy(), np.stack(pdf["dy"].to_numpy())])
        n, rows = len(x), []
        for b in range(chunk * int(key[1]), min(draws, chunk * int(key[1]) + chunk)):
            starts = np.random.default_rng([seed, b]).integers(0, n, -(-n // block))
            at = ((starts[:, None] + np.arange(block)) % n).ravel()[:n]
            often = np.bincount(at, minlength=n).astype(float)
            try:
                coef = np.linalg.solve((x.T * often) @ x + ridge * np.eye(x.shape[1]), (x.T * often) @ y)
                e = (y - x @ coef)[at]
                z = _factors(e[:, :1] * e[:, 1:] / np.mean(e[:, 0] ** 2), rank)
                states = em_smooth(la.half_vec(z[:, :, None] * z[:, None, :]), rounds, nu, rank).xs
                a = np.stack([la.apply_spectral(m, lambda v: np.clip(v, 0, None)) for m in la.from_half_vec(states, rank)])
                rows.append(pd.DataFrame({"variant": key[0], "draw": b, "s": t, "tau": np.trace(a, axis1=1, axis2=2) / rank, "error": None}))
            except (np.linalg.LinAlgError, ValueError) as problem:
                rows.append(pd.DataFrame({"variant": [key[0]], "draw": [b], "s": [-1], "tau": [np.nan], "error": [str(problem)]}))
        return pd.concat(rows)

    return design.join(F.broadcast(chunks)).groupBy("variant", "chunk").applyInPandas(run, "variant string, draw long, s long, tau double, error string")
