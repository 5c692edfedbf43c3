"""Small dense linear algebra in numpy, used inside grouped kernels. No Spark here."""

from __future__ import annotations

import math

import numpy as np


def sym(a: np.ndarray) -> np.ndarray:
    return 0.5 * (a + np.swapaxes(a, -1, -2))


def signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its entry of largest size positive."""
    at = np.abs(vectors).argmax(axis=0)
    flip = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(flip == 0, 1, flip)


def psd_eigen(a: np.ndarray, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending and clipped at zero, and signed vectors; raises where one is materially negative."""
    values, vectors = np.linalg.eigh(sym(a))
    values, vectors = values[::-1], vectors[:, ::-1]
    if values[-1] < -tol * max(1.0, float(np.abs(values).max())):
        raise ValueError(f"smallest eigenvalue {values[-1]:.3e} is negative")
    return np.clip(values, 0, None), signed(vectors)


def apply_spectral(a: np.ndarray, f) -> np.ndarray:
    values, vectors = np.linalg.eigh(sym(a))
    return (vectors * f(values)) @ vectors.T


def spd_floor(a: np.ndarray, floor: float) -> np.ndarray:
    return apply_spectral(a, lambda v: np.maximum(v, floor))


def spd_sqrt(a: np.ndarray) -> np.ndarray:
    return apply_spectral(a, lambda v: np.sqrt(np.clip(v, 0, None)))


def spd_inv_sqrt(a: np.ndarray) -> np.ndarray:
    return apply_spectral(a, lambda v: 1 / np.sqrt(v))


def spd_log(a: np.ndarray) -> np.ndarray:
    return apply_spectral(a, np.log)


def spd_exp(a: np.ndarray) -> np.ndarray:
    return apply_spectral(a, np.exp)


def half_vec(a: np.ndarray) -> np.ndarray:
    """The diagonal, then the upper triangle row by row, off-diagonal entries as they are."""
    i, j = np.triu_indices(a.shape[-1], 1)
    return np.concatenate([np.diagonal(a, axis1=-2, axis2=-1), a[..., i, j]], axis=-1)


def from_half_vec(v: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((*v.shape[:-1], p, p))
    i, j = np.triu_indices(p, 1)
    out[..., i, j] = out[..., j, i] = v[..., p:]
    out[..., np.arange(p), np.arange(p)] = v[..., :p]
    return out


def ridge_residual(y: np.ndarray, x: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    return y - x @ np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shrinkage of the uncentred second moment towards a multiple of the identity, and the shrinkage."""
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, (((x**2).T @ (x**2)).sum() / n - (s**2).sum()) / n / p)
    shrink = 0.0 if delta == 0 else float(beta / delta)
    return (1 - shrink) * s + shrink * mu * np.eye(p), shrink


def regularised(a: np.ndarray, shrink: float = 0.0, floor: float = 1e-8, most: float = 1e-4) -> np.ndarray:
    """Shrunk towards its scale, eigenvalues clipped, and jittered by steps until it has a Cholesky factor."""
    p = len(a)
    scale = max(float(np.trace(a)) / p, 1e-300)
    b = spd_floor((1 - shrink) * a + shrink * scale * np.eye(p), floor * scale)
    jitter = 0.0
    while True:
        try:
            np.linalg.cholesky(b + jitter * np.eye(p))
            return b + jitter * np.eye(p)
        except np.linalg.LinAlgError:
            jitter = max(10 * jitter, floor * scale)
            if jitter > most * scale:
                raise


def stationary_cov(f: np.ndarray, q: np.ndarray, steps: int = 60) -> np.ndarray:
    """P = F P F' + Q by doubling."""
    p, a = q.copy(), f.copy()
    for _ in range(steps):
        more = a @ p @ a.T
        p = p + more
        a = a @ a
        if np.abs(more).max() < 1e-14 * max(1.0, np.abs(p).max()):
            break
    return sym(p)


def log_gaussian(e: np.ndarray, cov: np.ndarray) -> float:
    c = np.linalg.cholesky(cov)
    z = np.linalg.solve(c, e)
    return float(-0.5 * (len(e) * math.log(2 * math.pi) + 2 * np.log(np.diag(c)).sum() + z @ z))


def log_student(e: np.ndarray, scale: np.ndarray, nu: float) -> float:
    d = len(e)
    c = np.linalg.cholesky(scale)
    z = np.linalg.solve(c, e)
    return float(math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - 0.5 * d * math.log(nu * math.pi) - np.log(np.diag(c)).sum() - 0.5 * (nu + d) * math.log1p(float(z @ z) / nu))


def path_laplacian(months: np.ndarray) -> np.ndarray:
    """Laplacian of the path over month numbers with conductance 1 / gap^2."""
    n = len(months)
    c = 1.0 / np.diff(months.astype(float)) ** 2
    lap = np.zeros((n, n))
    i = np.arange(n - 1)
    lap[i, i + 1] = lap[i + 1, i] = -c
    lap[np.arange(n), np.arange(n)] = -lap.sum(axis=1)
    return lap


def resolvent_weights(months: np.ndarray, eta: float, balance: bool = True, rounds: int = 200) -> np.ndarray:
    """eta (eta I + Lap)^-1, made doubly stochastic by symmetric scaling."""
    n = len(months)
    w = np.clip(sym(eta * np.linalg.inv(eta * np.eye(n) + path_laplacian(months))), 0, None)
    if balance:
        for _ in range(rounds):
            r = w.sum(axis=1)
            if np.abs(r - 1).max() < 1e-12:
                break
            w = w / np.sqrt(r[:, None] * r[None, :])
    return w


def reference(psi: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-8) -> tuple[np.ndarray, float, np.ndarray, float]:
    """C, rho, D = C + rho I and d_rho = sum lambda / (lambda + rho) of scores, weighted or not."""
    n, p = psi.shape
    a = np.full(n, 1 / n) if weights is None else weights / weights.sum()
    c = sym((psi * a[:, None]).T @ psi)
    rho = ridge * np.trace(c) / p + 1e-12
    lam = np.clip(np.linalg.eigvalsh(c), 0, None)
    return c, rho, c + rho * np.eye(p), float((lam / (lam + rho)).sum())


def tau_from_scores(psi: np.ndarray, w: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """tau(s) = sum_t w(s, t) psi_t' D^-1 psi_t / d_rho: the trace is linear in the outer products."""
    _, _, d, d_rho = reference(psi, weights)
    q = np.einsum("tk,tk->t", psi, np.linalg.solve(d, psi.T).T) / d_rho
    return w @ q


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the principal angles of two column spaces, descending."""
    return np.clip(np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False), 0, 1)


def match_columns(a: np.ndarray, b: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The permutation and signs of b's columns that overlap most with a's; exact, by dynamic programming over subsets."""
    o = a.T @ b
    r = o.shape[0]
    best = {0: (0.0, ())}
    for i in range(r):
        new: dict[int, tuple[float, tuple]] = {}
        for mask, (v, order) in best.items():
            for j in range(r):
                if not mask >> j & 1:
                    x = (v + abs(o[i, j]), (*order, j))
                    m = mask | 1 << j
                    if m not in new or x[0] > new[m][0]:
                        new[m] = x
        best = new
    order = list(best[(1 << r) - 1][1])
    s = np.sign(o[np.arange(r), order])
    return order, np.where(s == 0, 1, s)


def smoothing_spline(y: np.ndarray, strength: float) -> np.ndarray:
    """Penalised second differences along the last axis: a discrete cubic smoother."""
    n = y.shape[-1]
    d = np.diff(np.eye(n), 2, axis=0)
    return np.linalg.solve(np.eye(n) + strength * d.T @ d, y.reshape(-1, n).T).T.reshape(y.shape)


def generalised_above(k: np.ndarray, d: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenpairs of K v = x D v with x >= threshold, v normalised in D, descending; and the worst residual norm."""
    c = np.linalg.cholesky(d)
    m = np.linalg.solve(c, np.linalg.solve(c, sym(k)).T)
    values, vectors = np.linalg.eigh(sym(m))
    keep = values >= threshold - 5e-8
    x, v = values[keep][::-1], signed(np.linalg.solve(c.T, vectors[:, keep][:, ::-1])) if keep.any() else np.zeros((len(d), 0))
    worst = float(np.abs(k @ v - d @ v * x).max()) if len(x) else 0.0
    return x, v, worst
