"""Matrix pieces shared by the iterative methods."""

from __future__ import annotations

import numpy as np


def soft_threshold(x: np.ndarray, t: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def svd_threshold(x: np.ndarray, t: float) -> np.ndarray:
    u, s, v = np.linalg.svd(x, full_matrices=False)
    return (u * np.maximum(s - t, 0)) @ v


def approx_rank(x: np.ndarray, share: float = 0.95) -> int:
    """Least rank whose singular values hold more than ``share`` of their sum; 1 for a zero matrix."""
    s = np.linalg.svd(x, compute_uv=False)
    if not s.sum():
        return 1
    return int(np.argmax(np.cumsum(s) / s.sum() > share) + 1) if (np.cumsum(s) / s.sum() > share).any() else len(s)


def lag_difference(lag: int, n: int) -> np.ndarray:
    """H with (H x)_i = x_i - x_(i + lag) for i below n - lag; the last rows are zero."""
    h = np.zeros((n, n))
    i = np.arange(max(0, n - lag))
    h[i, i], h[i, i + lag] = 1, -1
    return h


def fold(x: np.ndarray, period: int) -> np.ndarray:
    """Rows of ``period`` time steps side by side; the end is filled with NaN."""
    rows = -(-len(x) // period)
    out = np.full((rows * period, x.shape[1]), np.nan)
    out[: len(x)] = x
    return out.reshape(rows, period * x.shape[1])


def unfold(m: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return m.reshape(-1, shape[1])[: shape[0]]


def fill_linear(x: np.ndarray) -> np.ndarray:
    """Columns interpolated with flat ends; a column without values takes the median of all."""
    out = x.copy()
    t = np.arange(len(x))
    every = np.nanmedian(x) if np.isfinite(x).any() else 0.0
    for j in range(x.shape[1]):
        ok = ~np.isnan(x[:, j])
        out[:, j] = np.interp(t, t[ok], x[ok, j]) if ok.any() else every
    return out


def fill_constant(x: np.ndarray, method: str = "zeros") -> np.ndarray:
    """Missing cells take their column's ``mean`` or ``median``, or 0 (``zeros``); a column without values takes that of all."""
    if method == "zeros":
        return np.nan_to_num(x, nan=0.0)
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method {method}")
    of = np.nanmean if method == "mean" else np.nanmedian
    seen = np.isfinite(x)
    every = of(x) if seen.any() else 0.0
    return np.where(seen, x, [of(x[:, j]) if seen[:, j].any() else every for j in range(x.shape[1])])


def l1_norm(x: np.ndarray) -> float:
    return float(np.abs(x).sum())


def lag_matrices(x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(Z, Y): Z rows are 1 and the p rows before, nearest first."""
    n = len(x)
    return np.concatenate([np.ones((n - p, 1))] + [x[p - k : n - k] for k in range(1, p + 1)], axis=1), x[p:]


def frechet(m1: np.ndarray, s1: np.ndarray, m2: np.ndarray, s2: np.ndarray) -> float:
    """Squared Frechet distance of two Gaussians; the root's trace from the eigenvalues of a symmetric product."""
    w, v = np.linalg.eigh(s1)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ s2 @ root), 0)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * cross)


def gaussian_kl(m1: np.ndarray, s1: np.ndarray, m2: np.ndarray, s2: np.ndarray) -> float:
    """KL(N(m1, s1) || N(m2, s2)); covariances must be regular."""
    inv, d = np.linalg.inv(s2), m2 - m1
    return float(0.5 * (np.trace(inv @ s1) + d @ inv @ d - len(d) + np.linalg.slogdet(s2)[1] - np.linalg.slogdet(s1)[1]))
