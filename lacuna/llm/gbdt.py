"""Histogram gradient-boosted trees for a binary label, in numpy.

Fitting bins each feature at quantiles and grows trees level by level on
gradient and Hessian histograms of the logistic loss.  A fitted model is a few
flat arrays (feature, threshold, first child, leaf value over all trees); all
trees of all rows are walked together, one vectorised step for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """A forest in flat arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.full(len(x), self.base)
        for a in range(0, len(x), block):
            rows = x[a : a + block]
            at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
            i = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                at = np.where(rows[i, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[a : a + block] += self.value[at].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 5, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least_hessian: float = 1.0) -> Trees:
    """Trees fitted to labels 0/1; with one class only, a constant."""
    n, k = x.shape
    mean = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], axis=1) if n else np.zeros((0, k), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(value))
        right.append(len(value))
        value.append(v)
        return len(value) - 1

    score = np.full(n, base)
    flat = codes + np.arange(k) * bins
    for _ in range(n_trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
        roots.append(new(0.0))
        ids = np.array([roots[-1]])
        node = np.zeros(n, np.int64)  # index into ids
        settled = np.zeros(n)
        live = np.arange(n)
        for level in range(depth + 1):
            m = len(ids)
            gs, hs = (np.bincount(node[live], w[live], m) for w in (g, h))
            for i, t in enumerate(ids):
                value[t] = float(-rate * gs[i] / (hs[i] + ridge))
            if level == depth:
                settled[live] = np.array([value[t] for t in ids])[node[live]]
                break
            key = (node[live, None] * (k * bins) + flat[live]).ravel()
            hg, hh = (np.bincount(key, np.repeat(w[live], k), m * k * bins).reshape(m, k, bins).cumsum(axis=2) for w in (g, h))
            gt, ht = gs[:, None, None], hs[:, None, None]
            gain = hg**2 / (hh + ridge) + (gt - hg) ** 2 / (ht - hh + ridge) - gt**2 / (ht + ridge)
            gain[(hh < least_hessian) | (ht - hh < least_hessian)] = -np.inf
            for j in range(k):
                gain[:, j, len(cuts[j]) :] = -np.inf
            best = gain.reshape(m, -1).argmax(axis=1)
            good = gain.reshape(m, -1)[np.arange(m), best] > 1e-9
            children = np.full((m, 2), -1)
            following = []
            for i in np.flatnonzero(good):
                j, b = divmod(int(best[i]), bins)
                t = ids[i]
                lr = new(0.0), new(0.0)
                feature[t], threshold[t], left[t], right[t], value[t] = j, cuts[j][b], *lr, 0.0
                children[i] = len(following), len(following) + 1
                following += lr
            stays = ~good[node[live]]
            settled[live[stays]] = np.array([value[t] for t in ids])[node[live[stays]]]
            live = live[~stays]
            if not following:
                break
            j, b = np.divmod(best[node[live]], bins)
            node[live] = children[node[live], (codes[live, j] > b).astype(int)]
            ids = np.array(following)
        score += settled
    if not roots:
        roots.append(new(0.0))
    return Trees(*(np.array(a) for a in (roots, feature, threshold, left, right, value)), depth, base)
