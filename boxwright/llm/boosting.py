"""Small gradient-boosted trees (logistic loss, histogram splits) and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: node k has children 2k+1 and 2k+2; a row goes right where its value is over the cut."""

    base: float
    depth: int
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least_hessian: float = 1.0) -> Trees:
    """Fits ``rounds`` trees to 0/1 labels."""
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    logit, inner = np.full(len(y), model.base), 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            own = node - first
            best = np.full(n, 1e-6)
            for f in range(x.shape[1]):
                key = own * bins + binned[:, f]
                gs = np.bincount(key, weights=g, minlength=n * bins).reshape(n, bins).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=n * bins).reshape(n, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least_hessian) | (ht - hs < least_hessian)] = 0
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                value = gain[np.arange(n), at]
                better = np.flatnonzero(value > best)
                best[better], feature[first + better], cut[first + better] = value[better], f, edges[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        step = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(step)
        logit += step[leaf]
    return model


@dataclass
class Isotonic:
    """A non-decreasing map from logits to probabilities, linear between its points."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, logit: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(logit, self.at, self.value), 0.0, 1.0)


def fit_isotonic(logit: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pools adjacent violators; equal logits are pooled first. Each end of a pool is a point."""
    if not len(y):
        return Isotonic(np.zeros(1), np.zeros(1))
    at, inverse, n = np.unique(logit, return_inverse=True, return_counts=True)
    mean = np.bincount(inverse, weights=y) / n
    pools: list[list[float]] = []  # mean, weight, first, last
    for m, w, x in zip(mean.tolist(), n.tolist(), at.tolist(), strict=True):
        pools.append([m, w, x, x])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, _, last = pools.pop()
            m1, w1, begin, _ = pools.pop()
            pools.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, begin, last])
    # a pool of n rows all of one class is not certain of it
    points = [(x, (m * w + 0.5 * total) / (w + total)) for m, w, a, b in pools for total in (1.0,) for x in ((a, b) if b > a else (a,))]
    value = np.maximum.accumulate([p[1] for p in points])
    return Isotonic(np.array([p[0] for p in points]), value)
