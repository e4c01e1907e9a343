"""Gradient-boosted regression trees for binary labels, on a bounded training matrix; prediction is vectorised numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: for each tree feature and threshold of every inner node and the leaf values; a base margin per row is added by the caller."""

    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    depth: int = 3

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, base: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: float = 2.0, l2: float = 1.0) -> Boosted:
    """Newton boosting of the log loss with exact-enough histogram splits (32 quantile bins); rows and features are those given, nothing is sampled."""
    model = Boosted(depth=depth)
    if len(y) == 0:
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    m = base.copy()
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-m))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        f, t = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                best = 1e-6
                if len(at):
                    gs, hs = g[at].sum(), h[at].sum()
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[at, j]
                        gl = np.cumsum(np.bincount(b, g[at], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[at], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        gain[(hl < least * 0.05) | (hs - hl < least * 0.05)] = 0
                        i = int(np.argmax(gain))
                        if gain[i] > best:
                            best, f[k], t[k] = gain[i], j, c[i]
            go = x[np.arange(len(y)), f[node]] > t[node]
            node = 2 * node + 1 + go
        leaf = node - inner
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        m += v[leaf]
        model.feature.append(f)
        model.threshold.append(t)
        model.leaf.append(v)
        if np.abs(v).max() < 1e-3:
            break
    return model


def calibrated_threshold(score: np.ndarray, y: np.ndarray, default: float = 0.5) -> float:
    """The probability cut with the best F1 on held-out rows, in the middle of the gap around it; the default where held-out rows are too few or of one kind."""
    if y.sum() < 5 or len(y) - y.sum() < 5:
        return default
    o = np.argsort(-score, kind="stable")
    s, t = score[o], y[o]
    tp = np.cumsum(t)
    f1 = 2 * tp / (np.arange(1, len(t) + 1) + t.sum())
    ends = np.flatnonzero(np.concatenate([s[1:] < s[:-1], [True]]))
    k = ends[int(np.argmax(f1[ends]))]
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float(min(max((s[k] + below) / 2, 0.1), 0.9))
