"""Gradient-boosted trees for a logistic loss, small enough to ship to every task."""

from __future__ import annotations

import numpy as np


def _grow(x, g, h, rows, depth, cuts, least, nodes):
    """Append the best tree over ``rows``; a node is (feature, cut, left, right, value)."""
    at = len(nodes)
    nodes.append(None)
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, edges in enumerate(cuts):
            for cut in edges:
                left = x[rows, f] <= cut
                n = int(left.sum())
                if n < least or len(rows) - n < least:
                    continue
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                if gain > best[0]:
                    best = (gain, f, cut)
    if best[1] is None:
        nodes[at] = (-1, 0.0, 0, 0, value)
        return at
    left = x[rows, best[1]] <= best[2]
    a = _grow(x, g, h, rows[left], depth - 1, cuts, least, nodes)
    b = _grow(x, g, h, rows[~left], depth - 1, cuts, least, nodes)
    nodes[at] = (best[1], float(best[2]), a, b, value)
    return at


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 8, least: int = 5) -> list[list[tuple]]:
    """Boost ``trees`` trees on rows x with labels y in {0, 1}."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    score, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes: list = []
        _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), depth, cuts, least, nodes)
        nodes = [(f, c, a, b, rate * v) for f, c, a, b, v in nodes]
        out.append(nodes)
        score += predict([nodes], x)
    return out


def predict(model: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """The sum of the trees' values, a log-odds."""
    score = np.zeros(len(x))
    for nodes in model:
        feature, cut, left, right, value = (np.array(c) for c in zip(*nodes))
        at = np.zeros(len(x), np.int64)
        for _ in range(len(nodes)):
            inner = feature[at] >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        score += value[at]
    return score


def platt(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is calibrated on held-out rows; Newton steps with smoothed labels."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * score + b)))
        w = p * (1 - p) + 1e-9
        ga, gb = ((p - t) * score).sum() + 1e-3 * (a - 1), (p - t).sum()
        haa, hab, hbb = (w * score * score).sum() + 1e-3, (w * score).sum(), w.sum() + 1e-6
        det = haa * hbb - hab * hab + 1e-12
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        a = max(a, 1e-3)
    return float(a), float(b)
