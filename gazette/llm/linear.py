"""Small linear models fitted with numpy on a bounded sample of rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias for binary features: feature cols[i] is set in row rows[i]. Accelerated full-batch descent."""
    n = max(len(y), 1)
    w, v, b, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    per_row = np.bincount(rows, minlength=len(y)).max() + 1 if len(rows) else 1
    rate = 4.0 / per_row
    for k in range(steps):
        m = k / (k + 3)
        lw, lb = w + m * v, b + m * vb
        p = sigmoid(np.bincount(rows, lw[cols], len(y)) + lb) if len(rows) else sigmoid(np.full(len(y), lb))
        g = (p - y) / n
        nw = lw - rate * n / max(y.sum(), 1) * 0.5 * (np.bincount(cols, g[rows], width) + l2 * lw) if len(rows) else lw
        nb = lb - rate * n / max(y.sum(), 1) * 0.5 * g.sum()
        v, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 150) -> np.ndarray:
    """Weights, the last one the bias, of a linear support vector machine with squared hinge loss; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    y = y.astype(np.float32)
    n, d = x.shape
    share = (np.where(y > 0, n / max((y > 0).sum(), 1), n / max((y < 0).sum(), 1)) / 2).astype(np.float32)
    w, v = np.zeros(d, np.float32), np.zeros(d, np.float32)
    u = np.ones(d, np.float32)
    for _ in range(25):  # the largest curvature, by powers
        u = x.T @ (share * (x @ (u / np.linalg.norm(u))))
    top = np.float32(1.0 / c / n + 2.2 * np.linalg.norm(u) / n)
    for k in range(steps):
        at = w + np.float32(k / (k + 3)) * v
        slack = np.maximum(0, 1 - y * (x @ at)) * share
        new = at - (at * np.float32(1 / c / n) - x.T @ (slack * y) * np.float32(2 / n)) / top
        v, w = new - w, new
    return w
