"""Small logistic models, fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic model by Newton's method with halved steps.

    With rows of one kind only, or none, the model is the smoothed share alone.
    """
    n, k = x.shape
    w = np.zeros(k + 1)
    share = (y.sum() + 0.5) / (n + 1)
    w[k] = np.log(share / (1 - share))
    if not n or y.min() == y.max():
        return w
    a = np.concatenate([x, np.ones((n, 1))], 1)
    penalty = np.full(k + 1, ridge)
    penalty[k] = 1e-3
    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0.0, z).sum() - (y * z).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = logistic(a @ w)
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(a.T @ (a * v[:, None]) + np.diag(penalty), a.T @ (y - p) - penalty * w)
        # a full step may overshoot where the classes come apart: it is halved until the loss falls
        size, then = 1.0, loss(w + step)
        while then > now and size > 1e-6:
            size /= 2
            then = loss(w + size * step)
        if then > now:
            break
        w, gain, now = w + size * step, now - then, then
        if gain < 1e-7 * max(now, 1.0):
            break
    return w
