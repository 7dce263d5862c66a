"""Logistic regression for calibration and small classifiers: on a bounded number of
rows, or by Newton steps from sums over any number of them.

The driver must not start threads of a linear-algebra library (they can hang after
it has forked), so sums are written out; all sizes here are small.
"""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of a small matrix by elimination with row pivots."""
    n = len(a)
    rows = np.hstack([a.astype(float), np.eye(n)])
    for i in range(n):
        best = i + int(np.argmax(np.abs(rows[i:, i])))
        if abs(rows[best, i]) < 1e-300:
            raise ValueError("the matrix is singular")
        rows[[i, best]] = rows[[best, i]]
        rows[i] /= rows[i, i]
        factor = rows[:, i].copy()
        factor[i] = 0.0
        rows -= np.outer(factor, rows[i])
    return rows[:, n:]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights, intercept last, by Newton steps with a ridge penalty.

    Without rows, or with one class only, the weights are zero and the intercept
    is the smoothed log-odds of the class.
    """
    n, d = x.shape
    w = np.zeros(d + 1)
    share = (y.sum() + 0.5) / (n + 1.0)
    w[-1] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return w
    full = np.hstack([x, np.ones((n, 1))])
    each = np.ones(n) if weight is None else weight
    penalty = np.full(d + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid((full * w).sum(axis=1))
        gradient = (full * (each * (p - y))[:, None]).sum(axis=0) + penalty * w
        curve = np.einsum("ni,nj->ij", full * (each * p * (1 - p) + 1e-9)[:, None], full) + np.diag(penalty)
        step = (inverse(curve) * gradient).sum(axis=1)
        w -= step * min(1.0, 10.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def newton_sums(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows add to the gradient and the curvature at ``w``, without the penalty."""
    full = np.hstack([x, np.ones((len(x), 1))])
    p = sigmoid((full * w).sum(axis=1))
    gradient = (full * (weight * (p - y))[:, None]).sum(axis=0)
    return gradient, np.einsum("ni,nj->ij", full * (weight * p * (1 - p) + 1e-9)[:, None], full)


def newton_step(w: np.ndarray, gradient: np.ndarray, curve: np.ndarray, ridge: float) -> np.ndarray:
    """The step to subtract from ``w``, of bounded length, with the penalty of ``fit_logistic``."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    step = (inverse(curve + np.diag(penalty)) * (gradient + penalty * w)).sum(axis=1)
    return step * min(1.0, 10.0 / (np.abs(step).max() + 1e-12))


def apply_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid((x * w[:-1]).sum(axis=1) + w[-1])
