"""Small linear models fitted within one task on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights (intercept last) of a ridge-penalised logistic regression by Newton's method."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    w = np.zeros(x.shape[1])

    def loss(w):
        m = x @ w
        return np.sum(np.logaddexp(0, m) - y * m) + 0.5 * np.sum(penalty * w * w)

    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        scale, now = 1.0, loss(w)
        while loss(w - scale * step) > now and scale > 1e-4:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-6:
            break
    return w
