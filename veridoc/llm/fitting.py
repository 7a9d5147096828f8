"""Small models that the driver fits on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the intercept, by damped Newton steps; few features."""
    one = np.c_[x, np.ones(len(x))]
    ridge = np.full(one.shape[1], l2)
    ridge[-1] = 1e-6
    w, sw = np.zeros(one.shape[1]), np.ones(len(x)) if weights is None else weights
    for _ in range(rounds):
        p = sigmoid(one @ w)
        gradient = one.T @ (sw * (p - y)) + ridge * w
        step = np.linalg.solve((one * (sw * p * (1 - p) + 1e-9)[:, None]).T @ one + np.diag(ridge), gradient)
        w -= step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit_sparse_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, *, l2: float = 1e-4, epochs: int = 12, rate: float = 0.5, weights: np.ndarray | None = None, seed: int = 7) -> np.ndarray:
    """Weights (intercept last) of a logistic model over sparse rows (indices, values) by AdaGrad; the order is seeded."""
    w, g = np.zeros(dims + 1), np.full(dims + 1, 1e-6)
    order = np.random.default_rng(seed)
    sw = np.ones(len(rows)) if weights is None else weights
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            p = 1 / (1 + np.exp(-np.clip(v @ w[at] + w[-1], -35, 35)))
            e = sw[i] * (p - y[i])
            d = e * v + l2 * w[at]
            g[at] += d * d
            w[at] -= rate * d / np.sqrt(g[at])
            g[-1] += e * e
            w[-1] -= rate * e / np.sqrt(g[-1])
    return w
