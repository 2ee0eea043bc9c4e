"""Small dense models fitted on the driver from bounded samples: logistic regression, step features, Platt scaling."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the weighted log loss of soft labels y with a ridge, by Adam on the full batch."""
    n, d = x.shape
    if not n:
        return np.zeros(d), 0.0
    weight = np.ones(n) if weight is None else weight
    share = weight / weight.sum()
    p = np.clip((share * y).sum(), 1e-4, 1 - 1e-4)
    w, b = np.zeros(d), float(np.log(p / (1 - p)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        err = (share * (sigmoid(x @ w.astype(x.dtype) + b) - y)).astype(x.dtype)  # in x's own type, or each product would copy x
        g = np.append(x.T @ err + l2 * w / weight.sum(), err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate a logit on held-out labels; the identity without both classes."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    w, b = logistic(logit[:, None], y, l2=0.1)
    return max(0.0, float(w[0])), b


def step_edges(column: np.ndarray, most: int = 9) -> list[float]:
    """Distinct inner quantiles of a feature: an indicator for reaching each makes a linear model additive in steps."""
    column = column[np.isfinite(column)]
    if not len(column):
        return []
    found = np.unique(np.quantile(column, np.linspace(0, 1, most + 2)[1:-1]))
    spread = np.unique(np.quantile(column, [0.01, 0.03, 0.97, 0.99]))
    return sorted({float(x) for x in np.concatenate([found, spread])})
