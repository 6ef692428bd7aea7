"""Follow-the-regularised-leader, proximal, for sparse logistic models.

One learner for both classifiers: weights have a column for each class (one
column: binary). Per-coordinate rates and the L1 part keep most weights at
exactly zero; the L2 part makes the penalty an elastic net.
"""

from __future__ import annotations

import numpy as np


class Ftrl:
    """FTRL-proximal over `size` hashed features and `classes` columns."""

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z = np.zeros((size, classes))
        self.n = np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, target: np.ndarray) -> None:
        """One example: distinct features, their values, and the target of each column."""
        w = self.weights(at)
        raw = value @ w
        if raw.shape[0] == 1:
            p = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
        else:
            p = np.exp(raw - raw.max())
            p /= p.sum()
        g = value[:, None] * (p - target)[None, :]
        n = self.n[at]
        after = n + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[at] = after


def platt(raw: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back raw scores, by Newton steps.
    Without both classes: 1 and 0."""
    if len(np.unique(label)) < 2:
        return 1.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - label) * raw).sum() + 1e-3 * (a - 1), (p - label).sum()])
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
