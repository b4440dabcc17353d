"""Linear support vector machines by dual coordinate descent, and Platt's probabilities for their margins."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int, cost: np.ndarray, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (the last one is the bias) that minimise |w|^2 / 2 + sum of cost * hinge loss.

    rows: (distinct indices below n, values) of each example; labels are 1 and -1."""
    w = np.zeros(n + 1)
    alpha = np.zeros(len(rows))
    diagonal = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            index, value = rows[i]
            y = labels[i]
            gradient = y * (w[index] @ value + w[n]) - 1
            old = alpha[i]
            new = min(max(old - gradient / diagonal[i], 0.0), cost[i])
            if new != old:
                alpha[i] = new
                step = (new - old) * y
                w[index] += step * value
                w[n] += step
                worst = max(worst, abs(new - old))
        if worst < 1e-4:
            break
    return w


def platt(margins: np.ndarray, positive: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a m + b))) fits how often margins m are positive; a is 0 at least."""
    ones, zeros = positive.sum(), (~positive).sum()
    if not len(margins) or not ones or not zeros:
        share = (ones + 1) / (ones + zeros + 2)
        return 1.0, float(np.log(share / (1 - share)))
    target = np.where(positive, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    loss = lambda a, b: np.sum(np.logaddexp(0, a * margins + b) - target * (a * margins + b))
    now = loss(a, b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([np.sum((p - target) * margins), np.sum(p - target)])
        s = p * (1 - p)
        h = np.array([[np.sum(s * margins**2), np.sum(s * margins)], [np.sum(s * margins), np.sum(s)]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        new = loss(a, b)
        if now - new < 1e-9 * max(1, abs(now)):
            break
        now = new
    return max(float(a), 0.0), float(b)


def probability(margins: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
