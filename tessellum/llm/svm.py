"""A small linear support vector machine: squared hinge loss, full-batch accelerated gradients."""

from __future__ import annotations

import numpy as np


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, reg: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept for labels y of -1 and 1."""
    n, d = x.shape
    weight = np.ones(n) if weight is None else weight
    weight = (weight / weight.sum()).astype(x.dtype)
    y = y.astype(x.dtype)
    # A bound on the curvature from the power method.
    v = np.ones(d, x.dtype) / np.sqrt(d)
    for _ in range(8):
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1.0 / (2 * (float(v @ (x.T @ (weight * (x @ v)))) + 1.0) + reg)
    w, b = np.zeros(d, x.dtype), 0.0
    seen_w, seen_b, t = w, b, 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ seen_w + seen_b))
        pull = -2 * weight * y * gap
        new_w = seen_w - step * (x.T @ pull + reg * seen_w)
        new_b = seen_b - step * float(pull.sum())
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        seen_w, seen_b, t = new_w + (t - 1) / u * (new_w - w), new_b + (t - 1) / u * (new_b - b), u
        w, b = new_w, new_b
    return w, float(b)


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a and b with 1 / (1 + exp(-(a * score + b))) the probability of label 1; smoothed targets, Newton steps."""
    pos, neg = int(labels.sum()), int((1 - labels).sum())
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * scores + b
        return float(np.sum(np.logaddexp(0, z) - target * z))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -500, 500)))
        g = np.array([np.sum((p - target) * scores), np.sum(p - target)])
        q = p * (1 - p) + 1e-9
        h = np.array([[np.sum(q * scores * scores) + 1e-6, np.sum(q * scores)], [np.sum(q * scores), np.sum(q) + 1e-6]])
        move = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-4 and loss(a - size * move[0], b - size * move[1]) > loss(a, b):
            size /= 2
        a, b = a - size * move[0], b - size * move[1]
        if np.abs(size * move).max() < 1e-7:
            break
    return float(a), float(b)
