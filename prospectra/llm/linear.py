"""Softmax regression on sparse binary features, fitted on a bounded sample by full-batch steps."""

from __future__ import annotations

import numpy as np


def fit_softmax(rows: list[np.ndarray], values: list[np.ndarray] | None, y: np.ndarray, dim: int, classes: int, l2: float = 1e-4, steps: int = 300, rate: float = 0.3, balanced: bool = False) -> np.ndarray:
    """Weights (dim + 1, classes), the last row the bias. ``rows`` holds the feature ids of each row; ``balanced`` gives each class the same weight."""
    w = np.zeros((dim + 1, classes))
    if not len(y):
        return w
    row = np.repeat(np.arange(len(rows), dtype="i4"), [len(r) for r in rows])
    col = np.concatenate(rows).astype("i4") if len(row) else np.zeros(0, "i4")
    val = np.concatenate(values) if values is not None and len(row) else np.ones(len(col))
    target = np.eye(classes)[y]
    share = 1 / np.maximum(np.bincount(y, minlength=classes), 1)[y] / classes if balanced else np.full(len(y), 1 / len(y))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.column_stack([np.bincount(row, w[col, k] * val, len(y)) for k in range(classes)]) + w[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = (p / p.sum(axis=1, keepdims=True) - target) * share[:, None]
        grad = np.vstack([np.column_stack([np.bincount(col, off[row, k] * val, dim) for k in range(classes)]) + l2 * w[:-1], off.sum(axis=0)])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2  # Adam
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w
