"""VEC1 to VEC7: similarity and classification over array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """VEC1. Cosine of unit vectors, summed in double; null if either is."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def rounded3(x: Column) -> Column:
    """VEC5. Three decimals, halves towards plus infinity."""
    return F.floor(x * 1000 + 0.5) / 1000


def train_linear(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 150, rate: float = 0.05, l2: float = 3e-5) -> np.ndarray:
    """VEC6. Multinomial logistic regression: zero start, full-batch Adam, L2 on weights only, float32. (classes, dim + 1)."""
    x = np.hstack([x.astype(np.float32), np.ones((len(x), 1), np.float32)])
    w = np.zeros((classes, x.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    goal = np.eye(classes, dtype=np.float32)[y]
    for t in range(1, epochs + 1):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - goal).T @ x / len(x)
        g[:, :-1] += l2 * w[:, :-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def probabilities(embedding: Column, weights: np.ndarray) -> Column:
    """VEC7. array<double> of class probabilities, by a shifted softmax over literal weights."""
    z = F.array(*[dot(embedding, F.array(*[F.lit(float(q)) for q in row[:-1]])) + F.lit(float(row[-1])) for row in weights])
    e = F.transform(z, lambda s: F.exp(s - F.array_max(z)))
    total = F.aggregate(e, F.lit(0.0), lambda s, t: s + t)
    return F.transform(e, lambda s: s / total)
