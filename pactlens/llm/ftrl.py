"""Follow-the-regularised-leader with elastic-net penalties, for sparse rows of numbered features."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Multinomial (two or more classes) logistic regression; per-coordinate steps, weights exactly zero within ``l1``."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.bias = np.zeros(classes)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights(at) + self.bias

    def learn(self, at: np.ndarray, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        error = softmax(x @ w + self.bias)
        error[label] -= 1
        error *= weight
        g = x[:, None] * error
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        self.bias -= 0.02 * error


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on held-back rows, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(scores / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    for _ in range(40):
        if loss(a) <= loss(b):
            high, b = b, a
            a = high - ratio * (high - low)
        else:
            low, a = a, b
            b = low + ratio * (high - low)
    return float(np.exp((low + high) / 2))
