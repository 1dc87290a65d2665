"""Sparse linear models for kernels: follow-the-regularised-leader with elastic-net penalties."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate FTRL-proximal: rates, L1 and L2 penalties, passes over the rows."""
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.5
    epochs: int = 3


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _weights(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0.0)
    return -shrunk / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)


def train(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], n_features: int, n_classes: int,
          params: Ftrl = Ftrl()) -> np.ndarray:
    """Weights ``(n_features + 1, n_classes)`` of a multinomial logistic model; the last row is the bias.

    ``rows`` are ``(indices, values, class)`` with distinct indices, visited in
    their order in every pass: the caller fixes an order and so the result.
    """
    z = np.zeros((n_features + 1, n_classes))
    n = np.zeros((n_features + 1, n_classes))
    for _ in range(params.epochs):
        for index, value, label in rows:
            at = np.append(index, n_features)
            x = np.append(value, 1.0)[:, None]
            zi, ni = z[at], n[at]
            w = _weights(zi, ni, params)
            error = softmax((x * w).sum(0))
            error[label] -= 1.0
            g = x * error
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / params.alpha * w
            n[at] = grown
    return _weights(z, n, params)


def logits(weights: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    return value @ weights[index] + weights[-1]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood (golden section on its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))
