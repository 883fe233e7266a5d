"""Sparse multinomial logistic regression, trained by follow-the-regularised-leader (proximal)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Example = tuple[np.ndarray, np.ndarray, int]  # feature numbers, values, class


@dataclass
class Ftrl:
    """Per-coordinate learning rates; the elastic net keeps weights of weak features at exactly zero."""

    features: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.01
    z: np.ndarray = field(init=False)
    squares: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z = np.zeros((self.features, self.classes))
        self.squares = np.zeros((self.features, self.classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, rate = self.z[rows], (self.beta + np.sqrt(self.squares[rows])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def learn(self, features: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(features)
        error = softmax(values @ weights)
        error[label] -= 1.0
        gradient = values[:, None] * error
        squares = self.squares[features]
        added = gradient * gradient
        self.z[features] += gradient - (np.sqrt(squares + added) - np.sqrt(squares)) / self.alpha * weights
        self.squares[features] = squares + added

    def fit(self, examples: list[Example], epochs: int, seed: int = 7) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(examples)):
                self.learn(*examples[k])
        return self


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which held-back labels are likeliest, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high, golden = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
