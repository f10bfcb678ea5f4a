"""Gradient-boosted trees for two classes: fitted in numpy, applied as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: Split | Leaf
    high: Split | Leaf


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: float) -> Split | Leaf:
    """A tree on gradients g and second derivatives h, by exact splits."""
    best, rest = (1e-6, 0, 0.0), g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]) if depth else []:
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - rest
        gain[(v[1:] == v[:-1]) | (hs[:-1] < least) | (hs[-1] - hs[:-1] < least)] = 0
        if len(gain) and gain.max() > best[0]:
            k = int(gain.argmax())
            best = (float(gain[k]), f, float(v[k] + v[k + 1]) / 2)
    if best[0] <= 1e-6:
        return Leaf(float(-rate * g.sum() / (h.sum() + 1)))
    low = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], _grow(x[low], g[low], h[low], depth - 1, rate, least), _grow(x[~low], g[~low], h[~low], depth - 1, rate, least))


def _value(tree: Split | Leaf, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, _value(tree.low, x), _value(tree.high, x))


@dataclass(frozen=True)
class Model:
    """Trees, the calibration of their sum, and the probability from which a row is accepted."""

    trees: tuple[Split | Leaf, ...]
    slope: float
    shift: float
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))

    def column(self, features: list[Column]) -> Column:
        """The probability as an expression over the features."""

        def of(tree: Split | Leaf) -> Column:
            if isinstance(tree, Leaf):
                return F.lit(tree.value)
            return F.when(features[tree.feature] <= F.lit(tree.at), of(tree.low)).otherwise(of(tree.high))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + of(t)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * total + F.lit(self.shift))))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 12, depth: int = 3, rate: float = 0.5, least: float = 1.0, precision: float = 0.99) -> Model:
    """Fit on two thirds of the rows, calibrate and set the threshold on the rest.

    The threshold lies below the lowest probability from which on at least ``precision``
    of the held-out rows are positive, half-way to the next one, and at 0.5 at least; it
    is above 1, so that nothing is accepted, if there is none.
    """
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    out = np.arange(len(y)) % 3 == 2
    margin, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x[~out], (p - y)[~out], (p * (1 - p))[~out], depth, rate, least)
        trees.append(tree)
        margin += _value(tree, x)
    slope, shift = _calibrated(margin[out], y[out])
    p, label = 1 / (1 + np.exp(-(slope * margin[out] + shift))), y[out]
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal probabilities are accepted together
    good = np.flatnonzero(last & (share >= precision) & (p[order] >= 0.5))
    if not len(good):
        return Model(tuple(trees), slope, shift, 2.0)
    k = int(good[-1])
    below = float(p[order][k + 1]) if k + 1 < len(order) else 0.0
    return Model(tuple(trees), slope, shift, max(0.5, (float(p[order][k]) + below) / 2))


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = p * (1 - p)
        grad = np.array([(margin * (p - y)).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        hess = np.array([[(w * margin**2).sum() + 0.1, (w * margin).sum()], [(w * margin).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-10:
            break
    return a, b
