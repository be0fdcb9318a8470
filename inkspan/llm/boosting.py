"""Gradient-boosted trees on a bounded sample, fitted on the driver and turned into Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """feature and cut: left if the value is at most cut. A leaf has only value."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    base: float
    trees: tuple[Node, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        return self.base + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, value: Callable[[str], Column]) -> Column:
        """Log-odds as an expression; value gives the column of a feature's name."""

        def of(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(value(self.names[node.feature]) <= node.cut, of(node.left)).otherwise(of(node.right))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + of(t)
        return total


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    left = x[:, node.feature] <= node.cut
    out = np.empty(len(x))
    out[left], out[~left] = _apply(node.left, x[left]), _apply(node.right, x[~left])
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: int = 5) -> Model:
    """Logistic loss with second-order steps; cuts are tried at quantiles of each feature."""
    mean = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(names))]
    slots = [np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)]  # value <= cut[j] for slot <= j
    score, trees = np.full(len(x), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Node:
        sg, sh = g[rows].sum(), h[rows].sum()
        leaf = Node(value=float(-rate * sg / (sh + ridge)))
        best, at = 1e-6, None
        if left and len(rows) >= 2 * least:
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                s = slots[k][rows]
                n = np.cumsum(np.bincount(s, minlength=len(c) + 1))[:-1]
                gl = np.cumsum(np.bincount(s, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(s, h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (sg - gl) ** 2 / (sh - hl + ridge) - sg**2 / (sh + ridge)
                gain[(n < least) | (len(rows) - n < least)] = 0
                j = int(np.argmax(gain))
                if gain[j] > best:
                    best, at = float(gain[j]), (k, j)
        if at is None:
            return leaf
        k, j = at
        go = slots[k][rows] <= j
        return Node(feature=k, cut=float(cuts[k][j]), left=grow(rows[go], g, h, left - 1), right=grow(rows[~go], g, h, left - 1))

    for _ in range(rounds if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(x)), p - y, p * (1 - p), depth)
        trees.append(tree)
        score = score + _apply(tree, x)
    return Model(tuple(names), base, tuple(trees))


def threshold(score: np.ndarray, y: np.ndarray, precision: float, prior: int = 0) -> float:
    """The least score from which on at least this share of the rows is positive, with `prior` positives and as many negatives
    added to them, so that few rows prove little; infinite if there is none."""
    order = np.argsort(-score, kind="stable")
    share = (np.cumsum(y[order]) + prior) / (np.arange(1, len(y) + 1) + 2 * prior)
    last = np.append(score[order][1:] != score[order][:-1], True) if len(y) else np.zeros(0, bool)  # equal scores go together
    good = np.flatnonzero((share >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else float("inf")
