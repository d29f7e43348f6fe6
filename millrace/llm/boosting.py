"""Gradient-boosted trees on binned features, trained on counts and written out as SQL.

The training set is a table of (bins, rows, positive rows): one line for each
combination of bins that occurs, so its size is bounded by the product of the
bins whatever the corpus. The trained trees become one SQL expression.
"""

from __future__ import annotations

import numpy as np


class Tree:
    """A leaf has a value; a node sends bins up to ``cut`` of feature ``at`` to the left."""

    def __init__(self, value: float = 0.0, at: int = -1, cut: int = 0, left: Tree | None = None, right: Tree | None = None):
        self.value, self.at, self.cut, self.left, self.right = value, at, cut, left, right

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.at] <= self.cut, self.left.apply(x), self.right.apply(x))

    def sql(self, names: list[str]) -> str:
        if self.left is None:
            return f"{self.value:.9f}D"
        return f"CASE WHEN {names[self.at]} <= {self.cut} THEN {self.left.sql(names)} ELSE {self.right.sql(names)} END"


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, shrink: float, ridge: float) -> Tree:
    def worth(a: np.ndarray | float, b: np.ndarray | float):  # noqa: ANN202
        return a * a / (b + ridge)

    best = (1e-6, -1, 0)
    if depth and len(x) > 1:
        for at in range(x.shape[1]):
            sums_g, sums_h = np.bincount(x[:, at], g), np.bincount(x[:, at], h)
            left_g, left_h = np.cumsum(sums_g)[:-1], np.cumsum(sums_h)[:-1]
            if len(left_g):
                gain = worth(left_g, left_h) + worth(g.sum() - left_g, h.sum() - left_h) - worth(g.sum(), h.sum())
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), at, i)
    if best[1] < 0:
        return Tree(float(shrink * g.sum() / (h.sum() + ridge)))
    low = x[:, best[1]] <= best[2]
    return Tree(0.0, best[1], best[2], _grow(x[low], g[low], h[low], depth - 1, shrink, ridge), _grow(x[~low], g[~low], h[~low], depth - 1, shrink, ridge))


class Boosted:
    def __init__(self, bias: float, trees: list[Tree]):
        self.bias, self.trees = bias, trees

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((t.apply(x) for t in self.trees), np.zeros(len(x)))

    def sql(self, names: list[str]) -> str:
        return " + ".join([f"{self.bias:.9f}D", *(f"({t.sql(names)})" for t in self.trees)])


def boost(x: np.ndarray, rows: np.ndarray, positive: np.ndarray, rounds: int = 25, depth: int = 3, shrink: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Logistic loss, every line weighted by its rows."""
    share = np.clip(positive.sum() / max(rows.sum(), 1), 1e-6, 1 - 1e-6)
    model = Boosted(float(np.log(share / (1 - share))), [])
    margin = model.margin(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, positive - rows * p, rows * p * (1 - p), depth, shrink, ridge)
        model.trees.append(tree)
        margin = margin + tree.apply(x)
    return model


def threshold(margin: np.ndarray, rows: np.ndarray, positive: np.ndarray, precision: float) -> float:
    """The least margin from which on so large a share is positive, midway to the next one below; infinite if there is none."""
    order = np.argsort(-margin, kind="stable")
    m, good, all_ = margin[order], np.cumsum(positive[order]), np.cumsum(rows[order])
    ends = np.append(m[1:] != m[:-1], True)
    fits = np.flatnonzero(ends & (good >= precision * all_))
    if not len(fits):
        return float("inf")
    last = int(fits[-1])
    return float((m[last] + m[last + 1]) / 2 if last + 1 < len(m) else m[last] - 1)
