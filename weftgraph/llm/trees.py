"""Bagged classification trees and random forests on histogram-binned features.

Fitted on the driver from a bounded sample that the caller draws; prediction is vectorised and runs in the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

MAX_BINS = 64


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)  # -1 for a leaf
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1


@dataclass
class Forest:
    """The mean of its trees' leaf rates."""

    trees: list[Tree]
    oob: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            total += predict_tree(t, x)
        return total / max(1, len(self.trees))


def predict_tree(t: Tree, x: np.ndarray) -> np.ndarray:
    feature, cut = np.array(t.feature), np.array(t.cut)
    left, right, value = np.array(t.left), np.array(t.right), np.array(t.value)
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        f = feature[at]
        open_ = f >= 0
        if not open_.any():
            return value[at]
        rows = np.flatnonzero(open_)
        node = at[rows]
        at[rows] = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])


def _edges(column: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring quantile values."""
    q = np.unique(np.quantile(column, np.linspace(0, 1, MAX_BINS), method="nearest"))
    return (q[1:] + q[:-1]) / 2


def fit_forest(
    x: np.ndarray, y: np.ndarray, *, n_trees: int = 30, max_depth: int = 10, min_leaf: int = 5, features: float = 1.0, seed: int = 7
) -> Forest:
    """``features``: share of the features that each node may split on (1 gives bagging). Needs no class to be present."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    if not n:
        return Forest([])
    edges = [_edges(x[:, j]) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int64)
    votes, seen = np.zeros(n), np.zeros(n)
    trees = []
    for _ in range(n_trees):
        rows = rng.integers(0, n, n)
        t = Tree()
        stack = [(t.add(float(y[rows].mean())), rows, 0)]
        while stack:
            node, idx, depth = stack.pop()
            ones, size = float(y[idx].sum()), len(idx)
            if depth >= max_depth or size < 2 * min_leaf or ones in (0.0, float(size)):
                continue
            best = (1e-12, -1, -1)
            pick = rng.permutation(d)[: max(1, round(features * d))] if features < 1 else range(d)
            parent = ones * (size - ones) / size
            for j in pick:
                if not len(edges[j]):
                    continue
                bins = binned[idx, j]
                count = np.bincount(bins, minlength=len(edges[j]) + 1).cumsum()[:-1].astype(float)
                hit = np.bincount(bins, weights=y[idx], minlength=len(edges[j]) + 1).cumsum()[:-1]
                ok = (count >= min_leaf) & (size - count >= min_leaf)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    impurity = hit * (count - hit) / count + (ones - hit) * (size - count - ones + hit) / (size - count)
                gain = np.where(ok, parent - impurity, -1.0)
                # of equal gains the middle cut, which lies furthest from both classes
                top = np.flatnonzero(gain >= gain.max() - 1e-12)
                k = top[len(top) // 2]
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] < 0:
                continue
            _, j, k = best
            go = binned[idx, j] <= k
            t.feature[node], t.cut[node] = int(j), float(edges[j][k])
            for side, part in (("left", idx[go]), ("right", idx[~go])):
                child = t.add(float(y[part].mean()))
                getattr(t, side)[node] = child
                stack.append((child, part, depth + 1))
        trees.append(t)
        out = np.ones(n, dtype=bool)
        out[rows] = False
        votes[out] += predict_tree(t, x[out])
        seen[out] += 1
    with np.errstate(invalid="ignore", divide="ignore"):
        oob = votes / seen
    return Forest(trees, oob)
