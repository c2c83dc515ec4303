"""Histogram decision trees in numpy: random forests and gradient boosting for small feature tables.

Models are fitted on the driver on a bounded sample and applied inside workers; features are binned
by quantiles of the sample, so fitting costs rows x features per level, whatever the values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # left child; the right one follows it; 0 at a leaf
    value: np.ndarray

    def predict(self, binned: np.ndarray) -> np.ndarray:
        at = np.zeros(len(binned), np.int32)
        rows = np.arange(len(binned))
        while True:
            down = self.child[at]
            if not down.any():
                return self.value[at]
            right = binned[rows, self.feature[at]] > self.cut[at]
            at = np.where(down > 0, down + right, at)


def bin_edges(x: np.ndarray) -> np.ndarray:
    """Quantile cuts of every feature, features x (BINS - 1)."""
    return np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(x) else np.zeros((x.shape[1], BINS - 1))


def to_bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8) if len(x) else np.zeros(x.shape, np.uint8)


def grow(binned: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: float, tried: int, rng: np.random.Generator, shrink: float = 0.0) -> Tree:
    """One regression tree by variance reduction, level by level; ``tried`` features are drawn at every node."""
    d = binned.shape[1]
    feature, cut, child, value = [0], [0], [0], [0.0]
    drawn = np.flatnonzero(weight)  # rows without weight add nothing
    columns, weight, wt = np.ascontiguousarray(binned[drawn].T), weight[drawn], weight[drawn] * target[drawn]
    at = np.zeros(len(drawn), np.int64)
    level = [0]
    for step in range(depth + 1):
        k = len(level)
        place = np.full(len(feature), -1)
        place[level] = np.arange(k)
        local = place[at]
        w, s = np.bincount(local, weight, k), np.bincount(local, wt, k)
        for i, node in enumerate(level):
            value[node] = s[i] / (w[i] + shrink) if w[i] + shrink > 0 else 0.0
        if step == depth:
            break
        first = local * BINS
        best = np.full(k, 1e-9)
        bf, bc = np.zeros(k, int), np.zeros(k, int)
        use = np.zeros((k, d), bool)
        for i in range(k):
            use[i, rng.permutation(d)[:tried]] = True
        for j in range(d):
            if not use[:, j].any():
                continue
            key = first + columns[j]
            hw = np.bincount(key, weight, k * BINS).reshape(k, BINS).cumsum(1)[:, :-1]
            hs = np.bincount(key, wt, k * BINS).reshape(k, BINS).cumsum(1)[:, :-1]
            rw, rs = w[:, None] - hw, s[:, None] - hs
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = hs**2 / (hw + shrink) + rs**2 / (rw + shrink) - (s**2 / (w + shrink))[:, None]
            gain[(hw < least) | (rw < least) | ~use[:, [j]]] = 0
            gain = np.nan_to_num(gain)
            c = gain.argmax(1)
            g = gain[np.arange(k), c]
            up = g > best
            best[up], bf[up], bc[up] = g[up], j, c[up]
        after = []
        for i, node in enumerate(level):
            if best[i] > 1e-9:
                feature[node], cut[node], child[node] = bf[i], bc[i], len(feature)
                after += [len(feature), len(feature) + 1]
                for col, x in ((feature, 0), (cut, 0), (child, 0), (value, 0.0)):
                    col += [x, x]
        if not after:
            break
        f, c, h = np.array(feature), np.array(cut), np.array(child)
        going = np.flatnonzero(h[at] > 0)  # the others have come to a leaf
        at, columns, weight, wt = at[going], columns[:, going], weight[going], wt[going]
        at = h[at] + (columns[f[at], np.arange(len(at))] > c[at])
        level = after
    return Tree(np.array(feature), np.array(cut), np.array(child), np.array(value))


@dataclass
class Ensemble:
    edges: np.ndarray
    base: float
    rate: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = to_bins(np.asarray(x, float), self.edges)
        return self.base + self.rate * sum((t.predict(b) for t in self.trees), np.zeros(len(b)))


@dataclass
class Forests:
    """The mean of all trees of several forests, each with its own bins; cuts are taken back to values, so that nothing is binned again for each."""

    forests: list[Ensemble]

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        trees = [Tree(t.feature, f.edges[t.feature, t.cut], t.child, t.value) for f in self.forests for t in f.trees]
        return sum((t.predict(x) for t in trees), np.zeros(len(x))) / max(1, len(trees))


def random_forest(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 10, least: float = 3, seed: int = 7, weight: np.ndarray | None = None) -> Ensemble:
    """Bootstrap forest on 0/1 targets; ``predict`` gives the mean share of 1."""
    rng = np.random.default_rng(seed)
    edges = bin_edges(x)
    b = to_bins(x, edges)
    weight = np.ones(len(y)) if weight is None else weight
    tried = max(1, int(np.ceil(np.sqrt(x.shape[1]) * 1.5)))
    trees = [grow(b, y.astype(float), weight * rng.poisson(1.0, len(y)), depth, least, tried, rng) for _ in range(n_trees)]
    return Ensemble(edges, 0.0, 1 / max(1, n_trees), trees)


def out_of_bag(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 10, least: float = 3, seed: int = 7) -> np.ndarray:
    """The mean share of 1 of every row, by the trees whose bootstrap sample it was not in; the mean of ``y`` if there is none."""
    rng = np.random.default_rng(seed)
    b = to_bins(x, bin_edges(x))
    tried = max(1, int(np.ceil(np.sqrt(x.shape[1]) * 1.5)))
    total, votes = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(n_trees):
        drawn = rng.poisson(1.0, len(y))
        out = drawn == 0
        total[out] += grow(b, y.astype(float), drawn.astype(float), depth, least, tried, rng).predict(b[out])
        votes += out
    return np.where(votes > 0, total / np.maximum(votes, 1), y.mean() if len(y) else 0.0)


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 100, depth: int = 4, rate: float = 0.08, least: float = 5, share: float = 0.7, seed: int = 7) -> Ensemble:
    """Gradient-boosted regression trees for squared error, with row and feature subsampling."""
    rng = np.random.default_rng(seed)
    edges = bin_edges(x)
    b = to_bins(x, edges)
    base = float(y.mean()) if len(y) else 0.0
    now, trees = np.full(len(y), base), []
    tried = max(1, int(x.shape[1] * 0.6))
    for _ in range(rounds if len(y) else 0):
        t = grow(b, y - now, (rng.random(len(y)) < share).astype(float), depth, least, tried, rng, shrink=1.0)
        now = now + rate * t.predict(b)
        trees.append(t)
    return Ensemble(edges, base, rate, trees)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (x, fitted y) of the best nondecreasing fit, for np.interp."""
    order = np.argsort(x, kind="stable")
    xs, blocks = x[order], []
    for v in y[order]:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    fit = np.repeat([b[0] for b in blocks], [b[1] for b in blocks])
    return xs, fit
