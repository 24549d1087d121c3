"""Small gradient-boosted trees on binned features, logistic loss, with calibrated scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BIN_COUNT = 32


@dataclass
class Boosted:
    """Complete binary trees of one depth, node i with children 2i+1 and 2i+2; score = logistic(slope * margin + shift).

    features and cuts are (trees, inner nodes), values (trees, leaves); a node that does not split has an infinite cut.
    """

    features: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        at = np.zeros((len(x), len(self.features)), np.int64)
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.features))[None, :]
        inner = self.features.shape[1]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.features[trees, at]] > self.cuts[trees, at])
        return at - inner

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.full(len(x), self.base)
        return self.base + self.values[np.arange(len(self.features))[None, :], self.leaves(x)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -50, 50))) if len(x) else np.zeros(0)


def _tree(bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int, rate: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree for the loss's slope and curve: features, cuts, values, and each row's leaf."""
    n_features, width = len(cuts), BIN_COUNT
    first, nodes = (1 << depth) - 1, np.zeros(len(bins), np.int64)
    feature, cut = np.zeros(first, np.int64), np.full(first, np.inf)
    keys = bins + np.arange(n_features) * width
    usable = np.zeros((n_features, width - 1), bool)
    for f, c in enumerate(cuts):
        usable[f, : len(c)] = True
    for node in range(first):
        rows = np.flatnonzero(nodes == node)
        to = np.zeros(len(rows), np.int64)
        if len(rows) >= 2 * least:
            flat = keys[rows].ravel()
            sums = [np.bincount(flat, w, n_features * width).reshape(n_features, width).cumsum(1)[:, :-1] for w in (np.repeat(slope[rows], n_features), np.repeat(curve[rows], n_features), None)]
            g, h, n = slope[rows].sum(), curve[rows].sum(), len(rows)
            gain = sums[0] ** 2 / (sums[1] + 1) + (g - sums[0]) ** 2 / (h - sums[1] + 1) - g**2 / (h + 1)
            gain[~usable | (sums[2] < least) | (n - sums[2] < least)] = 0
            best = int(gain.argmax())
            f, b = divmod(best, width - 1)
            if gain[f, b] > 1e-6:
                feature[node], cut[node] = f, cuts[f][b]
                to = (bins[rows, f] > b).astype(np.int64)
        nodes[rows] = 2 * node + 1 + to
    leaf = nodes - first
    g, h = (np.bincount(leaf, w, first + 1) for w in (slope, curve))
    return feature, cut, rate * g / (h + 1), leaf


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5) -> Boosted:
    """Trees for labels 0 and 1; without both, a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(base=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BIN_COUNT + 1)[1:-1], method="lower")) for column in x.T]
    cuts = [c[c < column.max()] for c, column in zip(cuts, x.T)]
    bins = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    margin = np.full(len(y), model.base)
    made = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        *tree, leaf = _tree(bins, cuts, y - p, p * (1 - p), depth, rate, least)
        made.append(tree)
        margin += tree[2][leaf]
    model.features, model.cuts, model.values = (np.stack([t[i] for t in made]) for i in range(3))
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Fits the model's logistic calibration on held-out rows and returns the least threshold whose precision there, counted
    with one false alarm more, is as asked for; 0.5 at least, and above 1 (nothing is selected) if there is none."""
    if len(np.unique(y)) < 2:
        return 1.1
    z = model.margin(x)
    w = np.array([1.0, 0.0])
    design = np.stack([z, np.ones(len(z))], axis=1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):  # with a pull towards the uncalibrated margin, and short steps, as classes may be quite apart
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        slope = design.T @ (target - p) - (w - [1.0, 0.0])
        w += np.clip(np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(2), slope), -0.5, 0.5)
    model.slope, model.shift = map(float, w)
    score = model.score(x)
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / (np.arange(len(y)) + 2)
    good = np.flatnonzero(right >= precision)
    if not len(good):
        return 1.1
    last = score[order[good[-1]]]
    below = score[score < last]
    return max(0.5, float(last + (below.max() if len(below) else 0)) / 2)
