"""Histogram gradient-boosted trees for a yes/no label, flattened into arrays.

``fit`` is for a bounded sample on one machine; ``Trees.score`` walks all rows of a batch down
complete trees of fixed depth with numpy array lookups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray     # (trees, 2^depth - 1) int: feature tested at a node, in heap order
    threshold: np.ndarray   # (trees, 2^depth - 1) float: go right when value > threshold
    leaf: np.ndarray        # (trees, 2^depth) float: log-odds that a leaf adds
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
        l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boost ``trees`` trees of ``depth`` levels on the logistic loss.  Values are binned at
    quantiles once; each level sums gradients per (node, bin) and takes the best cut of each node.
    No rows, or one label only: a model that returns the (smoothed) share of label 1."""
    inner, ends = 2**depth - 1, 2**depth
    n, width = x.shape
    share = (float(np.sum(y)) + 0.5) / (n + 1.0)
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, ends)), float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    raw = np.full(n, model.base)
    feats, thrs, leaves = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            local = at - first
            for j in range(width):
                m = len(cuts[j])
                if not m:
                    continue
                key = local * (m + 1) + binned[j]
                sg = np.bincount(key, g, nodes * (m + 1)).reshape(nodes, m + 1).cumsum(1)
                sh = np.bincount(key, h, nodes * (m + 1)).reshape(nodes, m + 1).cumsum(1)
                gl, hl, gt, ht = sg[:, :-1], sh[:, :-1], sg[:, -1:], sh[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl)**2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                top = gain.argmax(1)
                val = gain[np.arange(nodes), top]
                better = val > best
                best[better] = val[better]
                feature[first:first + nodes][better] = j
                threshold[first:first + nodes][better] = cuts[j][top[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        end = at - inner
        leaf = rate * np.bincount(end, g, ends) / (np.bincount(end, h, ends) + l2)
        raw += leaf[end]
        feats.append(feature)
        thrs.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(feats), np.array(thrs), np.array(leaves), model.base)
