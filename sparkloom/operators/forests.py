"""Forests on rows in memory: a task grows some of the trees on all rows, where pyspark.ml would pass over them once a level.

As in pyspark.ml: up to 32 bins a feature, Poisson bootstraps, a random subset of the features for each node (the
square root of their number, a third for regression), gini impurity or variance, and importances that are
each tree's gains times the node's weight, summing to 1, averaged.
"""

from __future__ import annotations

import math

import numpy as np

BINS, DEPTH = 32, 30
#: Rows of trees that are grown at once, and nodes that are split at once: what a task holds beside its rows.
AT_ONCE, NODES = 1_000_000, 1 << 13


def binned(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Bins of each column, by thresholds between the values of the rows ``train``."""
    out = np.zeros(x.shape, np.int64)
    for k in range(x.shape[1]):
        values, counts = np.unique(x[train, k], return_counts=True)
        middle = (values[1:] + values[:-1]) / 2
        if len(values) > BINS:
            share = np.cumsum(counts)[:-1] / counts.sum()
            middle = np.unique(middle[np.minimum(np.searchsorted(share, np.arange(1, BINS) / BINS), len(middle) - 1)])
        out[:, k] = np.searchsorted(middle, x[:, k], "left")
    return out


def _impurity(h: np.ndarray, regression: bool) -> tuple[np.ndarray, np.ndarray]:
    """(weight, impurity) of sums by class, or of weights, values and squares, on the last axis."""
    w = h[..., 0] if regression else h.sum(-1)
    safe = np.where(w > 0, w, 1.0)
    p = h / safe[..., None]
    return w, np.maximum(p[..., 2] - p[..., 1] ** 2, 0.0) if regression else 1 - (p * p).sum(-1)


def grow(bins: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, trees: int, seed: int, leaf: int = 2, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Importances of each of the trees, and the votes of all trees for the rows of weight 0, which aren't learned from: shares of classes, or the value (classes 0)."""
    rng, (n, features) = np.random.default_rng(seed), bins.shape
    regression, width = classes == 0, classes or 3
    subset = math.ceil(features / 3) if regression else math.ceil(math.sqrt(features))
    asked = weight == 0
    drawn = np.where(asked, 0, rng.poisson(1.0, (trees, n))).ravel().astype(float)
    row, node = np.tile(np.arange(n), trees), np.repeat(np.arange(trees), n)
    keep = (drawn > 0) | asked[row]
    row, node, drawn = row[keep], node[keep], drawn[keep]  # in order of node, at each level
    code, per = None, np.zeros(width)
    if not regression:
        code = y.astype(np.int64)
        per[code[~asked]] = weight[~asked]
        if (weight[~asked] != per[code[~asked]]).any():
            raise ValueError("rows of a class have one weight")
    tree, votes, gains = np.arange(trees), np.zeros((n, classes or 1)), np.zeros((trees, features))

    def sums(key: np.ndarray, row: np.ndarray, drawn: np.ndarray, size: int) -> np.ndarray:
        """Of weights, values and squares; or counts by class, to which ``per`` gives weight."""
        if regression:
            w = drawn * weight[row]
            return np.stack([np.bincount(key, w * y[row] ** k, size) for k in range(3)], axis=-1)
        return np.bincount(key * width + code[row], drawn, size * width).reshape(size, width)

    def splits(row: np.ndarray, node: np.ndarray, drawn: np.ndarray, total: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gain, feature, bin) of the best split of each node, over its bins that hold rows."""
        m = len(total)
        held, impurity = _impurity(total if regression else total * per, regression)
        best, feature, at = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for j in range(subset):
            key = node * BINS + bins[row, chosen[node, j]]
            counts = np.bincount(key, drawn, m * BINS)
            if regression:
                cell, count, by = np.arange(m * BINS), np.cumsum(counts.reshape(m, BINS), axis=1).ravel(), np.cumsum(sums(key, row, drawn, m * BINS).reshape(m, BINS, width), axis=1).reshape(-1, width)
                first, own, all_of = np.arange(m) * BINS, np.repeat(np.arange(m), BINS), total
                every = count[first + BINS - 1]
            else:
                cell = np.flatnonzero(counts)
                own = cell // BINS
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
                alone = sums(key, row, drawn, m * BINS)[cell]
                by = np.cumsum(alone, axis=0)  # of whole numbers, so exact
                by -= np.repeat(by[first] - alone[first], np.diff(np.append(first, len(cell))), axis=0)
                count, every, all_of = by.sum(-1), total.sum(-1), total * per
                by = by * per
            (wl, il), (wr, ir) = _impurity(by, regression), _impurity(all_of[own] - by, regression)
            gain = impurity[own] - (wl * il + wr * ir) / np.where(held > 0, held, 1.0)[own]
            gain[(count < leaf) | (every[own] - count < leaf)] = 0
            if not len(gain):
                break
            there = own[first]
            found = np.zeros(m)
            found[there] = np.maximum.reduceat(gain, first)
            place = np.zeros(m, np.int64)
            place[there] = cell[np.minimum.reduceat(np.where(gain == found[own], np.arange(len(cell)), len(cell)), first)] % BINS
            better = found > best
            best, feature, at = np.where(better, found, best), np.where(better, chosen[:, j], feature), np.where(better, place, at)
        return best, feature, at

    for level in range(depth + 1):
        m = len(tree)
        if not m:
            break
        total = sums(node, row, drawn, m)
        held = _impurity(total if regression else total * per, regression)[0]
        best, feature, at = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        chosen = np.argsort(rng.random((m, features)), axis=1)[:, :subset]
        for a in range(0, m if level < depth else 0, NODES):
            b = min(m, a + NODES)
            i, j = np.searchsorted(node, [a, b])
            best[a:b], feature[a:b], at[a:b] = splits(row[i:j], node[i:j] - a, drawn[i:j], total[a:b], chosen[a:b])
        split = best > 1e-12
        np.add.at(gains, (tree[split], feature[split]), (best * held)[split])
        ends = ~split[node] & asked[row]
        if ends.any():
            told = (total[:, 1:2] if regression else total * per) / np.where(held > 0, held, 1.0)[:, None]
            np.add.at(votes, row[ends], told[node[ends]])
        on = split[node]
        row, node, drawn = row[on], node[on], drawn[on]
        right = bins[row, feature[node]] > at[node]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        size = np.bincount(node, minlength=2 * int(split.sum()))
        before = np.stack([np.cumsum(size[k::2]) - size[k::2] for k in (0, 1)], axis=-1).ravel()  # rows on that side of the nodes before
        place = (np.cumsum(size) - size - before)[node] + np.where(right, np.cumsum(right), np.cumsum(~right)) - 1
        sorted_row, sorted_drawn = np.empty_like(row), np.empty_like(drawn)
        sorted_row[place], sorted_drawn[place] = row, drawn
        row, drawn, node = sorted_row, sorted_drawn, np.repeat(np.arange(len(size)), size)
        tree = np.repeat(tree[split], 2)
    whole = gains.sum(1, keepdims=True)
    return gains / np.where(whole > 0, whole, 1.0), votes


def grow_many(bins: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the trees' importances, and the votes of all of them, by as many trees at once as AT_ONCE lets; all at once where they fit."""
    step, found, votes = max(1, AT_ONCE // max(len(y), 1)), np.zeros(bins.shape[1]), np.zeros((len(y), classes or 1))
    for i in range(0, trees, step):
        more, told = grow(bins, y, classes, weight, min(step, trees - i), seed + i)
        found, votes = found + more.sum(0), votes + told
    return found, votes
