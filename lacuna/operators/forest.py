"""Bagged classification trees grown level by level, all trees at once, over one block of rows or many.

A row is a line of bin codes and a place; how often a tree draws it is a Poisson
number keyed by (place, tree), so blocks need not know each other.  A level's
histograms, over (tree, node, bin, label) for each feature, are plain counts: a
block alone decides its splits from its own (`Forest.out_of_bag`), several blocks
add theirs up first (`cells`, `choose`, `walk`).  Rows that a tree did not draw walk
along with weight 0 and take the rate of the leaf they reach: the out-of-bag
probabilities.  Both ways give the same trees.

Rows of the same codes go the same way in every tree.  Where all lines of codes that
the features can have are few, a forest counts how often each tree draws each line
with each label, once, and grows from these counts (`line_counts`, `grow`): the same
histograms, so the same trees, and no row is met again before its out-of-bag trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rows times trees grown at once, at most: bounds a task's memory, and keeps its arrays near the processor.
ENTRIES = 200_000

#: Lines of bin codes, at most, that a forest counts as such: two features of 32 bins.
LINES = 1024

#: P(Poisson(1) <= k) of 64 bits, k from 0.
_UPTO = [int(2.0**64 * c) for c in np.cumsum([np.exp(-1) / f for f in np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8])])]


def _mixed(place: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """A mixed hash of place, tree and seed, trees first."""
    with np.errstate(over="ignore"):
        z = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None] + ((trees.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed % (1 << 32)) * np.uint64(0x8CB92BA72F3D8DD7))[:, None]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def draws(place: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """How often each tree draws each row, trees first: a Poisson(1) number from a mixed hash of place, tree and seed."""
    z = _mixed(place, trees, seed)
    out = np.zeros(z.shape, np.uint8)
    for c in _UPTO:
        out += z >= np.uint64(min(c, (1 << 64) - 1))
    return out


def left_out(place: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """Where ``draws`` is 0."""
    return _mixed(place, trees, seed) < np.uint64(_UPTO[0])


def best_splits(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node the feature (-1: a leaf), the last bin that goes left, and the rate, of counts (node, feature, bin, label).

    The split with the largest gain in squared error; of equals the first feature, then the first bin.
    """
    upto = h.cumsum(axis=2)
    left, part = upto.sum(axis=3)[:, :, :-1], upto[:, :, :-1, 1]
    m, p = upto[:, 0, -1].sum(axis=1), upto[:, 0, -1, 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = part**2 / left + (p[:, None, None] - part) ** 2 / (m[:, None, None] - left)
        gain = np.where((left > 0) & (left < m[:, None, None]), gain, -np.inf).reshape(len(h), -1)
        k = gain.argmax(axis=1)
        split = (m >= least) & (p > 0) & (p < m) & (gain[np.arange(len(h)), k] > -np.inf)
        feature, place = np.divmod(k, left.shape[2])
        return np.where(split, feature, -1), place, p / m


@dataclass(frozen=True)
class Forest:
    """Trees over bin codes below ``bins``; a node of fewer than ``least`` draws, or of one label, is a leaf."""

    n_trees: int = 200
    depth: int = 6
    least: int = 10
    bins: int = 32
    seed: int = 0

    def portions(self, n: int) -> list[np.ndarray]:
        """The trees in runs that a task grows at once."""
        step = max(1, ENTRIES // max(n, 1))
        return [np.arange(a, min(a + step, self.n_trees)) for a in range(0, self.n_trees, step)]

    def out_of_bag(self, codes: np.ndarray, y: np.ndarray, place: np.ndarray, levels: list | None = None) -> np.ndarray:
        """Of a block, codes feature by feature: the mean rate that trees which did not draw a row give it; NaN where all did.

        The trees are those of ``levels``, by default grown from the block as all there is.
        """
        n, f, by_line = len(y), len(codes), None
        if self.few_lines(f) and 2 * self.bins**f <= n:
            line = self.line_of(codes)
            by_line = self.walk(self.lines(f), levels or self.grow(f, self.line_counts(codes, y, place, np.arange(self.n_trees))), self.n_trees)[1]
        total, count = np.zeros(n), np.zeros(n)
        for trees in self.portions(n):
            out = left_out(place, trees, self.seed)
            if by_line is not None:
                rate = by_line[trees][:, line]
            elif levels:
                rate = self.walk(codes, [tuple(v[trees] for v in level) for level in levels], len(trees))[1]
            else:
                rate = self.rates(codes, y, draws(place, trees, self.seed))
            total += np.where(out, rate, 0).sum(axis=0)
            count += out.sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            return total / count

    def rates(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The rate of the leaf of every (tree, row) when the block is all there is."""
        t, n = weight.shape
        codes, f, rate = codes.astype(np.int64), len(codes), np.empty(t * n)
        entry, row, node, n_nodes = np.arange(t * n), np.tile(np.arange(n), t), np.repeat(np.arange(t), n), t
        w, label = weight.ravel().astype(float), np.tile(np.asarray(y, np.int64), t)
        for level in range(self.depth + 1):
            size = 2 * self.bins
            h = np.empty((n_nodes, f if level < self.depth else 1, self.bins, 2))
            for j in range(h.shape[1]):
                h[:, j] = np.bincount(node * size + codes[j][row] * 2 + label, w, n_nodes * size).reshape(n_nodes, self.bins, 2)
            feature, place, value = best_splits(h, self.least)
            if level == self.depth:
                feature[:] = -1
            split = feature >= 0
            ends = ~split[node]
            rate[entry[ends]] = value[node[ends]]
            if not split.any():
                break
            if ends.any():
                go = ~ends
                entry, row, node, w, label = entry[go], row[go], node[go], w[go], label[go]
            node = 2 * (np.cumsum(split) - 1)[node] + (codes[feature[node], row] > place[node])
            n_nodes = 2 * int(split.sum())
        return rate.reshape(t, n)

    # -- the same over many blocks: nodes of a level are numbered 0 to 2^level - 1 ------------------

    def walk(self, codes: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], t: int) -> tuple[np.ndarray, np.ndarray]:
        """(node at the level after the last one known, or -1 where a leaf was met; that leaf's rate), trees first.

        A level is (feature, last bin that goes left, rate), each by tree and node.
        """
        n = codes.shape[1]
        node, rate = np.zeros(t * n, np.int64), np.full(t * n, np.nan)
        tree, row, go = np.repeat(np.arange(t), n), np.tile(np.arange(n), t), np.arange(t * n)
        for feature, place, value in levels:
            at = (tree[go], node[go])
            f = feature[at]
            ends = f < 0
            rate[go[ends]] = value[at][ends]
            node[go[ends]] = -1
            go, f, cut = go[~ends], f[~ends], place[at][~ends]
            node[go] = 2 * node[go] + (codes[f, row[go]] > cut)
        return node.reshape(t, n), rate.reshape(t, n)

    def cells(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's part of a level's histograms: (cell, count) of the cells that are not empty."""
        live = (node >= 0) & (weight > 0)
        tree, row = np.nonzero(live)
        base, w = (tree << level) + node[live], weight[live].astype(float)
        f = len(codes) if level < self.depth else 1
        size, out = self.bins * 2, []
        for j in range(f):
            h = np.bincount(base * size + codes[j].astype(np.int64)[row] * 2 + y[row], w)
            at = np.flatnonzero(h)
            out.append(((at // size * f + j) * size + at % size, h[at]))
        return np.concatenate([a for a, _ in out]), np.concatenate([h for _, h in out]).astype(np.int64)

    def choose(self, cell: np.ndarray, count: np.ndarray, t: int, f: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The level's (feature, last bin that goes left, rate) by tree and node, from the summed cells of ``t`` trees."""
        f = f if level < self.depth else 1
        h = np.zeros(t * (1 << level) * f * self.bins * 2)
        h[cell] = count
        feature, place, value = best_splits(h.reshape(t << level, f, self.bins, 2), self.least)
        if level == self.depth:
            feature[:] = -1
        return tuple(v.reshape(t, 1 << level) for v in (feature, place, value))

    # -- few lines: all that the trees need of the rows is how often they draw each ---------------------

    def few_lines(self, f: int) -> bool:
        return self.bins**f <= LINES

    def lines(self, f: int) -> np.ndarray:
        """All lines of codes of ``f`` features, feature by feature."""
        return np.indices((self.bins,) * f).reshape(f, -1)

    def line_of(self, codes: np.ndarray) -> np.ndarray:
        """By row its place among ``lines``."""
        return np.ravel_multi_index(tuple(codes.astype(np.int64)), (self.bins,) * len(codes))

    def line_counts(self, codes: np.ndarray, y: np.ndarray, place: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """A block's part of how often each tree draws the lines with label 0 and then those with label 1, trees first."""
        k = self.bins ** len(codes)
        at, step = y * k + self.line_of(codes), max(1, ENTRIES // max(len(y), 1))
        out = np.zeros((len(trees), 2 * k))
        for a in range(0, len(trees), step):
            for t, w in enumerate(draws(place, trees[a : a + step], self.seed), a):
                out[t] = np.bincount(at, w, 2 * k)
        return out

    def grow(self, f: int, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The levels of trees that draw lines this often."""
        codes, y, t = np.tile(self.lines(f), 2), np.repeat([0, 1], self.bins**f), len(counts)
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(self.depth + 1):
            node, _ = self.walk(codes, levels, t)
            levels.append(self.choose(*self.cells(codes, y, counts, node, level), t, f, level))
        return levels
