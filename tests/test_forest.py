"""The level-wise forest against trees grown one node at a time, out of bag, and over blocks."""

import numpy as np
import pytest

from lacuna.operators import forest
from lacuna.operators.forest import Forest, draws, left_out


def by_node(codes, y, f, depth):
    """A tree by recursion over drawn rows: a function of one row's codes."""
    m, p = len(y), y.sum()
    best, rule = -np.inf, None
    if depth and m >= f.least and 0 < p < m:
        for j in range(len(codes)):
            for cut in range(f.bins - 1):
                left = codes[j] <= cut
                a, b = left.sum(), y[left].sum()
                if 0 < a < m and b * b / a + (p - b) ** 2 / (m - a) > best:
                    best, rule = b * b / a + (p - b) ** 2 / (m - a), (j, cut)
    if rule is None:
        return lambda row: p / m
    left = codes[rule[0]] <= rule[1]
    low, high = by_node(codes[:, left], y[left], f, depth - 1), by_node(codes[:, ~left], y[~left], f, depth - 1)
    return lambda row: low(row) if row[rule[0]] <= rule[1] else high(row)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=150) > 0).astype(int)
    codes = np.array([np.searchsorted(np.quantile(v, np.linspace(0, 1, 9)[1:-1]), v) for v in x.T], np.uint8)
    return codes, y


def test_equals_trees_by_node(sample):
    codes, y = sample
    f = Forest(n_trees=4, depth=4, bins=8, seed=3)
    w = draws(np.arange(len(y)), np.arange(4), f.seed)
    rates = f.rates(codes, y, w)
    for k in range(4):
        tree = by_node(np.repeat(codes, w[k], axis=1), np.repeat(y, w[k]), f, 4)
        assert rates[k] == pytest.approx([tree(row) for row in codes.T])


def test_blocks_change_nothing(sample):
    codes, y = sample
    f, t, place = Forest(n_trees=6, depth=4, bins=8), 6, np.arange(len(y))
    whole = f.rates(codes, y, draws(place, np.arange(t), f.seed))
    levels = []
    for level in range(f.depth + 1):
        total = {}
        for at in np.array_split(place, 4):
            node, _ = f.walk(codes[:, at], levels, t)
            for c, n in zip(*f.cells(codes[:, at], y[at], draws(at, np.arange(t), f.seed), node, level)):
                total[c] = total.get(c, 0) + n
        levels.append(f.choose(np.array(list(total), np.int64), np.array(list(total.values()), float), t, len(codes), level) if total else tuple(np.full((t, 1 << level), v) for v in (-1, 0, 0.0)))
    assert (f.walk(codes, levels, t)[1] == whole).all()


@pytest.mark.parametrize("f", [1, 2])
def test_few_lines_grow_the_same_trees(sample, f):
    codes, y = sample[0][:f], sample[1]
    forest, place, trees = Forest(n_trees=6, depth=4, bins=8, seed=5), np.arange(len(y)), np.arange(6)
    counts = sum(forest.line_counts(codes[:, at], y[at], at, trees) for at in np.array_split(place, 3))
    assert counts.sum() == draws(place, trees, 5).sum() and forest.few_lines(f) and not Forest().few_lines(3)
    rates = forest.walk(forest.lines(f), forest.grow(f, counts), 6)[1][:, forest.line_of(codes)]
    assert (rates == forest.rates(codes, y, draws(place, trees, 5))).all()
    assert (forest.lines(f)[:, forest.line_of(codes)] == codes).all()


def test_out_of_bag_by_line_and_by_row(monkeypatch, sample):
    codes, y = sample
    f, place = Forest(n_trees=30, bins=8, seed=2), np.arange(len(y))
    by_line = [f.out_of_bag(codes[:k], y, place) for k in (1, 2)]
    assert (left_out(place, np.arange(4), 2) == (draws(place, np.arange(4), 2) == 0)).all()
    monkeypatch.setattr(forest, "LINES", 0)
    for k, p in zip((1, 2), by_line):
        assert (f.out_of_bag(codes[:k], y, place) == p).all()


def test_draws_are_poisson():
    w = draws(np.arange(20_000), np.arange(10), 7)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.03 and abs(np.corrcoef(w[0][:-1], w[0][1:])[0, 1]) < 0.03
    assert (draws(np.arange(50, 60), np.arange(3, 5), 7) == w[3:5, 50:60]).all()


def test_out_of_bag(monkeypatch, sample):
    codes, y = sample
    place, rng = np.arange(len(y)), np.random.default_rng(1)
    told = (codes[1] > 3).astype(int)
    p = Forest(50, bins=8).out_of_bag(codes, told, place)
    assert np.isfinite(p).all() and ((p > 0.5) == (told > 0)).mean() > 0.95
    noise = Forest(50, bins=8).out_of_bag(codes, rng.permutation(told), place)
    assert abs(np.corrcoef(noise, told)[0, 1]) < 0.4
    monkeypatch.setattr(forest, "ENTRIES", 1000)  # trees in several portions
    assert Forest(50, bins=8).out_of_bag(codes, told, place) == pytest.approx(p)


def test_small_and_constant():
    assert np.isnan(Forest(0).out_of_bag(np.zeros((1, 3), np.uint8), np.array([0, 1, 0]), np.arange(3))).all()
    flat = Forest(30).out_of_bag(np.zeros((2, 20), np.uint8), np.r_[np.zeros(10, int), np.ones(10, int)], np.arange(20))
    assert np.nanmean(flat) == pytest.approx(0.5, abs=0.1)
