import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.kernels import dtw as K
from tidemark.kernels.mprofile import block_minima, box_distance, cell_of, fit_tree, nearest_within


def slow_dtw(a, b, w):
    m = len(a)
    cost = np.full((m + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(m):
        for j in range(m):
            if abs(i - j) < w:
                cost[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    return math.sqrt(cost[m, m])


@pytest.mark.parametrize(("w", "expected"), [(1, 2.0), (2, 1.0), (3, 1.0)])
def test_worked_distances(w, expected):
    assert K.dtw(np.array([[0.0, 1, 2, 1, 0]]), np.array([0.0, 0, 1, 2, 1]), w)[0] == pytest.approx(expected)


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 9), st.integers(1, 9), st.integers(0, 10_000))
def test_banded_distance_and_bound(m, w, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(4, m)), rng.normal(size=m)
    d = K.dtw(x, y, w)
    assert d == pytest.approx([slow_dtw(r, y, w) for r in x])
    assert (K.lower_bound(x, y, w) <= d + 1e-9).all() and (d <= np.sqrt(((x - y) ** 2).sum(1)) + 1e-9).all()
    assert K.dtw(y[None, :], y, w)[0] == 0


def test_least_distance_over_windows():
    rng = np.random.default_rng(0)
    motif = K.znorm(rng.normal(size=6))
    curves = [rng.normal(size=20), rng.normal(size=3), np.array([np.nan] * 10)]
    got = K.least_distance(curves, motif, 2, 1e9)
    assert got[0] == pytest.approx(min(slow_dtw(K.znorm(curves[0][i : i + 6]), motif, 2) for i in range(15)))
    assert np.isinf(got[1:]).all() and np.isinf(K.least_distance(curves[:1], motif, 2, got[0] * 0.9)).all()


def test_band():
    assert K.band(5, 0.05) == 1 and K.band(60, 0.2) == 12 and K.band(60, 0.9, 5) == 24


def test_block_minima_shuts_out_near_windows():
    rng = np.random.default_rng(1)
    x, at, s = rng.normal(size=(6, 5)), np.arange(6), np.zeros(6, int)
    z = K.znorm(x)
    d, nn = block_minima(z, at, z, at, s, s, 2)
    for i in range(6):
        far = [j for j in range(6) if abs(i - j) > 2]
        assert d[i] == pytest.approx(min(np.linalg.norm(z[i] - z[j]) for j in far)) and nn[i] in far



def test_cells_boxes_and_bounded_search():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(900, 4)) * [3, 1, 1, 0.1], np.zeros((100, 4))])
    basis, dims, cuts = fit_tree(x[::3], 3)
    y = x @ basis
    assert np.allclose(np.linalg.norm(y[:50, None] - y[None, 50:100], axis=-1), np.linalg.norm(x[:50, None] - x[None, 50:100], axis=-1))
    cell = cell_of(y, dims, cuts)
    assert set(cell) == set(range(8)) and (cell_of(np.zeros((3, 4)), *fit_tree(np.zeros((0, 4)), 2)[1:]) == 0).all()
    low, high = (np.stack([f(y[cell == c], axis=0) for c in range(8)]) for f in (np.min, np.max))
    reach = box_distance(y, low[:, :2], high[:, :2])
    real = np.stack([np.linalg.norm(y[:, None] - y[None, cell == c], axis=-1).min(1) for c in range(8)], axis=1)
    assert (reach <= real + 1e-9).all() and (reach[np.arange(1000), cell] == 0).all()
    at, s = np.zeros(1000, int), np.arange(1000)
    full, _ = block_minima(y, at, y, at, s, s, 0)
    d, who = nearest_within(y, at, s, np.full(1000, np.inf), y, at, s, 0, 32)
    assert np.allclose(d, full) and (np.linalg.norm(y - y[who], axis=1) == d).all()
    tight, none = nearest_within(y, at, s, full, y, at, s, 0, 32)
    assert (none[tight == np.inf] == -1).all() and (none == -1).mean() > 0.99


@pytest.mark.parametrize("n", [1, 40, 1500])
def test_points_meet_by_leaves_and_blocks(n):
    from tidemark.kernels.mprofile import Block, blocks_reached, leaf_order, meet, meet_own, windows_of_flat

    rng = np.random.default_rng(n)
    points, pos, series = rng.normal(size=(n, 6)).round(1), rng.integers(0, 9, n), rng.integers(0, 60, n)
    parts = [p for p in np.array_split(np.argsort(points[:, 0]), 4) if len(p)]
    parts = [p[leaf_order(points[p])] for p in parts]
    blocks = [Block(points[p], pos[p], series[p]) for p in parts]
    low, high = np.array([b.low.min(0) for b in blocks]), np.array([b.high.max(0) for b in blocks])
    for i, (p, b) in enumerate(zip(parts, blocks)):
        best, who = meet_own(b, 2)
        for j, rows in blocks_reached(b, best, low, high, i):
            meet(b, rows, blocks[j], best, who, 2)
        d = np.sqrt(((points[p][:, None] - points[None]) ** 2).sum(2))
        d[(series[p][:, None] == series) & (np.abs(pos[p][:, None] - pos) <= 2)] = np.inf
        assert np.allclose(np.sqrt(best), d.min(axis=1))
    row, at, x = windows_of_flat(np.array([1.0, 2, 3, 4, 5, np.nan, 6, 7, 8]), np.array([3, 1, 5]), 2)
    assert (row.tolist(), at.tolist(), x.tolist()) == ([0, 0, 2, 2], [0, 1, 2, 3], [[1, 2], [2, 3], [6, 7], [7, 8]])
    assert len(windows_of_flat(np.zeros(2), np.array([1, 1]), 5)[0]) == 0


def test_blocks_laid_end_to_end_meet_others_at_once():
    """The nearest by all digits, although single precision can't tell it from others; copies need nothing nearer."""
    from tidemark.kernels.mprofile import Block, blocks_reached, leaf_order, limits, meet, meet_own

    rng = np.random.default_rng(11)
    points = np.repeat(rng.normal(size=(300, 12)) * 3, 8, axis=0) + rng.normal(size=(2400, 12)) * np.repeat([1.0, 1e-4, 1e-7, 0], 600)[:, None]
    pos, series = rng.integers(0, 9, 2400), rng.integers(0, 200, 2400)
    parts = [p[leaf_order(points[p])] for p in np.array_split(np.argsort(points[:, 0]), 8)]
    blocks = [Block(points[p], pos[p], series[p]) for p in parts]
    low, high = np.array([b.low.min(0) for b in blocks]), np.array([b.high.max(0) for b in blocks])
    own, sizes = [1, 2, 3], [len(parts[i]) for i in (1, 2, 3)]
    rows = np.concatenate([parts[i] for i in own])
    guests = Block(points[rows], pos[rows], series[rows], sizes)
    assert len(guests.low) == sum(len(blocks[i].low) for i in own)
    best, who = (np.concatenate(x) for x in zip(*(meet_own(blocks[i], 2) for i in own)))
    read = []
    for j, at in blocks_reached(guests, best, low, high, np.repeat(own, sizes)):
        read.append(j)
        meet(guests, at, blocks[j], best, who, 2)
    assert len(read) == len(set(read))
    d = ((points[rows][:, None] - points[None]) ** 2).sum(2)
    d[(series[rows][:, None] == series) & (np.abs(pos[rows][:, None] - pos) <= 2)] = np.inf
    assert np.allclose(np.sqrt(best), np.sqrt(d.min(axis=1)), rtol=1e-9, atol=1e-9) and (best == 0).any() and (limits(best[best == 0]) < 0).all()
