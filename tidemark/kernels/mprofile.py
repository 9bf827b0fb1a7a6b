"""Nearest neighbours of points in blocks, and a tree of cells over them (NumPy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Distances held at once.
STRIP = 1 << 20


def fit_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(basis, dimensions, thresholds) of a tree of ``depth`` levels that halves a sample along its principal directions.

    The basis is orthonormal, so distances stay as they are. Node i of a level has the children 2i and 2i + 1; levels lie
    one after another. A node without sample points keeps the split of direction 0 at 0.
    """
    centred = sample - sample.mean(axis=0) if len(sample) else sample
    basis = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(sample.shape[1]))[1][:, ::-1]
    points = sample @ basis
    dims, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    groups = [np.arange(len(points))]
    for level in range(depth):
        below = []
        for i, g in enumerate(groups):
            node = 2**level - 1 + i
            if len(g):
                dims[node] = int(points[g].std(axis=0).argmax())
                cuts[node] = float(np.median(points[g, dims[node]]))
            left = points[g, dims[node]] <= cuts[node]
            below += [g[left], g[~left]]
        groups = below
    return basis, dims, cuts


def cell_of(points: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The cell of the tree that each point lies in."""
    at, depth = np.zeros(len(points), np.int64), (len(dims) + 1).bit_length() - 1
    rows = np.arange(len(points))
    for level in range(depth):
        node = 2**level - 1 + at
        at = 2 * at + (points[rows, dims[node]] > cuts[node])
    return at


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least possible distance of each point to any point of each box (points x boxes); boxes may have fewer dimensions."""
    out = np.zeros((len(points), len(low)))
    for j in range(low.shape[1]):
        x = points[:, j : j + 1]
        gap = np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0)
        out += gap * gap
    return np.sqrt(out)


def block_minima(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray, left_series: np.ndarray, right_series: np.ndarray, exclusion: int) -> tuple[np.ndarray, np.ndarray]:
    """For each left point the least distance to a right point, and that point's row; points of one series closer
    than ``exclusion`` don't match. inf and -1 without a match."""
    a, b = left, right
    if not len(b):
        return np.full(len(a), np.inf), np.full(len(a), -1)
    # One product gives the squared distances: |a|^2 + |b|^2 - 2ab. A strip of left points is held at a time.
    one = np.ones((len(b), 1))
    wide = np.ascontiguousarray(np.hstack([b, one, (b * b).sum(1)[:, None]]).T)
    order = np.argsort(right_series, kind="stable")
    first, end = (np.searchsorted(right_series[order], left_series, side) for side in ("left", "right"))
    best = np.empty(len(a), np.int64)
    found = np.empty(len(a), bool)
    step = max(1, STRIP // max(1, len(b)))
    for at in range(0, len(a), step):
        x = a[at : at + step]
        d2 = np.hstack([-2 * x, (x * x).sum(1)[:, None], np.ones((len(x), 1))]) @ wide
        n = (end - first)[at : at + step]
        row = np.repeat(np.arange(len(x)), n)
        col = order[np.repeat(first[at : at + step] - np.cumsum(n) + n, n) + np.arange(len(row))]
        near = np.abs(left_at[at + row] - right_at[col]) <= exclusion
        d2[row[near], col[near]] = np.inf
        best[at : at + step] = d2.argmin(axis=1)
        found[at : at + step] = np.isfinite(d2[np.arange(len(x)), best[at : at + step]])
    # Of the pairs kept the distance is taken again, without cancellation.
    return np.where(found, np.sqrt(((a - b[best]) ** 2).sum(1)), np.inf), np.where(found, best, -1)


def _leaves(points: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in groups of at most ``size``, halved along their widest direction; each group keeps its rows' order."""
    if len(rows) <= size:
        return [np.sort(rows)]
    x = points[rows, points[rows].std(axis=0).argmax()]
    order = np.argpartition(x, len(rows) // 2)
    return _leaves(points, rows[order[: len(rows) // 2]], size) + _leaves(points, rows[order[len(rows) // 2 :]], size)


def nearest_within(left: np.ndarray, left_at: np.ndarray, left_series: np.ndarray, bound: np.ndarray, right: np.ndarray, right_at: np.ndarray, right_series: np.ndarray, exclusion: int, size: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """``block_minima``, but only matches nearer than ``bound``. The right points are put in small boxes, and a left point meets
    only boxes that can hold something nearer than what it has."""
    best, who = bound.astype(float).copy(), np.full(len(left), -1)
    for rows in _leaves(right, np.arange(len(right)), size):
        reach = box_distance(left, right[rows].min(axis=0)[None], right[rows].max(axis=0)[None])[:, 0]
        at = np.flatnonzero(reach < best)
        if not len(at):
            continue
        d, hit = block_minima(left[at], left_at[at], right[rows], right_at[rows], left_series[at], right_series[rows], exclusion)
        nearer = d < best[at]
        best[at[nearer]], who[at[nearer]] = d[nearer], rows[hit[nearer]]
    return np.where(who >= 0, best, np.inf), who


def windows_of_flat(values: np.ndarray, lengths: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and points of all windows of finite values, of curves laid end to end."""
    lengths = np.asarray(lengths, np.int64)
    many = np.maximum(lengths - m + 1, 0)
    row = np.repeat(np.arange(len(lengths)), many)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, m))
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    points = np.lib.stride_tricks.sliding_window_view(values, m)[np.repeat(np.cumsum(lengths) - lengths, many) + at]
    whole = np.isfinite(points).all(axis=1)
    return row[whole], at[whole], points[whole]


#: Points of a leaf. Boxes are widened by SLACK, as the last digits of their points may differ from one product to the next, and by
#: SHORT of the points' size where they are compared in single precision.
LEAF, SLACK, SHORT = 256, 1e-9, 2.0**-21
#: Squared distances of at most DONE are zero but for last digits; what has one needs nothing nearer.
DONE = 1e-18
#: Points that boxes are compared with at a time, and points that a leaf meets at a time: what a processor's cache holds.
TILE, ROWS = 4096, 512
#: Directions that all boxes are compared in; the others count for the boxes that are left.
FIRST_DIMENSIONS = 7


def gaps(columns: np.ndarray, centre: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Least possible squared distance of each box, given by its centre and half its width, to each point (boxes x points), in
    single precision. ``columns`` has a row per direction; a box may have more of them, which don't count."""
    out = np.zeros((len(centre), columns.shape[1]), np.float32)
    off = np.empty((len(centre), min(TILE, columns.shape[1])), np.float32)
    for at in range(0, columns.shape[1], TILE):
        total = out[:, at : at + TILE]
        for j in range(len(columns)):
            gap = off[:, : total.shape[1]] if j else total
            np.subtract(columns[j, at : at + TILE], centre[:, j : j + 1], out=gap)
            np.abs(gap, out=gap)
            np.subtract(gap, half[:, j : j + 1], out=gap)
            np.maximum(gap, 0, out=gap)
            np.multiply(gap, gap, out=gap)
            if j:
                total += gap
    return out


def gaps_of_one(columns: np.ndarray, centre: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The same for one box, in all directions at once."""
    out = np.empty(columns.shape[1], np.float32)
    for at in range(0, columns.shape[1], TILE):
        gap = columns[:, at : at + TILE] - centre[:, None]
        np.abs(gap, out=gap)
        np.subtract(gap, half[:, None], out=gap)
        np.maximum(gap, 0, out=gap)
        np.einsum("ij,ij->j", gap, gap, out=out[at : at + TILE])
    return out


def boxes_of(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and half the width of boxes, in single precision and wide enough for it."""
    size = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
    return ((low + high) / 2).astype(np.float32), ((high - low) / 2 + SHORT * size).astype(np.float32)


def limits(best: np.ndarray) -> np.ndarray:
    """What a gap must lie under for anything nearer than ``best`` (squared): a little more, for the last digits of gaps."""
    return np.where(best > DONE, best * (1 + 1e-5) + 1e-30, -1).astype(np.float32)


def leaf_order(points: np.ndarray, size: int | None = None) -> np.ndarray:
    """An order of points in which each leaf of ``leaf_ends`` is narrow."""
    return np.concatenate(_leaves(points, np.arange(len(points)), size or LEAF)) if len(points) else np.zeros(0, np.int64)


def leaf_ends(n: int, size: int | None = None) -> list[int]:
    """Where the leaves of n points end."""
    return [n] if n <= (size or LEAF) else leaf_ends(n // 2, size) + [n // 2 + e for e in leaf_ends(n - n // 2, size)]


class Block:
    """Points in the order of their leaves, with the boxes of leaves and the factors of squared distances in single precision.
    ``sizes``: of several blocks laid end to end, the points of each."""

    def __init__(self, points: np.ndarray, pos: np.ndarray, series: np.ndarray, sizes: list[int] | None = None):
        n, self.points, self.pos, self.series = len(points), points, pos, series
        square = np.einsum("ij,ij->i", points, points)
        self.reach = float(np.sqrt(square.max(initial=0)))
        self.columns = np.ascontiguousarray(points.T, np.float32)
        self.factor = np.empty((n, points.shape[1] + 2), np.float32)
        self.factor[:, :-2], self.factor[:, -2], self.factor[:, -1] = -2 * points, square, 1
        self.wide = np.empty((n, points.shape[1] + 2), np.float32)
        self.wide[:, :-2], self.wide[:, -2], self.wide[:, -1] = points, 1, square
        sizes = sizes or [n]
        self.ends = np.array([first + e for first, many in zip(np.cumsum([0, *sizes]), sizes) for e in leaf_ends(many)])
        self.starts = np.r_[0, self.ends[:-1]]
        self.low, self.high = np.minimum.reduceat(points, self.starts) - SLACK, np.maximum.reduceat(points, self.starts) + SLACK
        self.centre, self.half = boxes_of(self.low, self.high)


def meet_leaf(guests: Block, rows: np.ndarray, hosts: Block, leaf: int, best: np.ndarray, who: np.ndarray, exclusion: int) -> None:
    """Lower ``best`` (squared) of the rows of guests that a leaf of hosts has something nearer for, and set ``who``. Points of one
    series within ``exclusion`` don't match.

    Single precision only finds out which pairs may be the nearest, by a bound of its error; of these the distance is taken again.
    """
    first, end = int(hosts.starts[leaf]), int(hosts.ends[leaf])
    error = (guests.points.shape[1] + 8) * 2.0**-23 * (guests.reach + hosts.reach) ** 2
    for start in range(0, len(rows), ROWS):
        some = rows[start : start + ROWS]
        d2 = hosts.wide[first:end] @ guests.factor[some].T
        limit = best[some] + error
        least = d2.min(axis=0)
        at = np.flatnonzero(least < limit)
        if not len(at):
            continue
        r, near, limit = some[at], np.ascontiguousarray(d2[:, at].T), np.minimum(limit[at], least[at] + 2 * error)
        h = first + near.argmin(axis=1)
        barred = np.flatnonzero((guests.series[r] == hosts.series[h]) & (np.abs(guests.pos[r] - hosts.pos[h]) <= exclusion))
        if len(barred):
            b = r[barred]
            close = (guests.series[b][:, None] == hosts.series[first:end]) & (np.abs(guests.pos[b][:, None] - hosts.pos[first:end]) <= exclusion)
            near[barred] = again = np.where(close, np.inf, near[barred])
            limit[barred] = np.minimum(best[b] + error, again.min(axis=1) + 2 * error)
        i, col = np.nonzero(near <= np.minimum(limit, np.finfo(np.float32).max).astype(np.float32)[:, None])
        row, col = r[i], first + col
        apart = (guests.series[row] != hosts.series[col]) | (np.abs(guests.pos[row] - hosts.pos[col]) > exclusion)
        row, col = row[apart], col[apart]
        off = guests.points[row] - hosts.points[col]
        exact = np.einsum("ij,ij->i", off, off)
        nearer = np.flatnonzero(exact < best[row])
        nearer = nearer[np.lexsort((exact[nearer], row[nearer]))]
        nearer = nearer[np.r_[True, row[nearer][1:] != row[nearer][:-1]][: len(nearer)]]
        best[row[nearer]], who[row[nearer]] = exact[nearer], col[nearer]


def meet(guests: Block, rows: np.ndarray, hosts: Block, best: np.ndarray, who: np.ndarray, exclusion: int) -> None:
    """The same over all leaves of hosts; a row only meets the leaves that can hold something nearer than what it has."""
    columns = guests.columns[:, rows]
    away = gaps(columns[:FIRST_DIMENSIONS], hosts.centre, hosts.half)
    limit = limits(best[rows])
    for leaf in np.argsort(away.min(axis=1, initial=np.inf), kind="stable"):
        at = np.flatnonzero(away[leaf] < limit)
        rest = gaps_of_one(columns[FIRST_DIMENSIONS:, at], hosts.centre[leaf, FIRST_DIMENSIONS:], hosts.half[leaf, FIRST_DIMENSIONS:])
        at = at[away[leaf, at] + rest < limit[at]]
        if len(at):
            meet_leaf(guests, rows[at], hosts, leaf, best, who, exclusion)
            limit[at] = limits(best[rows[at]])


def meet_own(block: Block, exclusion: int, within: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and row of the nearest other point of a block, up to a distance of ``within``; a square of that or a little
    more, and -1, without one."""
    best, who = np.full(len(block.pos), within * within * (1 + 1e-9) + DONE * 2), np.full(len(block.pos), -1)
    for leaf in range(len(block.ends)):
        meet_leaf(block, np.arange(block.starts[leaf], block.ends[leaf]), block, leaf, best, who, exclusion)
    meet(block, np.arange(len(block.pos)), block, best, who, exclusion)
    return best, who


#: Blocks that a block is compared with at a time; what it finds among the nearer ones spares it many of the others.
BLOCKS_AT_ONCE = 16


def blocks_reached(block: Block, best: np.ndarray, low: np.ndarray, high: np.ndarray, own: int | np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, rows) of other blocks than a row's own, by their boxes, and the rows that they may hold something nearer for than
    ``best`` has, which is to be lowered meanwhile."""
    mean = block.points.mean(axis=0)
    off = np.maximum(np.maximum(low - mean, mean - high), 0)
    order = np.argsort(np.einsum("ij,ij->i", off, off), kind="stable")
    centre, half = boxes_of(low, high)
    many = block.ends - block.starts
    for first in range(0, len(order), BLOCKS_AT_ONCE):
        some = order[first : first + BLOCKS_AT_ONCE]
        # Leaves first: those none of whose points can reach a block are left out at once.
        away = np.maximum(np.maximum(low[some][:, None] - block.high, block.low - high[some][:, None]), 0)
        near = np.einsum("ijk,ijk->ij", away, away) < np.maximum.reduceat(limits(best), block.starts)
        for i, leaves in zip(some, near):
            if not leaves.any():
                continue
            rows = np.flatnonzero(np.repeat(leaves, many) & (own != i))
            rows = rows[gaps_of_one(block.columns[:, rows], centre[i], half[i]) < limits(best[rows])]
            if len(rows):
                yield int(i), rows
