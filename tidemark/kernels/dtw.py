"""Banded dynamic time warping of many windows against one motif at once (NumPy)."""

from __future__ import annotations

import numpy as np


def znorm(x: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """Rows to mean 0 and population deviation 1."""
    return (x - x.mean(axis=-1, keepdims=True)) / (x.std(axis=-1, keepdims=True) + eps)


def envelope(motif: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest motif value within the band around each point."""
    m = len(motif)
    reach = w - 1
    padded = np.concatenate([np.full(reach, np.nan), motif, np.full(reach, np.nan)])
    views = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)[:m]
    return np.nanmin(views, axis=1), np.nanmax(views, axis=1)


def lower_bound(windows: np.ndarray, motif: np.ndarray, w: int) -> np.ndarray:
    """Keogh's lower bound of the banded distance, per window."""
    low, high = envelope(motif, w)
    over = np.where(windows > high, windows - high, np.where(windows < low, low - windows, 0.0))
    return np.sqrt((over * over).sum(axis=1))


def dtw(windows: np.ndarray, motif: np.ndarray, w: int) -> np.ndarray:
    """Root of the least squared cost of a warping path within |i - j| < w, per window. w = 1 is the diagonal."""
    n, m = windows.shape
    if not n:
        return np.zeros(0)
    before = np.full((n, m + 1), np.inf)
    before[:, 0] = 0.0
    for i in range(m):
        now = np.full((n, m + 1), np.inf)
        lo, hi = max(0, i - w + 1), min(m, i + w)
        cost = (windows[:, i : i + 1] - motif[lo:hi]) ** 2
        step = np.minimum(before[:, lo:hi], before[:, lo + 1 : hi + 1])
        for j in range(lo, hi):
            now[:, j + 1] = cost[:, j - lo] + np.minimum(step[:, j - lo], now[:, j])
        before = now
    return np.sqrt(before[:, m])


def least_distance(curves: list[np.ndarray], motif: np.ndarray, w: int, limit: float) -> np.ndarray:
    """For each curve the least distance of any of its z-normalised windows to the motif; inf above ``limit``, for
    curves shorter than the motif, and where every window holds a NaN.

    Windows whose lower bound is above the limit are never warped, the rest together.
    """
    m = len(motif)
    out = np.full(len(curves), np.inf)
    views = [np.lib.stride_tricks.sliding_window_view(c, m) if len(c) >= m else np.zeros((0, m)) for c in curves]
    owner = np.repeat(np.arange(len(curves)), [len(v) for v in views])
    if not len(owner):
        return out
    windows = np.concatenate(views)
    whole = np.isfinite(windows).all(axis=1)
    windows, owner = znorm(windows[whole]), owner[whole]
    near = lower_bound(windows, motif, w) <= limit
    d = dtw(windows[near], motif, w)
    np.minimum.at(out, owner[near], np.where(d <= limit, d, np.inf))
    return out


def band(m: int, share: float, downsample: int | None = None) -> int:
    """Band width for a share of the motif, at least 1, at most half a session where the bar length is given."""
    w = max(1, int(m * share))
    return w if downsample is None else max(1, min(w, 120 // downsample))
