"""Thinning of a track by distance from the chord: the fewest points within a tolerance, or the best within a budget."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from driftline.operators.filters import per_recording


def farthest(xy: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Greatest distance of the points between lo and hi from their chord (from the end, where both ends are one), and the first such point."""
    p, d = xy[lo + 1 : hi] - xy[lo], xy[hi] - xy[lo]
    chord = float(np.hypot(*d))
    off = np.abs(d[1] * p[:, 0] - d[0] * p[:, 1]) / chord if chord > 0 else np.hypot(p[:, 0], p[:, 1])
    at = int(np.argmax(off))
    return float(off[at]), lo + 1 + at


def significance(xy: np.ndarray, parts: list[tuple[int, int]], tolerance: float = 0.0, budget: int | None = None) -> np.ndarray:
    """For each point the tolerance up to which splitting at the farthest point keeps it: infinite for the ends of parts, 0 for what was not reached.

    Segments wait in a heap by what their farthest point is worth, at most what its parents were, so that points come in
    falling order; it ends at the tolerance, or when the budget is full. Points that are worth the same go in together or not at all.
    """
    worth, heap = np.zeros(len(xy)), []

    def add(lo: int, hi: int, most: float) -> None:
        if hi - lo >= 2:
            d, at = farthest(xy, lo, hi)
            heapq.heappush(heap, (-min(d, most), lo, hi, at))

    for lo, hi in parts:
        worth[[lo, hi]] = np.inf
        add(lo, hi, np.inf)
    found, left = [], None if budget is None else budget - int(np.isinf(worth).sum())
    while heap and -heap[0][0] > tolerance and (left is None or len(found) <= left):
        value, lo, hi, at = heapq.heappop(heap)
        found.append((-value, at))
        add(lo, at, -value)
        add(at, hi, -value)
    if left is not None and len(found) > max(left, 0):
        over = found[max(left, 0)][0]
        found = [f for f in found if f[0] > over]
    for value, at in found:
        worth[at] = value
    return worth


def thinned_track(df: DataFrame, x: str, y: str, tolerance: float | None = None, relative: float | None = None, budget: int | None = None) -> DataFrame:
    """The rows of a track that stay, with worth (the tolerance up to which each does; null for the ends of a part).

    A row with a null or not finite x or y breaks the track and goes. tolerance: in units of x and y; relative: as a share of
    the track's own extent; budget: at most so many rows, but for the ends of parts, which always stay.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t_us", "seq"], ignore_index=True)
        xy = frame[[x, y]].to_numpy(float)
        ok = np.isfinite(xy).all(1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(int)))
        parts = [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        own = xy[ok]
        limit = tolerance if tolerance is not None else (relative or 0.0) * float((own.max(0) - own.min(0)).max()) if len(own) else 0.0
        worth = significance(np.where(ok[:, None], xy, 0.0), parts, limit, budget)
        return frame[worth > 0].assign(worth=np.where(np.isinf(worth), np.nan, worth)[worth > 0])

    return per_recording(df.select("recording_id", "t_us", "seq", x, y), run, "worth double", ("t_us", "seq", x, y))
