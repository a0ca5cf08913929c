"""First and last crossings of thresholds in an array, many at once.

A table holds the maximum of the 1, 2, 4, ... elements from each place on. A search starts with the longest stretch and skips
every one whose maximum stays below its threshold, so it takes a number of steps by the logarithm of the distance.
"""

from __future__ import annotations

import numpy as np


class Crossings:
    """Searches in one array; missing values cross nothing."""

    def __init__(self, x: np.ndarray):
        x = np.asarray(x, dtype=float)
        self.levels = [np.where(np.isnan(x), -np.inf, x)]
        while (reach := 1 << len(self.levels)) <= len(x):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: len(x) - reach + 1], last[reach // 2 :][: len(x) - reach + 1]))

    def first(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each search the first place from ``start`` on with a value of at least ``least``, or the length of the array."""
        n = len(self.levels[0])
        at = np.minimum(np.array(start, dtype=np.int64), n)
        least = np.broadcast_to(np.asarray(least, dtype=float), at.shape)
        for k in (*range(len(self.levels)), *reversed(range(len(self.levels)))):  # up in widening steps, then down
            level = self.levels[k]
            inside = np.flatnonzero(at < len(level))
            if len(inside):
                skipped = inside[level[at[inside]] < least[inside]]
                at[skipped] += 1 << k
        # what is left of a stretch at the end of the array is shorter than the stretch that was tried last
        open_ = np.flatnonzero(at < n)
        while len(open_) and (missed := open_[self.levels[0][at[open_]] < least[open_]]).size:
            at[missed] += 1
            open_ = missed[at[missed] < n]
        return at


def last_crossing(x: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each search the last place up to ``at`` with a value of at least ``least``, or -1."""
    n = len(x)
    return n - 1 - Crossings(np.asarray(x, dtype=float)[::-1]).first(n - 1 - np.asarray(at), least)


def next_true(flags: np.ndarray) -> np.ndarray:
    """For each place the first later one that is true, or the length of the array."""
    n = len(flags)
    at = np.where(flags, np.arange(n), n)
    return np.append(np.minimum.accumulate(at[::-1])[::-1], n)[1:]
