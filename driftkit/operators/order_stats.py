"""Statistics of many index ranges of one array at once (numpy inside a task).

* ``range_select``    - k-th smallest value of each range, by descending a wavelet
  matrix: values are ranked, and bit by bit of the rank the array is parted in a
  stable way; counts of zeros before a place say how many of a range go left.
* ``range_summaries`` - mean, centred sum of squares, minimum and maximum of each
  range, by a disjoint sparse table: a range [lo, hi) spans exactly one midpoint
  of the level of the highest bit in which lo and hi - 1 differ, and is the run
  from there to the left joined to the run to the right.  Runs hold values of the
  range only and are summed about the value at the midpoint, which is one of them,
  so no large sums are subtracted from each other.

Both take O((n + ranges) log n), whatever the ranges' lengths.
"""

from __future__ import annotations

import numpy as np


def range_select(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """``sorted(values[lo:hi])[k]`` for each range; 0 <= k < hi - lo."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lo, hi, k = (np.array(x, np.int64) for x in (lo, hi, k))
    found = np.zeros(len(k), np.int64)
    for bit in reversed(range(max(0, n - 1).bit_length())):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        a, b = zeros[lo], zeros[hi]
        right = k >= b - a
        k = np.where(right, k - (b - a), k)
        lo, hi = np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - b, b)
        found |= right.astype(np.int64) << bit
        rank = np.concatenate([rank[~one], rank[one]])
    return values[order[found]]


def range_quantiles(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: float) -> np.ndarray:
    """Linear-interpolated ``q``-quantile of each non-empty range."""
    place = q * (hi - lo - 1)
    low = np.floor(place).astype(np.int64)
    high = np.minimum(low + 1, hi - lo - 1)
    both = range_select(values, np.tile(lo, 2), np.tile(hi, 2), np.concatenate([low, high]))
    a, b = both[:len(lo)], both[len(lo):]
    return a + (b - a) * (place - low)


def range_summaries(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """{"mean", "m2", "min", "max"} of each non-empty range (m2: sum of (v - mean)^2)."""
    out = {c: np.zeros(len(lo)) for c in ("mean", "m2", "min", "max")}
    last = hi - 1
    level = np.frexp((lo ^ last).astype(float))[1] - 1  # of the highest differing bit, -1 if none
    single = level < 0
    for c in ("mean", "min", "max"):
        out[c][single] = values[lo[single]]
    for h in np.unique(level[~single]):
        half = 1 << int(h)
        at = np.flatnonzero(level == h)
        pairs = -(-len(values) // (2 * half))
        padded = np.zeros(pairs * 2 * half)
        padded[:len(values)] = values
        sides = padded.reshape(pairs, 2, half)
        pivot = sides[:, 1, :1].copy()  # the value at the midpoint
        left, right = sides[:, 0, ::-1] - pivot, sides[:, 1] - pivot
        pair = lo[at] >> (h + 1)
        i, j = half - 1 - (lo[at] & (half - 1)), last[at] & (half - 1)
        sums = [np.cumsum(x, axis=1) for x in (left, right, left * left, right * right)]
        s1, s2 = (sums[k][pair, i] + sums[k + 1][pair, j] for k in (0, 2))
        n = hi[at] - lo[at]
        out["mean"][at] = pivot[pair, 0] + s1 / n
        out["m2"][at] = np.maximum(s2 - s1 * s1 / n, 0.0)
        for c, step in (("min", np.minimum), ("max", np.maximum)):
            a, b = step.accumulate(sides[:, 0, ::-1], axis=1)[pair, i], step.accumulate(sides[:, 1], axis=1)[pair, j]
            out[c][at] = step(a, b)
    return out
