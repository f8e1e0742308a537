"""How many barcodes are cells: knees of the ranked abundance curve.

The curve has a point per distinct barcode; what the driver gets is the histogram of
their counts (count, how many barcodes have it), which grows with the number of
distinct counts, not of barcodes or reads.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def farthest(xs: list[int], ys: list[int]) -> int:
    """The first point farthest from the chord between the ends; whole numbers, so ties are exact."""
    width, height = xs[-1] - xs[0], ys[-1] - ys[0]
    best, at = 0, xs[0]
    for x, y in zip(xs, ys):
        far = abs((x - xs[0]) * height - (y - ys[0]) * width)
        if far > best:
            best, at = far, x
    return at


def distance_knee(values: np.ndarray, many: np.ndarray) -> int:
    """values: distinct counts, descending; many: how many barcodes have each.  Rank (from
    0) of the last barcode to keep: the knee of the summed counts, sought again in the
    first three times as many points until it stays.

    Between two distinct counts the curve is straight, so its farthest point is a corner."""
    ends, sums = [int(x) for x in np.cumsum(many)], [int(x) for x in np.cumsum(values * many)]

    def first(n: int) -> int:
        """The knee of the first n points."""
        k = bisect_left(ends, n)
        last = sums[k] - (ends[k] - n) * int(values[k])
        corners = [(0, int(values[0])), *[(e - 1, s) for e, s in zip(ends[:k], sums) if e > 1], (n - 1, last)]
        return farthest(*map(list, zip(*corners)))

    knee, before = first(ends[-1]), 0
    for _ in range(100):
        if knee == before:
            break
        before = knee
        knee = first(min(3 * knee, ends[-1]))
    return knee


def kernel_density(data: np.ndarray, weights: np.ndarray, bandwidth: float, at: np.ndarray) -> np.ndarray:
    """Gaussian kernels over weighted points, in chunks of ``at``."""
    out = np.empty(len(at))
    for k in range(0, len(at), 500):
        z = (at[k : k + 500, None] - data[None, :]) / bandwidth
        out[k : k + 500] = (np.exp(-0.5 * z * z) * weights).sum(axis=1)
    return out / (weights.sum() * bandwidth * np.sqrt(2 * np.pi))


def density_threshold(counts: np.ndarray, barcodes: np.ndarray, expect_cells: int | None = None, points: int = 10_000) -> float | None:
    """counts (distinct, descending) and how many barcodes have each.  The count above which
    barcodes are kept: a local minimum of the density of log10 counts; None if none fits."""
    on = counts > counts[0] * 0.001
    logs, weights = np.log10(counts[on].astype(float)), barcodes[on].astype(float)
    total = weights.sum()
    if total < 2:
        return None
    mean = (logs * weights).sum() / total
    spread = np.sqrt((weights * (logs - mean) ** 2).sum() / (total - 1))
    if spread == 0:
        return None
    xs = np.linspace(logs.min(), logs.max(), points)
    density = kernel_density(logs, weights, spread * 0.1, xs)
    minima = np.flatnonzero((density[1:-1] < density[:-2]) & (density[1:-1] < density[2:])) + 1
    top = xs[-1]
    for k in minima[::-1]:
        threshold = 10.0 ** xs[k]
        if expect_cells is not None:
            passing = int(barcodes[counts > threshold].sum())
            if int(expect_cells * 0.1) < passing <= expect_cells:
                return threshold
        elif k >= 0.2 * points and (top - xs[k] > 0.5 or xs[k] < top / 2):
            return threshold
    return None
