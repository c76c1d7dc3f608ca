"""The median slope of all pairs of points without making the pairs: counts by merging, then the few pairs that are left."""

from __future__ import annotations

import numpy as np

#: Pairs per point that are looked at one by one, and slopes that count as none.
FEW, TINY = 4, 1e-290
_SIGN = np.uint64(1 << 63)


def _padded(ranks: np.ndarray) -> np.ndarray:
    size = 1 << max(len(ranks) - 1, 0).bit_length()
    return np.concatenate([ranks, np.full(size - len(ranks), -1, np.int64)])


def rising(ranks: np.ndarray) -> int:
    """Number of pairs of which the later one has the greater rank, by a merge sort."""
    a, n, total, width = _padded(ranks), len(ranks) + 2, 0, 1
    while width < len(a):
        halves = a.reshape(-1, 2, width) + 1 + np.arange(len(a) // (2 * width))[:, None, None] * n
        below = np.searchsorted(halves[:, 0].ravel(), halves[:, 1].ravel())
        total += int(below.sum()) - int(np.repeat(np.arange(len(halves)), width).sum()) * width
        a = np.sort(a.reshape(-1, 2 * width), axis=1).ravel()
        width *= 2
    return total


def falling_pairs(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (earlier, later) of all pairs of which the later one has the smaller rank; ranks differ from each other."""
    a, n, width = _padded(ranks), len(ranks) + 2, 1
    at = np.arange(len(a))
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while width < len(a):
        rows = len(a) // (2 * width)
        halves = a.reshape(-1, 2, width) + 1 + np.arange(rows)[:, None, None] * n
        place = at.reshape(-1, 2, width)
        below = np.searchsorted(halves[:, 0].ravel(), halves[:, 1].ravel())
        ends = np.repeat((np.arange(rows) + 1) * width, width)
        many = np.where(a.reshape(-1, 2, width)[:, 1].ravel() >= 0, ends - below, 0)
        start = np.repeat(below, many)
        step = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)
        firsts.append(place[:, 0].ravel()[start + step])
        seconds.append(np.repeat(place[:, 1].ravel(), many))
        order = np.argsort(a.reshape(-1, 2 * width), axis=1, kind="stable")
        a, at = (np.take_along_axis(v.reshape(-1, 2 * width), order, axis=1).ravel() for v in (a, at))
        width *= 2
    return np.concatenate(firsts), np.concatenate(seconds)


def _whole(v: float) -> int:
    """Doubles as whole numbers of the same order."""
    bits = int(np.float64(v).view(np.uint64))
    return bits ^ int(_SIGN) if not bits >> 63 else (1 << 64) - 1 - bits


def _double(v: int) -> float:
    bits = v ^ int(_SIGN) if v >> 63 else (1 << 64) - 1 - v
    return float(np.uint64(bits).view(np.float64))


def slope_of_rank(x: np.ndarray, y: np.ndarray, ranks: list[int]) -> list[float]:
    """The slopes of these ranks (from 0) among those of all pairs of different x; x ascending, y falling where x is equal."""
    n = len(x)

    def at_most(s: float) -> int:
        z = y - s * x
        return pairs - rising(np.unique(z, return_inverse=True)[1].ravel())

    runs = np.unique(x, return_counts=True)[1]
    pairs = n * (n - 1) // 2 - int((runs * (runs - 1) // 2).sum())
    low, high, under, upto = -np.inf, np.inf, 0, pairs
    rng = np.random.Generator(np.random.PCG64(7))
    i, j = np.sort(rng.integers(0, n, (2, 4096)), axis=0)
    some = np.sort((y[j] - y[i])[x[j] > x[i]] / (x[j] - x[i])[x[j] > x[i]])
    for share in (0.0, 1.0) if len(some) else ():  # bounds that a sample suggests, where the counts confirm them
        k = int(np.clip((ranks[0] if share == 0 else ranks[-1]) / pairs * len(some) + (2 * share - 1) * 3 * len(some) ** 0.5, 0, len(some) - 1))
        told = at_most(some[k])
        if share == 0 and told <= ranks[0]:
            low, under = float(some[k]), told
        elif share == 1 and told > ranks[-1]:
            high, upto = float(some[k]), told
    if len(some):  # where many pairs have about one slope, its neighbourhood is told at once
        middle = float(some[min(int(ranks[0] / pairs * len(some)), len(some) - 1)])
        for s in (middle - max(abs(middle) * 1e-13, TINY), middle + max(abs(middle) * 1e-13, TINY)):
            told = at_most(s)
            if told <= ranks[0] and s > low:
                low, under = s, told
            elif told > ranks[-1] and s < high:
                high, upto = s, told
    out = []
    for rank in ranks:
        lo, hi, before, behind = low, high, under, upto
        while behind - before > FEW * n + 64 and hi - lo > max(2 * TINY, 4e-16 * abs(hi)):
            mid = _double((_whole(lo) + _whole(hi)) // 2) if not (np.isfinite(lo) and np.isfinite(hi)) or lo * hi < 0 else (lo + hi) / 2
            if mid in (lo, hi):
                mid = _double((_whole(lo) + _whole(hi)) // 2)
            told = at_most(mid)
            if told <= rank:
                lo, before = mid, told
            else:
                hi, behind = mid, told
        if behind - before > FEW * n + 64:
            out.append(hi)  # so many pairs have one and the same slope
            continue
        z_low = y - lo * x if np.isfinite(lo) else x
        z_high = y - hi * x if np.isfinite(hi) else -x
        first = np.lexsort((y, -x, z_low))  # a slope of lo itself is no inversion any more
        place = np.empty(n, np.int64)
        place[np.lexsort((np.argsort(first), -x, z_high))] = np.arange(n)
        a, b = (first[v] for v in falling_pairs(place[first]))
        a, b = np.where(x[a] < x[b], a, b), np.where(x[a] < x[b], b, a)
        apart = x[a] < x[b]
        found = np.sort((y[b] - y[a])[apart] / (x[b] - x[a])[apart])
        out.append(float(found[min(max(rank - before, 0), len(found) - 1)]))
    return out


def median_slope(x: np.ndarray, y: np.ndarray) -> float | None:
    """The median of the slopes of all pairs of different x; none where there is no such pair."""
    order = np.lexsort((-y, x))
    x, y = x[order], y[order]
    runs = np.unique(x, return_counts=True)[1]
    pairs = len(x) * (len(x) - 1) // 2 - int((runs * (runs - 1) // 2).sum())
    if not pairs:
        return None
    low, high = (pairs - 1) // 2, pairs // 2
    found = slope_of_rank(x, y, [low, high] if high > low else [low])
    return (found[0] + found[-1]) / 2 + 0.0
