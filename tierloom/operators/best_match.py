"""The best of many intervals for each of many others, without their pairs.

Of intervals that hold a row's whole, the shortest comes first; where none does, the best lies inside the row or reaches
over one of its edges. The former two are smallest values among points that two bounds limit, which a tree of sorted
blocks answers for all rows at once, the latter running extremes. So n intervals cost n log^2 n, however dense they are.
"""

from __future__ import annotations

import numpy as np

#: Pairs that are held at once where rows without a half share look for boundaries near theirs.
HELD_PAIRS = 2_000_000


def smallest_beyond(x: np.ndarray, y: np.ndarray, rank: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the smallest rank of the points with x <= qx and y >= qy, or their number where there is none.

    Ranks are a permutation. The first points by x fall into blocks of powers of two, each sorted by y, whose smallest
    ranks from a y on are running minima.
    """
    n = len(x)
    best = np.full(len(qx), n, dtype=np.int64)
    if not n or not len(qx):
        return best
    by_x = np.argsort(x, kind="stable")
    prefix = np.searchsorted(x[by_x], qx, side="right")
    levels, place = np.unique(y[by_x], return_inverse=True)
    wanted, stride = np.searchsorted(levels, qy), len(levels) + 1
    rank, order = rank[by_x], np.arange(n)
    for k in range(int(prefix.max()).bit_length()):
        key = (order >> k) * stride + place[order]
        again = np.argsort(key, kind="stable")
        order, key = order[again], key[again]
        block = order >> k
        # Lower blocks have lower numbers, so a minimum that runs from the end starts anew in each.
        least = np.minimum.accumulate((rank[order] + block * n)[::-1])[::-1] - block * n
        asked = np.flatnonzero(prefix >> k & 1)
        own = (prefix[asked] >> k + 1) * 2
        at = np.searchsorted(key, own * stride + wanted[asked])
        inside = at < n
        inside[inside] = block[at[inside]] == own[inside]
        best[asked[inside]] = np.minimum(best[asked[inside]], least[at[inside]])
    return best


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers ordered by the keys, the first being the most significant, and their ranks."""
    order = np.lexsort(keys[::-1])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return order, rank


def _taken(order: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Points of ranks, -1 of none."""
    return np.where(found < len(order), np.append(order, -1)[np.minimum(found, len(order))], -1)


def best_of(s: np.ndarray, e: np.ndarray, s2: np.ndarray, e2: np.ndarray, ratio: float, tolerance: float) -> np.ndarray:
    """For each interval (s, e) the number of the best of the distinct intervals (s2, e2), -1 of none.

    A candidate shares at least ``ratio`` of the interval, or has both boundaries within ``tolerance``. The best shares
    most; of equals that with the least shift of boundaries, then the earlier start, then the earlier end.
    """
    out = np.full(len(s), -1, dtype=np.int64)
    real = np.flatnonzero(e2 > s2)
    a, b = s2[real], e2[real]
    rows = np.flatnonzero(e > s)
    if len(real) and len(rows):
        start, end = s[rows], e[rows]
        by_start = np.argsort(a, kind="stable")
        sorted_a, furthest = a[by_start], np.maximum.accumulate(b[by_start])
        before = np.searchsorted(sorted_a, start, side="right")
        held = (before > 0) & (furthest[np.maximum(before, 1) - 1] >= end)
        order, rank = _ranks(b - a, a)
        whole = _taken(order, smallest_beyond(a, b, rank, start[held], end[held]))
        out[rows[held]] = real[whole]
        # No interval holds the others: what starts before ends before them, what ends after starts after them.
        rows, start, end = rows[~held], start[~held], end[~held]
        order, rank = _ranks(a - b, a)
        found = [_taken(order, smallest_beyond(-a, -b, rank, -start, -end))]
        order, rank = _ranks(b, a)
        upto = np.searchsorted(sorted_a, start)
        found.append(np.where(upto > 0, order[np.maximum.accumulate(rank[by_start])[np.maximum(upto, 1) - 1]], -1))
        order, rank = _ranks(a, b)
        by_end = np.argsort(b, kind="stable")
        after = np.searchsorted(b[by_end], end, side="right")
        least = np.append(np.minimum.accumulate(rank[by_end][::-1])[::-1], len(a))
        found.append(_taken(order, least[after]))
        share = [np.where(f >= 0, np.minimum(end, b[f]) - np.maximum(start, a[f]), 0) for f in found]
        shift = [np.abs(start - a[f]) + np.abs(end - b[f]) for f in found]
        first = np.lexsort((np.stack([b[f] for f in found]), np.stack([a[f] for f in found]), np.stack(shift), -np.stack(share)), axis=0)[0]
        pick = lambda columns: np.stack(columns)[first, np.arange(len(rows))]
        enough = (pick(share) > 0) & (pick(share) / np.maximum(1, end - start) >= ratio)
        out[rows[enough]] = real[pick(found)[enough]]
    # What has boundaries near its own shares enough if it is long; only short ones are left.
    left = np.flatnonzero((out < 0) & (e - s - 2 * tolerance < ratio * np.maximum(1, e - s)))
    order = np.argsort(s2, kind="stable")
    low, high = (np.searchsorted(s2[order], s[left] + d, side=side) for d, side in ((-tolerance, "left"), (tolerance, "right")))
    total = np.cumsum(high - low)
    begin = 0
    while begin < len(left):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HELD_PAIRS, side="right")))
        n = high[begin:stop] - low[begin:stop]
        row = np.repeat(left[begin:stop], n)
        parent = order[np.repeat(low[begin:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        near = (np.abs(e[row] - e2[parent]) <= tolerance) & (np.abs(s[row] - s2[parent]) <= tolerance)
        row, parent = row[near], parent[near]
        shared = np.maximum(0, np.minimum(e[row], e2[parent]) - np.maximum(s[row], s2[parent]))
        best = np.lexsort((e2[parent], s2[parent], np.abs(s[row] - s2[parent]) + np.abs(e[row] - e2[parent]), -shared, row))
        row, parent = row[best], parent[best]
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
        out[row[head]] = parent[head]
        begin = stop
    return out
