"""Suffix array of an integer string by linear grouping.

Suffixes are grouped by their Lyndon prefix, the shortest prefix that a smaller
suffix follows. Groups are refined from the highest down: when a group is
processed, the nearest earlier position in a lower group (the previous smaller
pointer) of each member is followed by the group's prefix, once for every
member that points to it, so those positions move to the end of their group.
A single pass over the finished order then emits each group's members in the
order of the suffixes that follow their prefixes. Nothing is renamed and
there is no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in ascending order; a shorter suffix precedes its extensions."""
    n = len(symbols) + 1
    if n == 1:
        return np.zeros(0, np.int64)
    codes = np.zeros(n, np.int64)
    codes[:-1] = np.unique(symbols, return_inverse=True)[1] + 1
    order = np.argsort(codes, kind="stable")
    first = np.searchsorted(codes[order], codes)
    at, place, group = order.tolist(), np.argsort(order, kind="stable").tolist(), first.tolist()
    before = [-1] * n
    last = [0] * n  # the last place of the group that starts here
    for start, stop in zip(*_bounds(codes[order]), strict=True):
        last[start] = stop

    high = n - 1
    while high >= 0:
        low = group[at[high]]
        times: dict[int, int] = {}
        for i in sorted(at[low : high + 1]) if high > low else at[low : low + 1]:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            if len(times) == 1:
                levels = [list(times)]
            else:
                by_count: dict[int, list[int]] = {}
                for p, k in times.items():
                    by_count.setdefault(k, []).append(p)
                levels = [by_count[k] for k in sorted(by_count, reverse=True)]
            for level in levels:  # those that the prefix follows most often are the largest
                touched: dict[int, int] = {}
                for p in level:
                    g = group[p]
                    end = touched.get(g)
                    if end is None:
                        end = last[g]
                    other, mine = at[end], place[p]
                    at[end], at[mine] = p, other
                    place[p], place[other] = end, mine
                    touched[g] = end - 1
                for g, end in touched.items():
                    start, stop = end + 1, last[g]
                    if start == g:
                        continue
                    last[g], last[start] = end, stop
                    for k in range(start, stop + 1):
                        group[at[k]] = start
        high = low - 1

    free, out, done = list(range(n)), [0] * n, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = before[p]
    return np.array(out[1:], np.int64)


def _bounds(sorted_: np.ndarray) -> tuple[list[int], list[int]]:
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return starts.tolist(), (np.append(starts[1:], len(sorted_)) - 1).tolist()


def adjacent_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The longest common prefix, up to ``most``, of every two suffixes that are next to each other in ``order``."""
    padded = np.concatenate([symbols, -1 - np.arange(most, dtype=np.int64)])
    a, b = order[:-1], order[1:]
    shared, live = np.zeros(max(len(symbols) - 1, 0), np.int64), np.arange(max(len(symbols) - 1, 0))
    for d in range(most):
        live = live[padded[a[live] + d] == padded[b[live] + d]]
        if not len(live):
            break
        shared[live] += 1
    return shared


def prefix_groups(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """For every position the number of the group of suffixes that agree with it in their first ``depth`` symbols; ``shared``: adjacent prefixes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(shared < depth)])[: len(order)]
    return out
