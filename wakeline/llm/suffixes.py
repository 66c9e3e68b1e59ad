"""Suffix arrays by induced sorting, and common prefixes of neighbours in them."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one (S), and which of these are leftmost (LMS)."""
    n = len(t)
    rise = np.diff(t.astype(np.int64))
    where = np.where(rise != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(where[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = rise[following] > 0
    leftmost = smaller.copy()
    leftmost[0] = False
    leftmost[1:] &= ~smaller[:-1]
    return smaller, leftmost


def _places(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, each element's rank among its equals there, the symbols present and their counts."""
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(begin, append=len(symbols))
    return order, np.arange(len(symbols)) - np.repeat(begin, counts), ordered[begin], counts


def _induce(t: np.ndarray, k: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from ``lms`` in order; a bucket's rows are handled together, run by run."""
    n = len(t)
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int64)
    order, rank, present, counts = _places(t[lms])
    seeds = lms[order]
    first_seed = ends.copy()
    first_seed[present] -= counts
    sa[first_seed[t[seeds]] + rank] = seeds

    head = starts.copy()

    def larger_before(items: np.ndarray) -> None:
        before = items[items > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            symbols = t[before]
            order, rank, present, counts = _places(symbols)
            sa[np.repeat(head[present], counts) + rank] = before[order]
            head[present] += counts

    for c in range(k):
        lo = starts[c]
        while lo < head[c]:
            hi = head[c]
            larger_before(sa[lo:hi])
            lo = hi
        if first_seed[c] < ends[c]:
            larger_before(sa[first_seed[c] : ends[c]])

    tail = ends.copy()

    def smaller_before(items: np.ndarray) -> None:
        before = items[items > 0] - 1
        before = before[smaller[before]]
        if len(before):
            symbols = t[before]
            order, rank, present, counts = _places(symbols)
            sa[np.repeat(tail[present], counts) - 1 - rank] = before[order]
            tail[present] -= counts

    for c in range(k - 1, -1, -1):
        hi = ends[c]
        while hi > tail[c]:
            lo = tail[c]
            smaller_before(sa[lo:hi][::-1])
            hi = lo
        if head[c] > starts[c]:
            smaller_before(sa[starts[c] : head[c]][::-1])
    sa[0] = n - 1
    return sa


def _order(names: np.ndarray, distinct: int, reach: int | None) -> np.ndarray:
    """The order of the suffixes of a string of names, by naming pairs of names recursively.

    With ``reach``, suffixes that agree in so many names may stand in any order among themselves.
    """
    step = 1
    while distinct < len(names) and (reach is None or step < reach):
        key = names * np.int64(distinct + 1)
        key[:-step] += names[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        names = np.empty(len(order), np.int64)
        names[order] = fresh
        distinct = int(fresh[-1]) + 1
        step *= 2
    return np.argsort(names, kind="stable")


def suffix_array(t: np.ndarray, k: int, reach: int | None = None) -> np.ndarray:
    """The suffix array of ``t``, whose last symbol is the only 0 and whose symbols are below ``k``.

    Suffixes are classified; the leftmost smaller ones are sorted by their substrings, named, and, where names
    repeat, sorted by recursively named pairs; all others are then induced from them in linear time, a
    bucket at a time. With ``reach``, suffixes with that many symbols in common may stand in any order among themselves.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller, leftmost = _types(t)
    lms = np.flatnonzero(leftmost)
    sa = _induce(t, k, smaller, lms)
    ordered = sa[leftmost[sa]]
    if len(lms) > 1:
        # A substring reaches to the next leftmost smaller suffix, that symbol included.
        length = np.zeros(n, np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        a, b = ordered[:-1], ordered[1:]
        differs = length[a] != length[b]
        open_ = np.flatnonzero(~differs)
        step = 0
        while len(open_):
            unequal = t[a[open_] + step] != t[b[open_] + step]
            differs[open_[unequal]] = True
            step += 1
            open_ = open_[~unequal & (length[a[open_]] > step)]
        names = np.zeros(n, np.int64)
        names[ordered] = np.concatenate([[0], np.cumsum(differs)])
        distinct = int(names[ordered[-1]]) + 1
        if distinct < len(lms):
            ordered = lms[_order(names[lms], distinct, reach and reach // 2 + 1)]
        sa = _induce(t, k, smaller, ordered)
    return sa


def equal_neighbours(data: np.ndarray, sa: np.ndarray, size: int) -> np.ndarray:
    """Which suffixes share their first ``size`` bytes with the suffix before or after them in ``sa``.

    ``data`` holds the bytes, padded so that ``size`` bytes can be read from each suffix in ``sa``. The result is in text
    order (permuted), one flag per byte of ``data``. Prefixes are compared eight bytes at a time, and only as long as equal.
    """
    flags = np.zeros(len(data), bool)
    if len(sa) < 2:
        return flags
    words = np.lib.stride_tricks.as_strided(
        np.ascontiguousarray(data).view(np.uint8), shape=(len(data) - 7, 8), strides=(1, 1)
    )
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    a, b = sa[:-1], sa[1:]
    done = 0
    while done < size:
        at = min(done, size - 8)
        same = words[a + at] == words[b + at]
        a, b = a[same], b[same]
        done = at + 8
    flags[a] = True
    flags[b] = True
    return flags
