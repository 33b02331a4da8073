"""Suffix arrays by induced sorting, in numpy.

Suffixes are classed as smaller or larger than their right neighbour; the
leftmost smaller ones (LMS) cut the string into substrings, which are sorted
by inducing from their first symbols, named, and sorted recursively as a
shorter string while names repeat. Inducing places each suffix next to its
right neighbour's place, in one scan up for the larger and one down for the
smaller suffixes.

A scan is done in runs rather than one suffix at a time: everything up to the
first slot of its kind that is still empty is final and can be used at once,
since what it induces lands behind that slot. All steps are linear but the
stable sorts of symbols within a run.
"""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order of keys, the different keys, their counts, and each entry's place among equals."""
    order = np.argsort(keys, kind="stable")  # by radix for symbols of 8 or 16 bits
    k = keys[order]
    edge = (k[1:] != k[:-1]).nonzero()[0]
    edge += 1
    first, count = np.empty((2, len(edge) + 1), np.int64)
    first[0], first[1:] = 0, edge
    count[:-1] = edge
    count[-1] = len(k)
    count -= first
    within = np.arange(len(k), dtype=np.int32)
    within -= first.astype(np.int32).repeat(count)
    return order, k[first].astype(np.int64), count, within


def _next_open(now: np.ndarray, end: np.ndarray, c: int, step: int) -> int:
    """The first bucket from c on, in direction step, with now != end; -1 if none."""
    width = 64
    while 0 <= c < len(now):
        a, b = (c, min(len(now), c + width)) if step > 0 else (max(0, c - width + 1), c + 1)
        open_ = (now[a:b] != end[a:b]).nonzero()[0]
        if len(open_):
            return a + int(open_[0 if step > 0 else -1])
        c = b if step > 0 else a - 1
        width *= 4
    return -1


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray, larger: np.ndarray) -> np.ndarray:
    """The suffix array induced from LMS suffixes in the given order.

    starts: where each symbol's bucket begins, and the end of the last;
    larger: how many suffixes of each bucket are larger than their neighbour.
    """
    n, symbols = len(s), len(starts) - 1
    sa = np.full(n, -1, np.int32)
    order, keys, count, within = _ranks(s[lms])
    sa[(starts[keys + 1] - count).repeat(count) + within] = lms[order]
    head, full = starts[:-1].copy(), starts[:-1] + larger
    p, c = 0, 0
    while p < n:
        c = _next_open(head, full, c, 1)
        q = n if c < 0 else int(head[c])
        j = sa[p:q]
        j = j[j > 0] - 1
        j = j[~smaller[j]]
        if len(j):
            order, keys, count, within = _ranks(s[j])
            sa[head[keys].repeat(count) + within] = j[order]
            head[keys] += count
        if c < 0:
            break
        p = q
    mid = full
    slots = np.stack([larger, np.diff(starts) - larger], 1).ravel()
    for_smaller = np.repeat(np.arange(2 * symbols) % 2 == 1, slots)
    for_smaller[0] = False  # the sentinel's
    sa[for_smaller] = -1
    tail, empty = starts[1:].copy(), mid.copy()
    tail[0] = empty[0] = 0
    p, c = n, symbols - 1
    while p > 0:
        c = _next_open(tail, empty, c, -1)
        q = 0 if c < 0 else int(tail[c])  # slots from q on are final
        j = sa[q:p][::-1]
        j = j[j > 0] - 1
        j = j[smaller[j]]
        if len(j):
            order, keys, count, within = _ranks(s[j])
            sa[(tail[keys] - 1).repeat(count) - within] = j[order]
            tail[keys] -= count
        if c < 0:
            break
        p = q
    return sa


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Of a string of symbols below `symbols`, whose last one is 0 and occurs once."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    s = s.astype(np.uint8 if symbols <= 1 << 8 else np.uint16 if symbols <= 1 << 16 else np.int32, copy=False)
    change = np.flatnonzero(s[:-1] != s[1:])  # ends with n - 2: the last symbol occurs once
    smaller = np.empty(n, bool)
    smaller[:-1] = np.repeat(s[change] < s[change + 1], np.diff(change, prepend=-1))
    smaller[-1] = True
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
    larger = np.bincount(s[~smaller], minlength=symbols)
    sa = _induce(s, smaller, lms, starts, larger)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        sorted_lms = sa[is_lms[sa]]
        size = np.zeros(n, np.int32)  # of the LMS substring, with the next one's first symbol
        size[lms[:-1]] = np.diff(lms) + 1
        size[lms[-1]] = 1
        a, b = sorted_lms[:-1], sorted_lms[1:]
        same = size[a] == size[b]
        k = np.flatnonzero(same)
        lengths = size[a[k]]
        begin = np.cumsum(lengths, dtype=np.int32) - lengths
        off = np.arange(lengths.sum(), dtype=np.int32)
        x, y = np.repeat(a[k] - begin, lengths) + off, np.repeat(b[k] - begin, lengths) + off
        unequal = (s[x] != s[y]) | (smaller[x] != smaller[y])
        if len(k):
            same[k] = ~np.logical_or.reduceat(unequal, begin)
        names = np.concatenate([[0], np.cumsum(~same)])
        if names[-1] + 1 < len(lms):
            name_of = np.zeros(n, np.int32)
            name_of[sorted_lms] = names
            order = suffix_array(name_of[lms], int(names[-1]) + 1)
            sorted_lms = lms[order]
        sa = _induce(s, smaller, sorted_lms, starts, larger)
    return sa


def common_prefixes(s: np.ndarray, sa: np.ndarray, cap: int, only: np.ndarray | None = None) -> np.ndarray:
    """Permuted: for each position, the length in common with the suffix sorted before it, at most cap.

    s has one byte a symbol; eight of them are compared at a time. only: marks
    positions; where it does not mark both suffixes, the length stays 0.
    """
    n = len(s)
    before = np.empty(n, np.int32)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    padded = np.concatenate([s.astype(np.uint8), np.zeros(cap + 16, np.uint8)])
    eight = np.ndarray((n + cap + 8,), "<u8", padded, strides=(1,))
    out = np.zeros(n, np.int32)
    live = np.flatnonzero((before >= 0) if only is None else (before >= 0) & only & only[before]).astype(np.int32)
    other = before[live]
    for d in range(0, cap, 8):
        unlike = eight[live + d] ^ eight[other + d]
        same = unlike == 0
        end, rest = live[~same], unlike[~same]
        out[end] = d + sum(((rest << np.uint64(64 - 8 * k)) == 0).astype(np.int32) for k in range(1, 8))
        live, other = live[same], other[same]
        out[live] = d + 8
        if not len(live):
            break
    # zeros behind the end equal the last symbol at most; no two suffixes are equal to their ends
    return np.minimum(out, np.minimum(cap, n - np.maximum(np.arange(n), before)))
