"""Byte-pair merging with a heap of adjacent pairs over a doubly linked list of symbols."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence


def merges(text: Sequence, rank: Callable, cuts: bytearray | None = None) -> int:
    """How many merges byte-pair encoding makes in a string of symbols.

    rank(piece) is a piece's rank, or None. Each live symbol is known by
    its start; after[i] is where the symbol that starts at i ends, before[i]
    where its left neighbour starts. The pair of lowest rank goes first, the
    leftmost of equals. A popped pair counts only if its two symbols still
    stand as they did when it was pushed: its text runs from i to end, and
    mid must be the border between them. cuts, if given, has a byte for each
    symbol and one more; borders that are merged away become 0.
    """
    n = len(text)
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
    if not heap:
        return 0
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    after, before, done = list(range(1, n + 1)), list(range(-1, n)), 0
    while heap:
        _, i, mid, end = pop(heap)
        if after[i] != mid or mid >= n or after[mid] != end:
            continue
        done += 1
        after[i], after[mid] = end, -1
        if cuts is not None:
            cuts[mid] = 0
        if end < n:
            before[end] = i
            if (r := rank(text[i : (k := after[end])])) is not None:
                push(heap, (r, i, end, k))
        if i and (r := rank(text[(h := before[i]) : end])) is not None:
            push(heap, (r, h, i, end))
    return done


class Memo(dict):
    """A bounded memo: emptied when full, so that it never outgrows a worker."""

    def __init__(self, compute: Callable, limit: int = 1_000_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
