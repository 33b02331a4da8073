"""The distances, as one bit-parallel recurrence with options.

A pattern of m symbols slides over a text; score[j] is the cost of the best
alignment of the whole pattern that ends at text position j, starting anywhere
(or, with anchor 'start', at the text's first symbol). Bit i of each vector
stands for pattern row i. With E the match mask of the text symbol:

  compat       X = E | M-;  D = ((~D' & X) << 1 & X') | (((X & P) + P) ^ P) | X | M-
  osa          X = E;       D = ((~D' & X) << 1 & X') | (((X & P) + P) ^ P) | X | M-
  levenshtein  X = E;       D =                         (((X & P) + P) ^ P) | X | M-

where P and M- are the vertical differences, and D', X' the values before.
'compat' is a swap-aware distance close to optimal string alignment (osa) but
not equal to it; in rare places it is lower. It is the default.
"""

from __future__ import annotations

from collections.abc import Sequence

METRICS = ("compat", "osa", "levenshtein")
ANCHORS = ("any", "start")


def checked(metric: str, anchor: str = "any") -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    if anchor not in ANCHORS:
        raise ValueError(f"anchor must be one of {ANCHORS}, not {anchor!r}")


def scores(pattern: Sequence, text: Sequence, metric: str = "compat", anchor: str = "any") -> list[int]:
    """All scores, in Python integers of any length; the plain form that other kernels are tested against."""
    checked(metric, anchor)
    m = len(pattern)
    if m == 0:
        raise ValueError("a pattern needs a symbol")
    mask, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, xb, db, score, out = mask, 0, 0, 0, m, []
    carry = int(anchor == "start")
    for c in text:
        x = eq.get(c, 0)
        if metric == "compat":
            x |= mv
        d = (((x & pv) + pv) ^ pv) | x | mv
        if metric != "levenshtein":
            d |= ((~db & x) << 1) & xb
        ph, mh = mv | ~(d | pv), d & pv
        score += bool(ph & top) - bool(mh & top)
        h = ph << 1 | carry
        pv, mv, xb, db = (mh << 1 | ~(d | h)) & mask, d & h & mask, x, d
        out.append(score)
    return out


def summary(found: Sequence[int], m: int) -> tuple[list[int], int, list[int], int | None]:
    """(hits, lowest score, its positions, last score); the lowest starts at m, so nothing above it counts."""
    low = min([m, *found])
    return [j for j, s in enumerate(found) if s == 0], low, [j for j, s in enumerate(found) if s == low], found[-1] if len(found) else None
