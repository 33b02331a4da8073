"""The recurrence for many pairs at once, in numpy: one lane for each pair, one step for each text symbol."""

from __future__ import annotations

import numpy as np

from bandscan.functions.metrics import checked

ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def symbols(values: list, unit: str) -> list[np.ndarray]:
    """Sequences as arrays of symbols: bytes of UTF-8 text or of binary, or code points."""
    if unit == "char":
        return [np.frombuffer((v if isinstance(v, str) else bytes(v).decode("utf-8", "replace")).encode("utf-32-le"), np.uint32) for v in values]
    return [np.frombuffer(v.encode() if isinstance(v, str) else bytes(v), np.uint8).astype(np.uint32) for v in values]


class Patterns:
    """Patterns of like length, prepared: match masks by symbol, in limbs of 64 bits."""

    def __init__(self, patterns: list[np.ndarray]):
        self.lengths = np.array([len(p) for p in patterns])
        if not len(patterns) or self.lengths.min() == 0:
            raise ValueError("a pattern needs a symbol")
        self.limbs = int(-(-self.lengths.max() // 64))
        #: The narrowest words that hold a column, and scores.
        self.word = next(t for t, bits in ((np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 62)) if self.lengths.max() <= bits)
        self.score = np.int16 if self.lengths.max() < 1 << 14 else np.int32
        self.alphabet = np.unique(np.concatenate(patterns))
        width = len(self.alphabet) + 1  # the last symbol matches nothing
        self.width = width
        self.eq = np.zeros((self.limbs, len(patterns) * width), np.uint64)
        self.mask = np.zeros((self.limbs, len(patterns)), np.uint64)
        self.top_limb, self.top_bit = (self.lengths - 1) // 64, ((self.lengths - 1) % 64).astype(np.uint64)
        for k, p in enumerate(patterns):
            i = np.arange(len(p))
            np.bitwise_or.at(self.eq, (i // 64, k * width + np.searchsorted(self.alphabet, p)), ONE << (i % 64).astype(np.uint64))
            for w in range(self.limbs):
                bits = min(64, max(0, len(p) - 64 * w))
                self.mask[w, k] = ALL if bits == 64 else (ONE << np.uint64(bits)) - ONE

    def encoded(self, text: np.ndarray) -> np.ndarray:
        """Symbols as places in the alphabet; all others get the place after its end."""
        if len(text) and self.alphabet[-1] < 1 << 16:
            table = np.full(int(self.alphabet[-1]) + 2, len(self.alphabet), np.int64)
            table[self.alphabet] = np.arange(len(self.alphabet))
            return table.take(text, mode="clip")
        at = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == text, at, len(self.alphabet)).astype(np.int64)


def _shifted(x: list[np.ndarray], carry: np.ndarray | None = None) -> list[np.ndarray]:
    out, low = [], carry
    for v in x:
        s = v << ONE
        if low is not None:
            s |= low
        out.append(s)
        low = v >> np.uint64(63)
    return out


def _plus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    if len(a) == 1:
        return [a[0] + b[0]]
    out, carry = [], None
    for x, y in zip(a, b):
        s = x + y
        over = s < x
        if carry is not None:
            s = s + carry
            over |= s < carry
        out.append(s)
        carry = over.astype(np.uint64)
    return out


def lane_scores(patterns: Patterns, which: np.ndarray, texts: list[np.ndarray], of: np.ndarray, metric: str = "compat", anchor: str = "any") -> np.ndarray:
    """scores[j, lane] of pattern which[lane] on text of[lane]; past a text's end they mean nothing.

    Lanes should have texts of like length: steps go to the longest.
    """
    checked(metric, anchor)
    steps = max((len(t) for t in texts), default=0)
    codes = np.full((steps, len(texts)), len(patterns.alphabet), np.int64)
    for k, t in enumerate(texts):
        codes[: len(t), k] = patterns.encoded(t)
    if patterns.limbs > 1:
        return _many_limbs(patterns, which, codes, of, metric, anchor)
    base, eq = which * patterns.width, patterns.eq[0].astype(patterns.word)

    def masks(j: int, out: np.ndarray) -> None:
        eq.take(codes[j].take(of) + base, out=out, mode="clip")

    return _one_limb(patterns, which, masks, steps, metric, anchor)


def crossed_scores(patterns: Patterns, which: np.ndarray, codes: np.ndarray, metric: str = "compat", anchor: str = "any") -> np.ndarray:
    """scores[j, lane] of all texts, given as encoded columns of codes, by all patterns of which; patterns vary fastest."""
    texts = codes.shape[1]
    lanes = np.tile(which, texts)
    if patterns.limbs > 1:
        return _many_limbs(patterns, lanes, codes, np.repeat(np.arange(texts), len(which)), metric, anchor)
    rows = np.ascontiguousarray(patterns.eq[0].reshape(-1, patterns.width)[which].T.astype(patterns.word))

    def masks(j: int, out: np.ndarray) -> None:
        rows.take(codes[j], axis=0, out=out.reshape(texts, len(which)), mode="clip")

    return _one_limb(patterns, lanes, masks, len(codes), metric, anchor)


def _one_limb(patterns: Patterns, which: np.ndarray, masks, steps: int, metric: str, anchor: str) -> np.ndarray:
    """Patterns of up to 64 symbols, in words no wider than needed; all steps work in place. masks(j, out) gives step j's match masks."""
    n, word = len(which), patterns.word
    one, mask = word(1), patterns.mask[0][which].astype(word)
    top = patterns.top_bit[which].astype(word)
    pv, mv, xb, db = mask.copy(), np.zeros(n, word), np.zeros(n, word), np.zeros(n, word)
    x, d, t, u = (np.empty(n, word) for _ in range(4))
    score, out = patterns.lengths[which].astype(patterns.score), np.empty((steps, n), patterns.score)
    compat, swaps, start = metric == "compat", metric != "levenshtein", anchor == "start"
    both, bor, inv = np.bitwise_and, np.bitwise_or, np.invert
    for j in range(steps):
        masks(j, x)
        if compat:
            x |= mv
        both(x, pv, out=d)
        d += pv
        d ^= pv
        d |= x
        d |= mv
        if swaps:
            inv(db, out=t)
            t &= x
            t <<= one
            t &= xb
            d |= t
        bor(d, pv, out=t)
        inv(t, out=t)
        t |= mv  # rises
        pv &= d  # falls
        np.right_shift(t, top, out=u)
        u &= one
        np.add(score, u, out=score, casting="unsafe")
        np.right_shift(pv, top, out=u)
        u &= one
        np.subtract(score, u, out=score, casting="unsafe")
        out[j] = score
        t <<= one
        if start:
            t |= one
        both(d, t, out=mv)
        mv &= mask
        bor(d, t, out=t)
        inv(t, out=t)
        pv <<= one
        pv |= t
        pv &= mask
        x, xb, d, db = xb, x, db, d
    return out


def _many_limbs(patterns: Patterns, which: np.ndarray, codes: np.ndarray, of: np.ndarray, metric: str, anchor: str) -> np.ndarray:
    base, mask = which * patterns.width, [m[which] for m in patterns.mask]
    limbs = range(patterns.limbs)
    zero = [np.zeros(len(which), np.uint64) for _ in limbs]
    pv, mv, xb, db = [m.copy() for m in mask], zero, zero, zero
    score, out = patterns.lengths[which].astype(np.int32), np.empty((len(codes), len(which)), np.int32)
    top_limb, top_bit = patterns.top_limb[which], patterns.top_bit[which]
    lanes = np.arange(len(which))
    first = np.ones(len(which), np.uint64) if anchor == "start" else None
    for j in range(len(codes)):
        at = base + codes[j][of]
        x = [e.take(at) for e in patterns.eq]
        if metric == "compat":
            x = [a | b for a, b in zip(x, mv)]
        s = _plus([a & b for a, b in zip(x, pv)], pv)
        d = [(a ^ p) | b | m for a, p, b, m in zip(s, pv, x, mv)]
        if metric != "levenshtein":
            t = _shifted([~a & b for a, b in zip(db, x)])
            d = [a | (b & c) for a, b, c in zip(d, t, xb)]
        ph = [m | ~(a | p) for m, a, p in zip(mv, d, pv)]
        mh = [a & p for a, p in zip(d, pv)]
        up, down = ((np.stack(v)[top_limb, lanes] >> top_bit) & ONE for v in (ph, mh))
        score = score + up.astype(np.int32) - down.astype(np.int32)
        out[j] = score
        h = _shifted(ph, first)
        pv = [(a | ~(b | c)) & k for a, b, c, k in zip(_shifted(mh), d, h, mask)]
        mv = [b & c & k for b, c, k in zip(d, h, mask)]
        xb, db = x, d
    return out
