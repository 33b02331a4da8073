"""Word hashes of whole Arrow string columns in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []
_KEYS = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


#: A random number for each byte value.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, p, np.uint64))]) for p in (_ODD, _INV)]
    return _POWERS


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() gets any span's hash; values has a number for each byte."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start])


def width_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """span_hash of every span of `width` bytes, by start."""
    return mix((sums[width:] - sums[:-width]) * _powers(len(sums))[1][: len(sums) - width])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the offsets of its values in them; null is empty."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `size` bytes."""
    raw, at = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(raw: np.ndarray, at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and the offsets of the texts' words; apart: which byte values separate words."""
    inside = ~apart[raw]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    border = np.zeros(len(raw) + 1, bool)
    border[at] = True
    before, after = np.empty(len(raw), bool), np.empty(len(raw), bool)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    start = np.flatnonzero(inside & (before | border[:-1]))
    end = np.flatnonzero(inside & (after | border[1:])) + 1
    return start, end, np.searchsorted(start, at)


def place_keys(n: int) -> np.ndarray:
    """An odd random multiplier for each place in a word."""
    global _KEYS
    if len(_KEYS) < n:
        _KEYS = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    return _KEYS


def words(raw: np.ndarray, at: np.ndarray, apart: np.ndarray, fold: np.ndarray = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash, and the offsets of the texts' words; fold: each byte value's number.

    Every place in a word has a random multiplier of its own (powers of one
    number would make regular words of 1,024 letters collide).
    """
    start, end, word_at = word_spans(raw, at, apart)
    if not len(start):
        return np.zeros(0, np.uint64), word_at
    keys = place_keys(int((end - start).max()))
    begin = np.zeros(len(raw), np.int32)
    begin[start] = start
    place = np.arange(len(raw), dtype=np.int32)
    place -= np.maximum.accumulate(begin, out=begin)
    values = np.where(apart, np.uint64(0), fold)[raw]
    values *= keys.take(place, mode="clip")
    return mix(np.add.reduceat(values, start)), word_at


def separators(inside: str) -> np.ndarray:
    """'space': words end at white space; 'letters': at every ASCII character that is no letter."""
    out = np.zeros(256, bool)
    if inside == "space":
        out[[0x20, *range(0x09, 0x0E)]] = True
    else:
        out[:0x80] = True
        out[ord("a") : ord("z") + 1] = out[ord("A") : ord("Z") + 1] = False
    return out


#: Bytes as they are but A-Z, which hash as a-z.
FOLDED = BYTES.copy()
FOLDED[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
