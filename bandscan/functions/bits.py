"""Bit vectors: columns of BIGINT limbs, and strings of 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_count(a: Column) -> Column:
    return F.bit_count(a)


def hamming(a: Column, b: Column) -> Column:
    """How many bits differ."""
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """Common bits over united bits; null for two zeros."""
    both = F.bit_count(a.bitwiseOR(b))
    return F.when(both > 0, F.bit_count(a.bitwiseAND(b)) / both)


def set_bit(a: Column, i: Column) -> Column:
    return a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))


def clear_bit(a: Column, i: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))


def test_bit(a: Column, i: Column) -> Column:
    return F.getbit(a, i.cast("int")) == 1


def low_mask(m: Column) -> Column:
    """A mask of the m lowest bits, m to 62."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), m.cast("int")) - 1


def add_with_carry(a: Column, b: Column, carry: Column, bits: int = 60) -> Column:
    """(sum, carry) of limbs below 2**bits; bits to 61, so that no sum overflows."""
    total = a + b + carry
    return F.struct(total.bitwiseAND(F.lit((1 << bits) - 1)).alias("sum"), F.shiftright(total, bits).alias("carry"))


def shifted_left(limbs: Column, bits: int = 60) -> Column:
    """An array of limbs, lowest first, moved up by one bit."""
    return F.transform(limbs, lambda x, i: F.shiftleft(x, 1).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.coalesce(F.shiftright(F.get(limbs, i - 1), bits - 1), F.lit(0).cast("long"))))


def shifted_right(limbs: Column, bits: int = 60) -> Column:
    """An array of limbs, lowest first, moved down by one bit."""
    low = lambda x: F.shiftleft(x.bitwiseAND(F.lit(1).cast("long")), bits - 1)
    return F.transform(limbs, lambda x, i: F.shiftright(x, 1).bitwiseOR(F.coalesce(low(F.get(limbs, i + 1)), F.lit(0).cast("long"))))


def bit_string(a: Column, width: int) -> Column:
    """The lowest bits as text, highest first."""
    return F.right(F.lpad(F.bin(a), 64, "0"), F.lit(width))


def next_set_bit(bits: Column, start: int = 0) -> Column:
    """The first place of a 1 from start on in a string of bits, from 0; -1 if none."""
    return F.locate("1", bits, start + 1) - 1


def rank(bits: Column, at: int) -> Column:
    """How many 1s stand up to and with a place."""
    return F.length(F.regexp_replace(F.substring(bits, 1, at + 1), "0", ""))


def runs(bits: Column) -> Column:
    """The runs of equal bits."""
    return F.regexp_extract_all(bits, F.lit("0+|1+"), F.lit(0))


def rotated_left(bits: Column, by: int) -> Column:
    k = F.pmod(F.lit(by), F.length(bits))
    return F.concat(F.substring(bits, k + 1, F.length(bits)), F.substring(bits, F.lit(1), k))


def rotated_right(bits: Column, by: int) -> Column:
    k = F.pmod(F.lit(-by), F.length(bits))
    return F.concat(F.substring(bits, k + 1, F.length(bits)), F.substring(bits, F.lit(1), k))


def padded_right(bits: Column, n: int) -> Column:
    return F.concat(bits, F.lit("0" * n))


def padded_left(bits: Column, n: int) -> Column:
    return F.concat(F.lit("0" * n), bits)


def reversed_bits(bits: Column) -> Column:
    return F.reverse(bits)


def contains(bits: Column, part: Column) -> Column:
    return F.contains(bits, part)
