"""String and bit functions of index work, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 64


def reverse_complement(text: Column) -> Column:
    return F.translate(F.reverse(text), "ACGTacgt", "TGCAtgca")


def count_after_left_shift(bits: Column, n: int) -> Column:
    """Ones that stay in a 64-bit word shifted left by n."""
    return F.bit_count(F.shiftleft(bits, n)) if n < WORD_BITS else F.lit(0)


def count_after_right_shift(bits: Column, n: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(bits, n)) if n < WORD_BITS else F.lit(0)


def count_signed_shift(bits: Column, n: int) -> Column:
    """Left for negative n, right otherwise."""
    return count_after_left_shift(bits, -n) if n < 0 else count_after_right_shift(bits, n)


def count_outside(bits: Column, n: int, first: bool) -> Column:
    """Ones without the first or the last n bits (bit 0 is first)."""
    return count_after_right_shift(bits, n) if first else count_after_left_shift(bits, n)


def ternary(table: int, a: Column, b: Column, c: Column) -> Column:
    """Any boolean function of three words: bit 4a + 2b + c of the table is its value."""
    out = F.lit(0).cast("long")
    for k in range(8):
        if table >> k & 1:
            term = a if k & 4 else F.bitwise_not(a)
            term = term.bitwiseAND(b if k & 2 else F.bitwise_not(b))
            out = out.bitwiseOR(term.bitwiseAND(c if k & 1 else F.bitwise_not(c)))
    return out


def marks(symbols: Column, value, how: str = "equal") -> Column:
    """Which elements of an array are equal to, at most, or less than a value."""
    tests = {"equal": lambda x: x == value, "at_most": lambda x: x <= value, "less": lambda x: x < value}
    return F.transform(symbols, tests[how])


def bits_of(flags: Column) -> Column:
    """An array of at most 64 booleans as one word, first element lowest."""
    put = F.transform(flags, lambda x, i: F.call_function("shiftleft", x.cast("long"), i))
    return F.aggregate(put, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(v))
