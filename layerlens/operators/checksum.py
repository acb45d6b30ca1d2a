"""A block's checksum over whole words: each times a constant modulo 2 ** 64, XORed.  It combines before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the file format.
SEED, FACTOR = 5381, 0xBF58476D1CE4E5B9
_MASK = 0xFFFFFFFF


def _low_product(a: Column, factor: int) -> tuple[Column, Column]:
    """a (under 2 ** 32) times a factor under 2 ** 32, as its lower and upper 32 bits; no step leaves 63 bits."""
    near, far = a.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(factor).cast("long"), F.shiftright(a, 16) * F.lit(factor).cast("long")
    lower = near + F.shiftleft(far.bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return lower.bitwiseAND(F.lit(_MASK).cast("long")), F.shiftright(lower, 32) + F.shiftright(far, 16)


def product(word: Column) -> Column:
    """word times FACTOR modulo 2 ** 64, as a signed long."""
    word, mask = word.cast("long"), F.lit(_MASK).cast("long")
    low, high = word.bitwiseAND(mask), F.shiftrightunsigned(word, 32)
    lower, carry = _low_product(low, FACTOR & _MASK)
    upper = carry + _low_product(low, FACTOR >> 32)[0] + _low_product(high, FACTOR & _MASK)[0]
    return F.shiftleft(upper.bitwiseAND(mask), 32).bitwiseOR(lower)


def checksum(word: Column) -> Column:
    """Aggregate: the checksum of a group's words; the seed alone where all are null."""
    return F.coalesce(F.bit_xor(product(word)), F.lit(0).cast("long")).bitwiseXOR(F.lit(SEED).cast("long"))
