"""Hash arithmetic on BIGINT columns that hold unsigned 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex16_to_word(x: Column) -> Column:
    """The word that exactly 16 hexadecimal digits spell, else null."""
    return F.when(x.rlike("^[0-9a-fA-F]{16}$"), F.conv(x, 16, -10).cast("bigint"))


def segments(h: Column, bits: int = 4) -> Column:
    """The word cut into 64 / bits segments, first bits first; slot numbers as segment * 2**bits + value."""
    n = 64 // bits
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: s * (1 << bits) + F.call_function("shiftrightunsigned", h, F.lit(64 - bits) - s * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))


def descriptor_distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Half the distance of two-word descriptors, rounded up."""
    return F.floor((hamming(a1, b1) + hamming(a2, b2) + 1) / 2).cast("int")


def mean_abs_delta(a: Column, b: Column) -> Column:
    """Floor of the mean absolute difference of two byte arrays, 255 at most; 0 where they are empty."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(F.size(a) == 0, F.lit(0)).otherwise(F.least(F.lit(255), F.floor(total / F.size(a)))).cast("int")


def text_grid_delta(a: Column, b: Column) -> Column:
    return F.when((F.size(a) != 64) | (F.size(b) != 64), F.lit(255)).otherwise(mean_abs_delta(a, b))


def word_from_bits(bits: Column) -> Column:
    """A word whose first bit is the first of 64 booleans."""
    placed = F.transform(bits, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(63) - i).cast("int"))).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(placed, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
