"""Scalar expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(value: Column) -> Column:
    return F.octet_length(value)


def byte_checksum(text: Column) -> Column:
    """Sum of the unsigned bytes of a text in UTF-8."""
    digits = F.hex(F.encode(text, "UTF-8"))
    pairs = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    summed = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda total, at: total + F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(F.length(digits) == 0, F.lit(0).cast("bigint")).otherwise(summed)


def zigzag(value: Column) -> Column:
    """Signed to unsigned folding: 0, -1, 1, -2 become 0, 1, 2, 3."""
    value = value.cast("bigint")
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-(value.bitwiseAND(F.lit(1).cast("bigint"))))


def bits_needed(value: Column) -> Column:
    """Width of a non-negative integer in bits, 1 for zero."""
    return F.length(F.bin(value)).cast("int")


def bytes_needed(value: Column) -> Column:
    return F.ceil(bits_needed(value) / 8).cast("int")


def decimal_scale(value: Column) -> Column:
    """Decimal digits after the point in the shortest text of a double; NULL for what isn't finite."""
    text = F.abs(value).cast("string")
    exponent = F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    digits = F.length(F.regexp_replace(F.regexp_extract(text, r"\.(\d*)", 1), "0+$", ""))
    return F.when(F.abs(value) < float("inf"), F.greatest(digits - exponent, F.lit(0))).cast("int")


def power_of_ten(places: Column, most: int = 15) -> Column:
    """Exact powers from 0 to ``most``; NULL beyond."""
    return F.get(F.array(*[F.lit(float(10**k)) for k in range(most + 1)]), places)


def scaled_integer(value: Column, places: Column) -> Column:
    """``value`` times a power of ten as an integer, if that gives the value back exactly and fits
    in 54 bits and a sign; else NULL."""
    power = power_of_ten(places)
    whole = F.rint(value * power).try_cast("bigint")
    return F.when((F.abs(whole) < 1 << 54) & (whole / power == value), whole)
