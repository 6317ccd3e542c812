"""Composite keys as bytes whose order is the order of the parts, and their parts read back.

A NULL part is the byte 0, which comes before all else; other parts begin with the byte 1. Integers
follow as 8 bytes, most significant first, with the sign bit turned. Doubles are integers of their
bits, in which negative ones have all but the sign turned (-0.0 is 0.0, NaN comes last), dates are
their days and times without a zone their microseconds since 1970. Texts follow as UTF-8 with
each byte 0 followed by a 1, and end with two bytes 0. So no key of a table is a prefix of another,
and the leading parts of a key are a prefix of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, PRESENT, END = "00", "01", "0000"
_NUMBER = f"({NULL}|{PRESENT}.{{16}})"
#: What a part looks like in hexadecimal digits: integer, double, date, time, text.
PARTS = {"i": _NUMBER, ".": _NUMBER, "b": _NUMBER, "e": _NUMBER, "t": f"({NULL}|{PRESENT}(?:(?!{END})..)*+{END})"}
_EPOCH = "1970-01-01 00:00:00"


def key_digits(parts: list[tuple[Column, str]]) -> Column:
    """Upper-case hexadecimal digits of the key of ``(column, kind)`` parts; these sort as the bytes do."""
    return F.concat(*[F.coalesce(F.when(c.isNotNull(), F.concat(F.lit(PRESENT), _text(c) if kind == "t" else _integer(_whole(c, kind)))), F.lit(NULL)) for c, kind in parts])


def key_bytes(parts: list[tuple[Column, str]]) -> Column:
    return F.unhex(key_digits(parts))


def key_part(key: Column, kinds: str, at: int) -> Column:
    """Part ``at`` (from 0) of a key whose parts are of the kinds given, one letter each."""
    found = F.regexp_extract(F.hex(key), "^" + "".join(PARTS[k] for k in kinds), at + 1)
    if kinds[at] == "t":
        value = F.replace(F.decode(F.unhex(F.substring(found, F.lit(3), F.length(found) - 6)), "UTF-8"), F.lit("\0\1"), F.lit("\0"))
    else:
        high = F.conv(F.substring(found, 3, 8), 16, 10).cast("bigint") - (1 << 31)
        value = _typed(F.shiftleft(high, 32).bitwiseOR(F.conv(F.substring(found, 11, 8), 16, 10).cast("bigint")), kinds[at])
    return F.when(found != NULL, value)


def _turned(bits: Column) -> Column:
    """Bits of a double as an integer of the same order, and back."""
    return bits.bitwiseXOR(F.shiftrightunsigned(F.shiftright(bits, 63), 1))


def _whole(value: Column, kind: str) -> Column:
    if kind == ".":
        return _turned(F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value, F.lit(0.0)) + F.lit(0.0)).cast("bigint"))
    if kind == "b":
        return F.unix_date(value)
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), value.cast("timestamp_ntz")) if kind == "e" else value


def _typed(whole: Column, kind: str) -> Column:
    whole = F.coalesce(whole, F.lit(0))
    if kind == ".":
        return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), _turned(whole)).cast("double")
    if kind == "b":
        return F.date_from_unix_date(whole.cast("int"))
    seconds = (whole.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit(_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds) if kind == "e" else whole


def _integer(value: Column) -> Column:
    turned = value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    return F.lpad(F.hex(turned), 16, "0")


def _text(value: Column) -> Column:
    return F.concat(F.hex(F.encode(F.replace(value, F.lit("\0"), F.lit("\0\1")), "UTF-8")), F.lit(END))
