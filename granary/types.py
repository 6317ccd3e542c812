"""Storage letters: the declared column types of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Storage letters, Java date patterns, unit of the stored integer.
DATE_FORMATS = {
    "`": ("MM/dd/yyyy", "day"),
    "a": ("dd/MM/yyyy", "day"),
    "b": ("yyyy-MM-dd", "day"),
    "c": ("MM/dd/yyyy hh:mm a", "second"),
    "d": ("dd/MM/yyyy HH:mm:ss", "second"),
    "e": ("yyyy-MM-dd HH:mm:ss", "second"),
    "f": ("yyyy-MM-dd'T'HH:mm:ss", "second"),
    "g": ("yyyy-MM-dd HH:mm:ss[.SSS]", "milli"),
    "h": ("yyyy-MM-dd'T'HH:mm:ss[.SSS]", "milli"),
}
DECIMALS = "0123456789"
EXCLUDE = "-"
SECONDARY = "S"
ENCODINGS = "udvtTwWs"


class SpecError(ValueError):
    """A type, encoding or key specification that can't be met."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    letter: str
    encoding: str = "u"

    def __post_init__(self):
        known = self.letter in DATE_FORMATS or self.letter in DECIMALS or self.letter in "t*i.-S"
        if not known or len(self.letter) != 1:
            raise SpecError(f"column {self.name!r}: unknown storage letter {self.letter!r}")
        if self.encoding not in ENCODINGS:
            raise SpecError(f"column {self.name!r}: unknown encoding letter {self.encoding!r}")
        if self.encoding in "wW" and self.letter != "t":
            raise SpecError(f"column {self.name!r}: word encodings are for text only")
        if self.encoding == "d" and self.letter in "t*":
            raise SpecError(f"column {self.name!r}: delta encoding is for numbers only")

    def spark_type(self) -> str:
        if self.letter == "t":
            return "string"
        if self.letter == "*":
            return "binary"
        if self.letter == "i":
            return "bigint"
        if self.letter == "." or self.letter in DECIMALS:
            return "double"
        return "date" if DATE_FORMATS[self.letter][1] == "day" else "timestamp_ntz"


def truncate(value: Column, decimals: int) -> Column:
    """Cut a double toward zero at ``decimals`` places of the IEEE product."""
    scale = F.lit(float(10**decimals))
    return (value * scale).try_cast("bigint") / scale


def coerce(spec: ColumnSpec, value: Column, source_type: str) -> Column:
    """Typed value of one cell; what can't be read is NULL, never the row before's value."""
    if spec.letter == "t":
        return value.cast("string")
    if spec.letter == "*":
        return value.cast("string").cast("binary") if source_type != "binary" else value
    if spec.letter == "i":
        return value.try_cast("bigint")
    if spec.letter == ".":
        return value.try_cast("double")
    if spec.letter in DECIMALS:
        return truncate(value.try_cast("double"), int(spec.letter))
    pattern, unit = DATE_FORMATS[spec.letter]
    target = "date" if unit == "day" else "timestamp_ntz"
    if source_type in ("date", "timestamp", "timestamp_ntz"):
        return value.cast(target)
    return parse_datetime(value.cast("string"), spec.letter).cast(target)


def parse_datetime(text: Column, letter: str) -> Column:
    """Timestamp of a text in the letter's format, NULL if it doesn't fit.

    Fractions count by value: ``.5`` is 500 ms and digits past the third are cut.
    """
    pattern, unit = DATE_FORMATS[letter]
    if unit == "milli":
        fraction = F.regexp_extract(text, r"\.(\d+)$", 1)
        text = F.when(
            fraction != "",
            F.concat(F.regexp_replace(text, r"\.\d+$", "."), F.rpad(F.substring(fraction, 1, 3), 3, "0")),
        ).otherwise(text)
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def format_datetime(value: Column, letter: str) -> Column:
    pattern = DATE_FORMATS[letter][0].replace("[.SSS]", ".SSS")
    return F.date_format(value, pattern)


def stored_integer(value: Column, letter: str) -> Column:
    """Days, seconds or milliseconds since 1970-01-01, as the letter's unit says."""
    unit = DATE_FORMATS[letter][1]
    if unit == "day":
        return F.unix_date(value.cast("date")).cast("bigint")
    stamp = value.cast("timestamp")
    return F.unix_seconds(stamp) if unit == "second" else F.unix_millis(stamp)


def column_specs(names: list[str], letters: str, encodings: str | None = None) -> list[ColumnSpec]:
    """One spec for each source column; fewer letters than columns is an error."""
    encodings = encodings or "u" * len(letters)
    if len(letters) < len(names) or len(encodings) < len(names):
        raise SpecError(f"{len(names)} columns need as many type and encoding letters")
    return [ColumnSpec(n, c, e) for n, c, e in zip(names, letters, encodings, strict=False)]
