"""Column summaries in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measured(df: DataFrame, column: str) -> Column:
    """What a column's summary is about: numbers as they are, texts by their bytes, dates as days,
    times as seconds. All but doubles are integers and stay exact."""
    kind = dict(df.dtypes)[column]
    if kind in ("string", "binary"):
        return F.octet_length(column).cast("bigint")
    if kind in ("date",):
        return F.unix_date(column).cast("bigint")
    if kind.startswith("timestamp"):
        return F.unix_seconds(F.col(column).cast("timestamp"))
    return F.col(column).cast("bigint" if kind in ("bigint", "int", "smallint", "tinyint", "boolean") else "double")


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, null_count, min_int, max_int, min_double, max_double, max_len)``: one
    aggregation, then one row for each column. Integers, lengths and dates have the former pair,
    other numbers the latter."""
    columns = columns or df.columns
    kinds = dict(df.select(*[measured(df, c).alias(c) for c in columns]).dtypes)
    parts, rows = [], []
    for i, c in enumerate(columns):
        value = measured(df, c)
        parts += [F.count_if(F.col(c).isNull()).alias(f"n{i}"), F.min(value).alias(f"a{i}"), F.max(value).alias(f"b{i}"), F.max(F.octet_length(F.col(c).cast("string"))).cast("bigint").alias(f"l{i}")]
        of = lambda name, kind: (F.col(name) if kind == kinds[c] else F.lit(None)).cast(kind)  # noqa: B023, E731
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"), of(f"a{i}", "bigint").alias("min_int"), of(f"b{i}", "bigint").alias("max_int"),
            of(f"a{i}", "double").alias("min_double"), of(f"b{i}", "double").alias("max_double"), F.col(f"l{i}").alias("max_len"),
        ))
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def totals(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Sum of each column, texts by their bytes."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        if kinds[c] in ("string", "binary"):
            out.append(F.sum(F.octet_length(c)).cast("bigint").alias(c))
        elif kinds[c] in ("double", "float"):
            out.append(F.round(F.sum(c), digits).alias(c))
        else:
            out.append(F.sum(c).alias(c))
    return df.agg(*out)


def fits_32_bits(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.bool_and(F.col(column).between(-(2**31), 2**31 - 1)).alias("all_32_bit"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("freq"))
