"""Dense row ids in key order without one large partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import stage

BLOCK_ROWS = 64
#: Bits in which ``monotonically_increasing_id`` has the place within a partition.
_PLACE_BITS = 33


def with_row_id(df: DataFrame, keys: list[str], name: str = "row_id") -> DataFrame:
    """Number rows from 0 in the order of ``keys`` (NULLs first): one range shuffle, whose sorted
    partitions are numbered as they are written."""
    return _numbered(df.repartitionByRange(*keys).sortWithinPartitions(*keys), name)


def in_order(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number rows from 0 as the source gives them, without a shuffle."""
    return _numbered(df, name)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Positions within partitions are written with the rows: bounds of a range partitioning are
    sampled again on each run, so counts and ids must come from the same files. The only window
    without a key runs over one row a partition."""
    part, local = "_part", "_local"
    at = F.monotonically_increasing_id()
    placed = stage(df.withColumn(part, F.shiftright(at, _PLACE_BITS).cast("int")).withColumn(local, at.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))), "rowid")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.select(part, (F.sum("_rows").over(Window.orderBy(part)) - F.col("_rows")).alias("_start"))
    return placed.join(starts, part).withColumn(name, (F.col("_start") + F.col(local)).cast("bigint")).select(name, *df.columns)


def block_of(row_id: Column, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(row_id / rows).cast("bigint")


def assert_dense(df: DataFrame, name: str = "row_id") -> None:
    n, distinct, last = df.agg(F.count(name), F.count_distinct(name), F.max(name)).first()
    if not (n == distinct and (n == 0 or last == n - 1)):
        raise AssertionError(f"row ids aren't dense: {n} rows, {distinct} ids, last {last}")
