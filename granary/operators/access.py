"""Key access: exact, batched, prefix, ordered, by rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.rowid import with_row_id


class DuplicateKeyError(ValueError):
    """The primary key isn't unique."""


def lookup(df: DataFrame, key: dict, columns: list[str] | None = None) -> DataFrame:
    """Rows of one key, or of the leading columns of a composite key; equality reaches the scan."""
    hit = reduce(lambda a, b: a & b, [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in key.items()])
    found = df.where(hit)
    return found.select(*columns) if columns else found


def batch_lookup(df: DataFrame, keys: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Each key with the columns of its row and ``found``. The join is left to the optimizer: a
    small key set is broadcast by its measured size, a large one shuffles and skew is split."""
    present = df.select(*on, *columns, F.lit(True).alias("_hit"))
    return keys.join(present, on, "left").select(*keys.columns, *columns, F.coalesce("_hit", F.lit(False)).alias("found"))


def missing_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return keys.join(df.select(*on), on, "left_anti")


def prefix_scan(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with their dense position in byte order."""
    return with_row_id(df.select(*keys).distinct(), keys, "position")


def rank_of(df: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    return values.join(ordered(df, keys), keys, "left")


def key_of(df: DataFrame, keys: list[str], positions: DataFrame) -> DataFrame:
    return positions.join(ordered(df, keys), "position", "left")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise DuplicateKeyError(f"key {keys} occurs {twice[0]['n']} times: {twice[0].asDict()}")


def insert_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Set insert: idempotent on the key."""
    return df.dropDuplicates(keys)


def table_counts(df: DataFrame, keys: list[str], text: list[str]) -> DataFrame:
    longest = [F.max(F.octet_length(c)).cast("bigint").alias(f"max_{c}_len") for c in text]
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(*keys).alias("key_count"), *longest)
