"""Two-way indexes: value, composite, prefix and word postings as ranges of row ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.words import Splitter, tokens

#: Row ids of a slice; no task holds more rows of one value than a slice has.
SLICE_ROWS = 1 << 20
#: Row ids of the pieces that a range is cut into before it's listed, from the coarsest on.
PIECES = (1 << 32, 1 << 16)


def postings(df: DataFrame, keys: list[str], row_id: str = "row_id", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Ranges of consecutive row ids for each value: ``(keys, row_start, row_end)``.

    A value's rows are dealt over contiguous slices of row ids, so a frequent value never meets in
    one task. Of a slice only the ranges that touch its edges, two at most, are looked at again to
    be joined with those of the slices beside it.
    """
    at = F.col(row_id).cast("bigint")
    sliced = df.select(*keys, at.alias("row_start"), at.alias("row_end"), F.floor(at / slice_rows).alias("_slice"))
    ranges = _islands(sliced, [*keys, "_slice"])
    edge = (F.col("row_start") == F.col("_slice") * slice_rows) | (F.col("row_end") == (F.col("_slice") + 1) * slice_rows - 1)
    inner = ranges.where(~edge).drop("_slice")
    return inner.unionByName(_islands(ranges.where(edge).drop("_slice"), keys))


def _islands(ranges: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("row_start")
    begun = ranges.withColumn("_last", F.lag("row_end").over(order)).withColumn("_new", F.coalesce((F.col("row_start") > F.col("_last") + 1).cast("int"), F.lit(1)))
    run = begun.withColumn("_run", F.sum("_new").over(order))
    return run.groupBy(*keys, "_run").agg(F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end")).drop("_run")


def listed(index: DataFrame, keys: list[str], row_id: str = "row_id", pieces: tuple[int, ...] = PIECES) -> DataFrame:
    """``(keys, row_id)`` of postings. Ranges are cut at multiples of the piece sizes first, so no
    array is longer than the next size has pieces, however long a range is."""
    rows = index.select(*keys, "row_start", "row_end")
    for size in pieces:
        piece = F.explode(F.sequence(_floor("row_start", size), _floor("row_end", size))).alias("_piece")
        rows = rows.select(*keys, "row_start", "row_end", piece)
        rows = rows.select(*keys, F.greatest("row_start", F.col("_piece") * size).alias("row_start"), F.least("row_end", (F.col("_piece") + 1) * size - 1).alias("row_end"))
    return rows.select(*keys, F.explode(F.sequence("row_start", "row_end")).alias(row_id))


def _floor(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size).cast("bigint")


def expand(index: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Row ids of postings, each once."""
    return listed(index, [], row_id).distinct()


def coarse(df: DataFrame, keys: list[str], shift: int, row_id: str = "row_id") -> DataFrame:
    """Block-granular postings; a hit needs the predicate checked again."""
    return df.select(*keys, F.shiftright(row_id, shift).alias("block")).distinct()


def rows_per_value(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def values_in_order(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct().orderBy(*keys)


def word_rows(df: DataFrame, column: str, row_id: str = "row_id", splitter: Splitter = tokens) -> DataFrame:
    """``(word, row_id)`` once for each token of each row."""
    return df.select(row_id, F.explode(F.array_distinct(splitter(F.col(column)))).alias("word"))


def word_prefix_rows(words: DataFrame, prefix: str, row_id: str = "row_id") -> DataFrame:
    return words.where(F.col("word").startswith(prefix)).select(row_id).distinct()


def all_words_rows(words: DataFrame, prefixes: list[str], row_id: str = "row_id") -> DataFrame:
    """Rows that have, for each prefix, a token that starts with it; one pass, one shuffle."""
    hits = [F.max(F.col("word").startswith(p).cast("int")).alias(f"h{i}") for i, p in enumerate(prefixes)]
    some = F.lit(False)
    for p in prefixes:
        some = some | F.col("word").startswith(p)
    found = words.where(some).groupBy(row_id).agg(*hits)
    for i in range(len(prefixes)):
        found = found.where(F.col(f"h{i}") == 1)
    return found.select(row_id)


def rows_with_words(df: DataFrame, column: str, prefixes: list[str], splitter: Splitter = tokens) -> DataFrame:
    """Rows that have, for each prefix, a token that starts with it, where no word index is stored: one
    pass over the texts, which neither shuffles nor lists words. A text without the prefixes anywhere
    isn't split."""
    found = df
    for p in prefixes:
        found = found.where(F.col(column).contains(p))
    for p in prefixes:
        found = found.where(F.exists(splitter(F.col(column)), _starts(p)))
    return found


def _starts(prefix: str) -> Callable[[Column], Column]:
    return lambda token: token.startswith(prefix)


def fetch(df: DataFrame, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.join(rows, row_id, "left_semi")
