"""Comparison of a source with a stored table, and completeness of its indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.words import Splitter, tokens
from granary.operators.index import listed, word_rows


def compare(source: DataFrame, stored: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row: keys missing on either side and mismatches for each column, NULL-safe."""
    left = source.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a"))
    right = stored.select(*[F.col(k).alias(f"s_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    on = [F.col(f"k_{k}").eqNullSafe(F.col(f"s_{k}")) for k in keys]
    both = left.join(right, on, "full_outer")
    matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    bad = [F.count_if(matched & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"bad_{c}") for c in columns]
    return both.agg(F.count_if(F.col("_b").isNull()).alias("not_stored"), F.count_if(F.col("_a").isNull()).alias("not_in_source"), *bad)


def null_and_empty(source: DataFrame, stored: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(column_name, nulls, empties, lost_nulls, lost_empties)``: how many cells of the source are
    NULL or empty, and how many of these aren't the same in the stored table."""
    left = source.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"a_{c}") for c in columns])
    right = stored.select(*[F.col(k).alias(f"s_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    both = left.join(right, [F.col(f"k_{k}").eqNullSafe(F.col(f"s_{k}")) for k in keys], "left")
    parts, rows = [], []
    for i, c in enumerate(columns):
        null, empty = F.col(f"a_{c}").isNull(), F.coalesce(F.octet_length(F.col(f"a_{c}").cast("string")) == 0, F.lit(False))
        kept = F.col("_b").isNotNull() & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        parts += [F.count_if(null).alias(f"n{i}"), F.count_if(empty).alias(f"e{i}"), F.count_if(null & ~kept).alias(f"ln{i}"), F.count_if(empty & ~kept).alias(f"le{i}")]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls"), F.col(f"e{i}").alias("empties"), F.col(f"ln{i}").alias("lost_nulls"), F.col(f"le{i}").alias("lost_empties")))
    return both.agg(*parts).select(F.inline(F.array(*rows)))


def index_gaps(rows: DataFrame, index: DataFrame, keys: list[str], row_id: str = "row_id") -> DataFrame:
    """Pairs of value and row that are in one of the data and the index only; empty if whole. Both
    sides are read once and meet in one aggregation."""
    held = rows.select(*keys, F.col(row_id).cast("bigint").alias(row_id), F.lit(1).alias("_n"))
    said = listed(index, keys, row_id).withColumn("_n", F.lit(-1))
    found = held.unionByName(said).groupBy(*keys, row_id).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return found.withColumn("side", F.when(F.col("_n") > 0, "data").otherwise("index")).drop("_n")


def word_gaps(df: DataFrame, column: str, postings: DataFrame, row_id: str = "row_id", splitter: Splitter = tokens) -> DataFrame:
    """Words and rows that are in one of the data and the postings of its words only; empty if whole."""
    return index_gaps(word_rows(df, column, row_id, splitter), postings, ["word"], row_id).select("word", row_id)
