"""Column encodings as reversible transforms over rows with ids; a block is 64 row ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalar import decimal_scale, power_of_ten, scaled_integer
from granary.functions.words import Splitter, join_tokens, tokens
from granary.operators.rowid import block_of, with_row_id


def _block_order() -> Window:
    return Window.partitionBy("block").orderBy("row_id")


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """``(value, freq, code)``: codes from 0 by falling frequency, then value."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("freq")).withColumn("_order", -F.col("freq"))
    return with_row_id(counted, ["_order", "value"], "code").select("value", "freq", "code")


def dictionary_encode(df: DataFrame, column: str, codes: DataFrame | None = None) -> DataFrame:
    codes = dictionary(df, column) if codes is None else codes
    return df.join(codes.select(F.col("value").alias("_value"), "code"), F.col(column).eqNullSafe(F.col("_value"))).drop("_value", column)


def dictionary_decode(encoded: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    return encoded.join(codes.select("code", F.col("value").alias(column)), "code").drop("code")


def delta(df: DataFrame, column: str) -> DataFrame:
    """First value of a block as it is, then differences."""
    rows = df.select("row_id", column, block_of(F.col("row_id")).alias("block"))
    before = F.lag(column).over(_block_order())
    return rows.select("row_id", "block", (F.col(column) - F.coalesce(before, F.lit(0))).alias("delta"))


def delta_decode(encoded: DataFrame, column: str) -> DataFrame:
    return encoded.select("row_id", F.sum("delta").over(_block_order()).alias(column))


def runs(df: DataFrame, column: str) -> DataFrame:
    """Runs of equal neighbours within a block: ``(block, row_start, run_length, value)``."""
    rows = df.select("row_id", column, block_of(F.col("row_id")).alias("block"))
    changed = (~F.col(column).eqNullSafe(F.lag(column).over(_block_order())) | (F.row_number().over(_block_order()) == 1)).cast("int")
    run = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(_block_order()))
    return run.groupBy("block", "_run", F.col(column).alias("value")).agg(F.min("row_id").alias("row_start"), F.count(F.lit(1)).alias("run_length")).drop("_run")


def runs_decode(encoded: DataFrame, column: str) -> DataFrame:
    ids = F.sequence(F.col("row_start"), F.col("row_start") + F.col("run_length") - 1)
    return encoded.select(F.explode(ids).alias("row_id"), F.col("value").alias(column))


def repeat_share(df: DataFrame, column: str) -> DataFrame:
    """Share of rows equal to the row before in their block; run-length coding pays above 0.4."""
    n = runs(df, column).agg(F.sum("run_length").alias("n_rows"), F.count(F.lit(1)).alias("n_runs"))
    return n.select("n_rows", "n_runs", ((F.col("n_rows") - F.col("n_runs")) / F.col("n_rows")).alias("share"))


def frame_of_reference(df: DataFrame, column: str) -> DataFrame:
    """Values less the least of their block, and the block's base."""
    rows = df.select("row_id", column, block_of(F.col("row_id")).alias("block"))
    base = F.min(column).over(Window.partitionBy("block"))
    return rows.select("row_id", "block", base.alias("base"), (F.col(column) - base).alias("offset"))


def frame_decode(encoded: DataFrame, column: str) -> DataFrame:
    return encoded.select("row_id", (F.col("base") + F.col("offset")).alias(column))


def block_sums(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(block_of(F.col("row_id")).alias("block")).agg(F.sum(column).alias("total"), F.count(column).alias("n"))


def decimal_blocks(df: DataFrame, column: str) -> DataFrame:
    """``(row_id, block, places, scaled, raw)``: doubles as integers at the largest number of decimal
    places in their block; values that this doesn't give back exactly are exceptions and stay raw."""
    rows = df.select("row_id", F.col(column).alias("_v"), block_of(F.col("row_id")).alias("block"))
    own = decimal_scale(F.col("_v"))
    usable = F.when(scaled_integer(F.col("_v"), own).isNotNull(), own)
    placed = rows.withColumn("_own", usable).withColumn("places", F.coalesce(F.max("_own").over(Window.partitionBy("block")), F.lit(0)))
    scaled = placed.withColumn("scaled", scaled_integer(F.col("_v"), F.col("places")))
    return scaled.select("row_id", "block", "places", "scaled", F.when(F.col("scaled").isNull(), F.col("_v")).alias("raw"))


def decimal_blocks_decode(encoded: DataFrame, column: str) -> DataFrame:
    return encoded.select("row_id", F.coalesce(F.col("scaled") / power_of_ten(F.col("places")), "raw").alias(column))


def word_dictionary(df: DataFrame, column: str, splitter: Splitter = tokens) -> DataFrame:
    """``(value, freq, code)`` of the tokens of a column."""
    return dictionary(df.select(F.explode(splitter(F.col(column))).alias("token")), "token")


def word_encode(df: DataFrame, column: str, codes: DataFrame, splitter: Splitter = tokens) -> DataFrame:
    """``(row_id, refs)``: each row as the codes of its tokens in order; a NULL text has NULL."""
    parts = df.select("row_id", splitter(F.col(column)).alias("_parts"))
    at = parts.select("row_id", F.posexplode("_parts").alias("_pos", "_token"))
    coded = at.join(codes.select(F.col("value").alias("_token"), "code"), "_token")
    found = coded.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("_pos", "code"))).alias("_refs"))
    joined = parts.select("row_id", F.size("_parts").alias("_size")).join(found, "row_id", "left")
    refs = F.when(F.col("_size") > 0, F.transform("_refs", lambda r: r["code"])).when(F.col("_size") == 0, F.array().cast("array<bigint>"))
    return joined.select("row_id", refs.alias("refs"))


def word_decode(encoded: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    at = encoded.select("row_id", F.posexplode("refs").alias("_pos", "code"))
    found = at.join(codes.select("code", "value"), "code").groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("_pos", "value"))).alias("_parts"))
    whole = join_tokens(F.transform("_parts", lambda r: r["value"]))
    joined = encoded.join(found, "row_id", "left")
    return joined.select("row_id", F.when(F.size("refs") > 0, whole).when(F.size("refs") == 0, "").alias(column))


def raw_store(value: Column) -> Column:
    """A text or binary value as its length in four bytes, most significant first, and its bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 8, "0")), value.cast("binary"))


def raw_load(stored: Column) -> Column:
    size = F.conv(F.hex(F.substring(stored, 1, 4)), 16, 10).cast("int")
    return F.substring(stored, F.lit(5), size)
