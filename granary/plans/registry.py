"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import keys, scalar, words
from granary.operators import access, encode, index, stats, verify
from granary.operators.rowid import block_of, with_row_id
from granary.session import shared_dir, stage
from granary.sources import sinks
from granary.streaming import import_stream, typed_stream
from granary.types import format_datetime, parse_datetime, stored_integer, truncate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
W = r"A-Za-z0-9\x{80}-\x{10FFFF}"
TOKENS = rf"regexp_extract_all(text, '^[^{W}]+|[{W}]+[^{W}]*', 0)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str, name: str, keys: list[str], columns: list[str]) -> DataFrame:
    return with_row_id(table(spark, sf_dir, name).select(*dict.fromkeys([*keys, *columns])), keys)


# Key access


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def pk_point_lookup(spark, d):
    return access.lookup(table(spark, d, "orders"), {"o_orderkey": 42}, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT o_custkey FROM orders WHERE o_orderkey = 7")
def pk_get_value(spark, d):
    orders = table(spark, d, "orders")
    return access.lookup(orders, {"o_orderkey": 7}, [orders.columns[1]])


@query("""SELECT k.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderkey IS NOT NULL AS found
FROM (SELECT DISTINCT l_orderkey * 2 AS o_orderkey FROM lineitem) k LEFT JOIN orders o USING (o_orderkey)""")
def pk_batch_lookup(spark, d):
    keys = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("o_orderkey")).distinct()
    return access.batch_lookup(table(spark, d, "orders"), keys, ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@query("""SELECT DISTINCT l_orderkey * 2 AS o_orderkey FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey * 2)""")
def pk_missing_keys(spark, d):
    keys = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("o_orderkey")).distinct()
    return access.missing_keys(table(spark, d, "orders"), keys, ["o_orderkey"])


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1")
def composite_pk_lookup(spark, d):
    return access.lookup(table(spark, d, "conversations"), {"conv_id": 3, "turn": 1}, ["conv_id", "turn", "role", "text"])


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 4")
def composite_pk_prefix(spark, d):
    return access.lookup(table(spark, d, "conversations"), {"conv_id": 4}, ["conv_id", "turn", "role"])


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def pk_prefix_scan(spark, d):
    return access.prefix_scan(table(spark, d, "customer"), "c_name", "Customer#00000001").select("c_custkey", "c_name")


@query("SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS position FROM (SELECT DISTINCT p_name FROM part)")
def ordered_iteration(spark, d):
    return access.ordered(table(spark, d, "part"), ["p_name"])


@query("""WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer)
SELECT c_custkey, position, c_custkey AS back FROM n""")
def rank_and_reverse(spark, d):
    keys = stage(access.ordered(table(spark, d, "customer"), ["c_custkey"]), "rank")
    back = keys.select("position", F.col("c_custkey").alias("back"))
    return table(spark, d, "customer").select("c_custkey").join(keys, "c_custkey").join(back, "position").select("c_custkey", "position", "back")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id, role FROM conversations")
def composite_row_ids(spark, d):
    return numbered(spark, d, "conversations", ["conv_id", "turn"], ["role"])


@query("""SELECT conv_id, turn, '018' || printf('%015X', conv_id) || '018' || printf('%015X', turn) || '01' || hex(role) || '0000' AS key_digits, turn AS turn_back, role AS role_back FROM conversations""")
def composite_key_bytes(spark, d):
    """Keys whose bytes sort as their parts do, and parts read back from them."""
    key = keys.key_bytes([(F.col("conv_id"), "i"), (F.col("turn"), "i"), (F.col("role"), "t")])
    rows = table(spark, d, "conversations").select("conv_id", "turn", key.alias("key"))
    return rows.select("conv_id", "turn", F.hex("key").alias("key_digits"), keys.key_part(F.col("key"), "iit", 1).alias("turn_back"), keys.key_part(F.col("key"), "iit", 2).alias("role_back"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id DESC, turn) - 1 AS position FROM conversations")
def integer_key_order(spark, d):
    """Positions by the bytes of a key with a negative integer in front."""
    key = keys.key_bytes([(-F.col("conv_id"), "i"), (F.col("turn"), "i")])
    return with_row_id(table(spark, d, "conversations").select("conv_id", "turn", key.alias("key")), ["key"], "position").drop("key")


@query("SELECT event_id, row_number() OVER (ORDER BY value - 30, ts, event_id) - 1 AS position, value - 30 AS value_back, ts AS ts_back, CAST(ts AS DATE) AS day_back FROM events")
def composite_key_mixed(spark, d):
    """Positions by the bytes of a key of a double with either sign, a time, a date and an integer, and its parts."""
    parts = [(F.col("value") - 30, "."), (F.col("ts"), "e"), (F.col("ts").cast("date"), "b"), (F.col("event_id"), "i")]
    found = with_row_id(table(spark, d, "events").select("event_id", keys.key_bytes(parts).alias("key")), ["key"], "position")
    back = [keys.key_part(F.col("key"), ".ebi", i).alias(n) for i, n in enumerate(("value_back", "ts_back", "day_back"))]
    return found.select("event_id", "position", *back)


@query("SELECT count(*) AS row_count, count(DISTINCT c_custkey) AS key_count, max(strlen(c_name)) AS max_c_name_len FROM customer")
def key_counts(spark, d):
    return access.table_counts(table(spark, d, "customer"), ["c_custkey"], ["c_name"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def set_insert(spark, d):
    return access.insert_keys(table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


@query("SELECT o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders) WHERE row_id = 100")
def cell_by_row_id(spark, d):
    return numbered(spark, d, "orders", ["o_orderkey"], ["o_custkey", "o_orderstatus"]).where("row_id = 100").select("o_custkey", "o_orderstatus")


@query("SELECT row_id, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders) WHERE row_id >= 500")
def scan_from_row(spark, d):
    return numbered(spark, d, "orders", ["o_orderkey"], ["o_totalprice"]).where("row_id >= 500").select("row_id", "o_totalprice")


# Projection, limits, sums, statistics


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def project_exclude(spark, d):
    return table(spark, d, "orders").drop("o_orderpriority")


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM lineitem")
def key_columns_first(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def row_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query("SELECT CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem")
def sum_int(spark, d):
    return table(spark, d, "lineitem").agg(F.sum("l_partkey").alias("total"))


@query("SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def sum_double(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT CAST(sum(strlen(text)) AS BIGINT) AS total FROM documents")
def sum_text_len(spark, d):
    return table(spark, d, "documents").agg(F.sum(scalar.byte_length(F.col("text"))).cast("bigint").alias("total"))


@query("""SELECT CAST(sum(o_custkey) AS BIGINT) AS o_custkey, round(sum(o_totalprice), 2) AS o_totalprice,
CAST(sum(strlen(o_orderpriority)) AS BIGINT) AS o_orderpriority FROM orders""")
def column_totals(spark, d):
    return stats.totals(table(spark, d, "orders"), ["o_custkey", "o_totalprice", "o_orderpriority"])


@query("""SELECT 'c_custkey' AS column_name, count(*) - count(c_custkey) AS null_count, min(c_custkey) AS min_int, max(c_custkey) AS max_int, NULL::DOUBLE AS min_double, NULL::DOUBLE AS max_double, max(strlen(c_custkey::VARCHAR)) AS max_len FROM customer
UNION ALL SELECT 'c_name', count(*) - count(c_name), min(strlen(c_name)), max(strlen(c_name)), NULL, NULL, max(strlen(c_name)) FROM customer
UNION ALL SELECT 'c_nationkey', count(*) - count(c_nationkey), min(c_nationkey), max(c_nationkey), NULL, NULL, max(strlen(c_nationkey::VARCHAR)) FROM customer
UNION ALL SELECT 'half', 0, NULL, NULL, min(c_custkey / 2), max(c_custkey / 2), max(strlen((c_custkey / 2)::VARCHAR)) FROM customer""")
def column_stats(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", (F.col("c_custkey") / 2).alias("half"))
    return stats.column_stats(rows)


@query("""SELECT 'big' AS column_name, 0::BIGINT AS null_count, min(9007199254740993 + o_orderkey) AS min_int, max(9007199254740993 + o_orderkey) AS max_int, NULL::DOUBLE AS min_double, NULL::DOUBLE AS max_double, 16::BIGINT AS max_len FROM orders""")
def stats_of_large_integers(spark, d):
    """Integers that doubles can't tell apart."""
    return stats.column_stats(table(spark, d, "orders").select((F.col("o_orderkey") + 9007199254740993).alias("big")))


@query("SELECT min(c_acctbal) AS min_value, max(c_acctbal) AS max_value, count(*) - count(c_acctbal) AS null_count FROM customer")
def double_stats(spark, d):
    return table(spark, d, "customer").agg(F.min("c_acctbal").alias("min_value"), F.max("c_acctbal").alias("max_value"), F.count_if(F.col("c_acctbal").isNull()).alias("null_count"))


@query("SELECT bool_and(o_custkey BETWEEN -2147483648 AND 2147483647) AS all_32_bit FROM orders")
def fits_32_bits(spark, d):
    return stats.fits_32_bits(table(spark, d, "orders"), "o_custkey")


@query("SELECT max(strlen(text)) AS max_len FROM documents")
def max_value_length(spark, d):
    return table(spark, d, "documents").agg(F.max(scalar.byte_length(F.col("text"))).cast("bigint").alias("max_len"))


PLANTED = "(SELECT event_id, nullif(event_type, 'error') AS event_type, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 5 = 1 THEN NULL ELSE props END AS props FROM events)"


def planted(spark, d):
    """Events with NULLs and empty texts, which the tables have none of."""
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    value = F.when(F.col("user_id") % 7 != 0, F.col("value"))
    props = F.when(F.col("user_id") % 5 == 0, "").when(F.col("user_id") % 5 != 1, F.col("props"))
    return table(spark, d, "events").select("event_id", kind.alias("event_type"), value.alias("value"), props.alias("props"))


@query(f"SELECT event_id, event_type, value FROM {PLANTED} WHERE event_type IS NULL OR value IS NULL")
def null_rows(spark, d):
    return planted(spark, d).where(F.col("event_type").isNull() | F.col("value").isNull()).select("event_id", "event_type", "value")


@query(f"""SELECT 'event_type' AS column_name, count(*) FILTER (event_type IS NULL) AS nulls, 0::BIGINT AS empties, 0::BIGINT AS lost_nulls, 0::BIGINT AS lost_empties FROM {PLANTED}
UNION ALL SELECT 'value', count(*) FILTER (value IS NULL), 0, 0, 0 FROM {PLANTED}
UNION ALL SELECT 'props', count(*) FILTER (props IS NULL), count(*) FILTER (props = ''), 0, 0 FROM {PLANTED}""")
def verify_null_and_empty(spark, d):
    """NULL and empty cells that come back from a stored table as they were."""
    rows = planted(spark, d)
    return verify.null_and_empty(rows, stage(rows, "nulls"), ["event_id"], ["event_type", "value", "props"])


@query(f"""SELECT 'props' AS column_name, count(*) FILTER (props IS NULL) AS nulls, count(*) FILTER (props = '') AS empties, count(*) FILTER (props IS NULL) AS lost_nulls, 0::BIGINT AS lost_empties FROM {PLANTED}""")
def verify_finds_lost_nulls(spark, d):
    """A store that makes empty texts of NULLs."""
    rows = planted(spark, d)
    return verify.null_and_empty(rows, rows.withColumn("props", F.coalesce("props", F.lit(""))), ["event_id"], ["props"])


@query("SELECT p_brand, count(DISTINCT p_type) AS n_types FROM part GROUP BY p_brand")
def distinct_per_group(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("n_types"))


# Encodings

ORDERS_ROWS = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)"


@query(f"""SELECT row_id // 64 AS block, CAST(sum(o_custkey) AS BIGINT) AS total, count(*) AS n FROM {ORDERS_ROWS} GROUP BY 1""")
def block_decode_sum(spark, d):
    return encode.block_sums(numbered(spark, d, "orders", ["o_orderkey"], ["o_custkey"]), "o_custkey")


@query("SELECT p_type AS value, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS code FROM part GROUP BY p_type")
def dict_frequency(spark, d):
    return encode.dictionary(table(spark, d, "part"), "p_type")


@query("""SELECT p_partkey, code FROM part JOIN (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS code FROM part GROUP BY p_type) USING (p_type)""")
def dict_encode(spark, d):
    return encode.dictionary_encode(table(spark, d, "part").select("p_partkey", "p_type"), "p_type")


@query("SELECT p_partkey, p_type FROM part")
def dict_roundtrip(spark, d):
    codes = stage(encode.dictionary(table(spark, d, "part"), "p_type"), "codes")
    return encode.dictionary_decode(encode.dictionary_encode(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", codes), codes, "p_type")


@query(f"""SELECT row_id, row_id // 64 AS block, o_custkey - coalesce(lag(o_custkey) OVER (PARTITION BY row_id // 64 ORDER BY row_id), 0) AS delta FROM {ORDERS_ROWS}""")
def delta_block(spark, d):
    return encode.delta(numbered(spark, d, "orders", ["o_orderkey"], ["o_custkey"]), "o_custkey")


@query(f"SELECT row_id, o_custkey FROM {ORDERS_ROWS}")
def delta_roundtrip(spark, d):
    return encode.delta_decode(encode.delta(numbered(spark, d, "orders", ["o_orderkey"], ["o_custkey"]), "o_custkey"), "o_custkey")


RUNS = f"""(SELECT *, sum(new) OVER (PARTITION BY block ORDER BY row_id) AS run FROM (SELECT row_id, row_id // 64 AS block, o_orderstatus,
CASE WHEN lag(o_orderstatus) OVER (PARTITION BY row_id // 64 ORDER BY row_id) = o_orderstatus THEN 0 ELSE 1 END AS new FROM {ORDERS_ROWS}))"""


@query(f"SELECT block, o_orderstatus AS value, min(row_id) AS row_start, count(*) AS run_length FROM {RUNS} GROUP BY block, run, o_orderstatus")
def rle_runs(spark, d):
    return encode.runs(numbered(spark, d, "orders", ["o_orderkey"], ["o_orderstatus"]), "o_orderstatus")


@query(f"SELECT row_id, o_orderstatus FROM {ORDERS_ROWS}")
def rle_roundtrip(spark, d):
    return encode.runs_decode(encode.runs(numbered(spark, d, "orders", ["o_orderkey"], ["o_orderstatus"]), "o_orderstatus"), "o_orderstatus")


@query(f"SELECT count(*) AS n_rows, CAST(sum(new) AS BIGINT) AS n_runs, (count(*) - sum(new)) / count(*) AS share FROM {RUNS}")
def repeat_share(spark, d):
    return encode.repeat_share(numbered(spark, d, "orders", ["o_orderkey"], ["o_orderstatus"]), "o_orderstatus")


@query(f"""SELECT row_id, row_id // 64 AS block, min(o_custkey) OVER (PARTITION BY row_id // 64) AS base, o_custkey - min(o_custkey) OVER (PARTITION BY row_id // 64) AS "offset" FROM {ORDERS_ROWS}""")
def for_block(spark, d):
    return encode.frame_of_reference(numbered(spark, d, "orders", ["o_orderkey"], ["o_custkey"]), "o_custkey")


@query(f"SELECT row_id, o_custkey FROM {ORDERS_ROWS}")
def for_roundtrip(spark, d):
    return encode.frame_decode(encode.frame_of_reference(numbered(spark, d, "orders", ["o_orderkey"], ["o_custkey"]), "o_custkey"), "o_custkey")


@query("""SELECT p_partkey, trunc(p_retailprice * 10) / 10 AS d1, trunc(p_retailprice) AS d0 FROM part""")
def truncate_decimals(spark, d):
    return table(spark, d, "part").select("p_partkey", truncate(F.col("p_retailprice"), 1).alias("d1"), truncate(F.col("p_retailprice"), 0).alias("d0"))


@query("SELECT c_custkey, trunc(c_acctbal * 10) / 10 AS cut FROM customer WHERE c_acctbal < 0")
def truncate_negative(spark, d):
    return table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", truncate(F.col("c_acctbal"), 1).alias("cut"))


@query("""SELECT o_orderkey, (o_custkey - 500) * 2 * (CASE WHEN o_custkey < 500 THEN -1 ELSE 1 END) - (CASE WHEN o_custkey < 500 THEN 1 ELSE 0 END) AS folded, o_custkey - 500 AS back FROM orders""")
def zigzag_fold(spark, d):
    value = F.col("o_custkey") - 500
    return table(spark, d, "orders").select("o_orderkey", scalar.zigzag(value).alias("folded"), scalar.unzigzag(scalar.zigzag(value)).alias("back"))


@query("SELECT o_orderkey, CAST(greatest(1, length(ltrim(bin(o_custkey), '0'))) AS INTEGER) AS bits, CAST(ceil(greatest(1, length(ltrim(bin(o_custkey), '0'))) / 8) AS INTEGER) AS bytes FROM orders")
def code_width(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalar.bits_needed(F.col("o_custkey")).alias("bits"), scalar.bytes_needed(F.col("o_custkey")).alias("bytes"))


@query("""SELECT c_custkey, CAST(length(regexp_extract(rtrim(CAST(abs(c_acctbal) AS VARCHAR), '0'), '\\.(\\d*)$', 1)) AS INTEGER) AS decimals FROM customer""")
def decimal_scale(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.decimal_scale(F.col("c_acctbal")).alias("decimals"))


SCALES = """(SELECT *, trunc(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 10 END) / CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 10 END + CASE WHEN o_orderkey % 50 = 0 THEN 1e18 ELSE 0 END AS v FROM orders)"""
DIGITS = "CASE WHEN v < 1e15 THEN length(regexp_extract(rtrim(CAST(v AS VARCHAR), '0'), '\\.(\\d*)$', 1)) END"


def scaled_prices(spark, d):
    """Prices with no or one decimal, and some too large to be scaled."""
    some = F.col("o_orderkey") % 3 == 0
    cut = F.when(some, truncate(F.col("o_totalprice"), 0)).otherwise(truncate(F.col("o_totalprice"), 1))
    return with_row_id(table(spark, d, "orders").select("o_orderkey", (cut + F.when(F.col("o_orderkey") % 50 == 0, 1e18).otherwise(0.0)).alias("v")), ["o_orderkey"])


@query(f"""WITH r AS (SELECT row_id, row_id // 64 AS block, v, coalesce(max(places) OVER (PARTITION BY row_id // 64), 0) AS places FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, v, {DIGITS} AS places FROM {SCALES}))
SELECT row_id, block, places::INTEGER AS places, CASE WHEN v < 1e15 THEN CAST(round(v * 10 ** places) AS BIGINT) END AS scaled, CASE WHEN v >= 1e15 THEN v END AS raw FROM r""")
def decimal_blocks(spark, d):
    return encode.decimal_blocks(scaled_prices(spark, d), "v")


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, v FROM {SCALES}")
def decimal_blocks_roundtrip(spark, d):
    return encode.decimal_blocks_decode(encode.decimal_blocks(scaled_prices(spark, d), "v"), "v")


@query("SELECT p_partkey, printf('%08X', strlen(p_name)) || hex(p_name) AS stored, p_name AS back FROM part")
def raw_store(spark, d):
    stored = encode.raw_store(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.hex(stored).alias("stored"), encode.raw_load(stored).cast("string").alias("back"))


# Dates and scalars


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS days FROM orders")
def epoch_days(spark, d):
    return table(spark, d, "orders").select("o_orderkey", stored_integer(F.col("o_orderdate"), "b").alias("days"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS seconds FROM events")
def epoch_seconds(spark, d):
    return table(spark, d, "events").select("event_id", stored_integer(F.col("ts"), "e").alias("seconds"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def epoch_millis(spark, d):
    return table(spark, d, "events").select("event_id", stored_integer(F.col("ts"), "h").alias("millis"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS eur, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""")
def date_format(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", format_datetime(day, "`").alias("us"), format_datetime(day, "d").alias("eur"), format_datetime(day, "b").alias("iso"))


@query("SELECT event_id, date_trunc('second', ts) AS back FROM events")
def date_roundtrip(spark, d):
    text = format_datetime(F.col("ts"), "f")
    return table(spark, d, "events").select("event_id", parse_datetime(text, "f").alias("back"))


@query("SELECT event_id, date_trunc('minute', ts) AS back FROM events")
def date_us_roundtrip(spark, d):
    return table(spark, d, "events").select("event_id", parse_datetime(format_datetime(F.col("ts"), "c"), "c").alias("back"))


@query("SELECT event_id, date_trunc('millisecond', ts) AS back FROM events")
def date_millis_roundtrip(spark, d):
    return table(spark, d, "events").select("event_id", parse_datetime(format_datetime(F.col("ts"), "h"), "h").alias("back"))


@query("SELECT c_custkey, strlen(c_name) AS n_bytes, CAST(list_sum(list_transform(string_split(c_name, ''), lambda x: ascii(x))) AS BIGINT) AS chksum FROM customer")
def key_checksum(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.byte_length(F.col("c_name")).cast("bigint").alias("n_bytes"), scalar.byte_checksum(F.col("c_name")).alias("chksum"))


@query("SELECT p_partkey, p_name, reverse(p_name) AS backwards FROM part ORDER BY p_name, p_partkey")
def byte_order(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", F.reverse("p_name").alias("backwards")).orderBy("p_name", "p_partkey")


# Two-way and composite indexes

PART_ROWS = "(SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part)"


def islands(keys: str, source: str) -> str:
    return f"""SELECT {keys}, min(row_id) AS row_start, max(row_id) AS row_end FROM (SELECT {keys}, row_id, row_id - row_number() OVER (PARTITION BY {keys} ORDER BY row_id) AS g FROM {source}) GROUP BY {keys}, g"""


def part_rows(spark, d):
    return numbered(spark, d, "part", ["p_partkey"], ["p_brand", "p_type", "p_size"])


@query(islands("p_brand", PART_ROWS))
def twoway_postings(spark, d):
    return index.postings(part_rows(spark, d), ["p_brand"])


@query(islands("o_orderstatus", "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)"))
def twoway_postings_sliced(spark, d):
    """Postings of frequent values over many slices of row ids."""
    return index.postings(numbered(spark, d, "orders", ["o_orderkey"], ["o_orderstatus"]), ["o_orderstatus"], slice_rows=256)


@query(f"SELECT p_size, row_id, CASE WHEN p_size = 7 THEN 'data' ELSE 'index' END AS side FROM (SELECT p_size, row_id FROM {PART_ROWS} WHERE p_size = 7 UNION ALL SELECT 99, 5)")
def index_gaps_found(spark, d):
    """An index that lacks a value and has one too many."""
    rows = part_rows(spark, d)
    extra = spark.createDataFrame([(99, 5, 5)], "p_size int, row_start bigint, row_end bigint")
    return verify.index_gaps(rows, index.postings(rows, ["p_size"]).where("p_size <> 7").unionByName(extra), ["p_size"])


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def twoway_lookup(spark, d):
    rows = part_rows(spark, d)
    least = table(spark, d, "part").agg(F.min("p_brand").alias("p_brand"))
    hits = index.expand(index.postings(rows, ["p_brand"]).join(least, "p_brand", "left_semi"))
    return index.fetch(rows, hits).select("p_partkey", "p_brand")


@query(f"SELECT DISTINCT row_id FROM {PART_ROWS} WHERE starts_with(p_brand, 'Brand#1')")
def twoway_prefix(spark, d):
    return index.expand(index.postings(part_rows(spark, d), ["p_brand"]).where(F.col("p_brand").startswith("Brand#1")))


@query(islands("p_brand, p_type", PART_ROWS))
def secondary_composite(spark, d):
    return index.postings(part_rows(spark, d), ["p_brand", "p_type"])


@query(f"SELECT p_size, row_id, 'data' AS side FROM {PART_ROWS} WHERE 1 = 0")
def index_equals_scan(spark, d):
    rows = part_rows(spark, d)
    return verify.index_gaps(rows, index.postings(rows, ["p_size"]), ["p_size"])


@query(f"SELECT DISTINCT p_brand, row_id >> 3 AS block FROM {PART_ROWS}")
def block_granular_index(spark, d):
    return index.coarse(part_rows(spark, d), ["p_brand"], 3)


@query("SELECT p_type, count(*) AS n_rows FROM part GROUP BY p_type")
def rows_per_value(spark, d):
    return index.rows_per_value(table(spark, d, "part"), ["p_type"])


@query("SELECT DISTINCT p_type FROM part ORDER BY p_type")
def values_in_order(spark, d):
    return index.values_in_order(table(spark, d, "part"), ["p_type"])


# Words


@query(f"SELECT doc_id, len(t) AS n_tokens, list_aggregate(t, 'string_agg', '') = text AS whole FROM (SELECT doc_id, text, {TOKENS} AS t FROM documents)")
def word_tokens(spark, d):
    parts = words.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(parts).cast("bigint").alias("n_tokens"), (words.join_tokens(parts) == F.col("text")).alias("whole"))


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({TOKENS}) AS word FROM documents) GROUP BY word")
def word_frequency(spark, d):
    return table(spark, d, "documents").select(F.explode(words.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


@query(islands("word", f"(SELECT DISTINCT doc_id AS row_id, unnest({TOKENS}) AS word FROM documents)"))
def word_postings(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return index.postings(index.word_rows(docs, "text"), ["word"])


@query(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) WHERE starts_with(word, 'the')")
def word_prefix_search(spark, d):
    return index.rows_with_words(table(spark, d, "documents"), "text", ["the"]).select("doc_id")


@query(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) WHERE starts_with(word, 'the')")
def word_prefix_search_by_index(spark, d):
    """The same by the ranges of a stored word index."""
    docs = table(spark, d, "documents")
    built = stage(index.postings(index.word_rows(docs, "text", "doc_id"), ["word"], "doc_id"), "word-index")
    return index.expand(built.where(F.col("word").startswith("the")), "doc_id")


@query(f"""SELECT doc_id FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) GROUP BY doc_id
HAVING bool_or(starts_with(word, 'the')) AND bool_or(starts_with(word, 'of')) AND bool_or(starts_with(word, 'on'))""")
def multi_word_search(spark, d):
    return index.rows_with_words(table(spark, d, "documents"), "text", ["the", "of", "on"]).select("doc_id")


@query(f"""SELECT doc_id FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) GROUP BY doc_id
HAVING bool_or(starts_with(word, 'the')) AND bool_or(starts_with(word, 'of')) AND bool_or(starts_with(word, 'on'))""")
def multi_word_search_by_words(spark, d):
    """The same over listed words, which an index or a stream of words gives."""
    return index.all_words_rows(index.word_rows(table(spark, d, "documents"), "text", "doc_id"), ["the", "of", "on"], "doc_id")


@query(f"""SELECT doc_id, len(t) AS word_count, m AS max_word_len, list_position(list_transform(t, lambda x: strlen(x)), m) - 1 AS max_word_pos
FROM (SELECT doc_id, t, list_max(list_transform(t, lambda x: strlen(x))) AS m FROM (SELECT doc_id, {TOKENS} AS t FROM documents))""")
def longest_word(spark, d):
    found = table(spark, d, "documents").select("doc_id", words.longest_token(words.tokens(F.col("text"))).alias("w"))
    return found.select("doc_id", *[F.col(f"w.{c}").cast("bigint").alias(c) for c in ("word_count", "max_word_len", "max_word_pos")])


@query("SELECT '' AS word, doc_id FROM documents WHERE 1 = 0")
def word_index_gaps(spark, d):
    docs = table(spark, d, "documents")
    built = stage(index.postings(index.word_rows(docs, "text", "doc_id"), ["word"], "doc_id"), "word-index")
    return verify.word_gaps(docs, "text", built, "doc_id")


@query(f"""SELECT DISTINCT word, doc_id FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) WHERE starts_with(word, 'an')""")
def word_index_gaps_found(spark, d):
    """A word index without the words that start with two letters."""
    docs = table(spark, d, "documents")
    built = stage(index.postings(index.word_rows(docs, "text", "doc_id"), ["word"], "doc_id").where(~F.col("word").startswith("an")), "word-index")
    return verify.word_gaps(docs, "text", built, "doc_id")


WORD_CODES = f"(SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS code FROM (SELECT unnest({TOKENS}) AS word FROM documents) GROUP BY word)"


def word_rows_and_codes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return docs, stage(encode.word_dictionary(docs, "text"), "word-codes")


@query(f"""SELECT doc_id AS row_id, string_agg(code::VARCHAR, ',' ORDER BY pos) AS refs FROM (SELECT doc_id, unnest({TOKENS}) AS word, generate_subscripts({TOKENS}, 1) AS pos FROM documents) JOIN {WORD_CODES} USING (word) GROUP BY doc_id""")
def word_refs(spark, d):
    """Texts as the codes of their tokens, in order."""
    docs, codes = word_rows_and_codes(spark, d)
    return encode.word_encode(docs, "text", codes).select("row_id", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"))


@query("SELECT doc_id AS row_id, text FROM documents")
def word_refs_roundtrip(spark, d):
    docs, codes = word_rows_and_codes(spark, d)
    return encode.word_decode(stage(encode.word_encode(docs, "text", codes), "word-refs"), codes, "text")


# Verification


@query("SELECT 0::BIGINT AS not_stored, 0::BIGINT AS not_in_source, 0::BIGINT AS bad_o_custkey, 0::BIGINT AS bad_o_totalprice, 0::BIGINT AS bad_o_orderdate")
def verify_mismatches(spark, d):
    columns = ["o_custkey", "o_totalprice", "o_orderdate"]
    orders = table(spark, d, "orders").select("o_orderkey", *columns)
    return verify.compare(orders, stage(orders, "stored"), ["o_orderkey"], columns)


@query("""SELECT count(*) FILTER (o_orderkey % 10 = 0) AS not_stored, 0::BIGINT AS not_in_source, count(*) FILTER (o_orderkey % 10 <> 0 AND o_custkey % 5 = 0) AS bad_o_custkey FROM orders""")
def verify_finds_changes(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    changed = orders.where("o_orderkey % 10 <> 0").withColumn("o_custkey", F.when(F.col("o_custkey") % 5 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")))
    return verify.compare(orders, changed, ["o_orderkey"], ["o_custkey"])


# What a host engine gives: SQL over the tables


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def delegated_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey")
def delegated_full_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "full_outer").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def delegated_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def delegated_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT e.event_id, max(p.event_id) AS before_id FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts AND p.ts >= (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts < e.ts) GROUP BY e.event_id")
def delegated_asof(spark, d):
    """The last purchase of the user before each event, by one sort within users."""
    before = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    instants = events.groupBy("user_id", "ts").agg(F.max(bought).alias("_at"), F.collect_list("event_id").alias("_ids"))
    shifted = instants.withColumn("_prev", F.lag("_at").over(Window.partitionBy("user_id").orderBy("ts")))
    found = shifted.withColumn("_last", F.max("_prev").over(before))
    return found.select(F.explode("_ids").alias("event_id"), F.col("_last.event_id").alias("before_id"))


@query("SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN part p ON p.p_retailprice BETWEEN s.s_acctbal AND s.s_acctbal + 50 GROUP BY s.s_suppkey")
def delegated_range_join(spark, d):
    """Overlapping buckets as wide as the range make it an equi-join."""
    width = 50.0
    part = table(spark, d, "part").select("p_retailprice", F.floor(F.col("p_retailprice") / width).alias("b"))
    low = F.floor(F.col("s_acctbal") / width)
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.array(low, low + 1)).alias("b"))
    hit = F.col("p_retailprice").between(F.col("s_acctbal"), F.col("s_acctbal") + width)
    return supplier.join(part, "b").where(hit).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def delegated_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def delegated_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type))")
def delegated_grouping_sets(spark, d):
    table(spark, d, "part").createOrReplaceTempView("granary_part")
    return spark.sql("SELECT p_brand, p_type, count(*) AS n FROM granary_part GROUP BY GROUPING SETS ((p_brand), (p_type))")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def delegated_group_by(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def delegated_window(spark, d):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", place.alias("place")).where("place <= 3")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def delegated_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def delegated_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def delegated_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 10")
def delegated_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_quantity > 10").select("l_partkey"))


@query("SELECT o_orderpriority, upper(o_orderstatus) AS status, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def delegated_scalar_having(spark, d):
    keys = ["o_orderpriority", F.upper("o_orderstatus").alias("status"), F.year("o_orderdate").cast("bigint").alias("y")]
    return table(spark, d, "orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most
FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 10 AND json_extract_string(props, '$.none') IS NULL GROUP BY event_type""")
def delegated_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, d, "events").where((k > 10) & F.get_json_object("props", "$.none").isNull())
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def delegated_left_join(spark, d):
    finished = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(finished, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, s_acctbal, n_nationkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0")
def delegated_right_join(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 0")
    return rich.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "s_acctbal", "n_nationkey", "n_name")


@query("SELECT l_partkey AS k FROM lineitem EXCEPT ALL SELECT p_partkey FROM part")
def delegated_except_all(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).exceptAll(table(spark, d, "part").select("p_partkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def delegated_intersect_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, d, "supplier").select("s_nationkey"))


@query("""SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def delegated_lag_lead(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_totalprice").over(order).alias("before"), F.lead("o_totalprice", 2).over(order).alias("after"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rows_seen, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS around,
max(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS most FROM events""")
def delegated_frames(spark, d):
    order = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.count(F.lit(1)).over(order.rowsBetween(-2, 0)).alias("rows_seen"), F.round(F.sum("value").over(order.rowsBetween(-2, 1)), 2).alias("around"), F.max("value").over(order.rangeBetween(-100, 0)).alias("most"))


# Tables in other formats, and streams


def made_as(spark, d, form, compression):
    """Orders as a table made by a SELECT in a format and codec; only its files stay."""
    name, path = f"granary_{uuid.uuid4().hex}", f"{shared_dir(spark)}/ctas-{uuid.uuid4().hex}"
    table(spark, d, "orders").createOrReplaceTempView("granary_orders")
    made = sinks.create_table_as(spark, name, "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM granary_orders WHERE o_orderstatus <> 'P'", form, path, compression)
    schema = made.schema
    spark.sql(f"DROP TABLE {name}")
    return spark.read.format(form).schema(schema).load(path)


CTAS = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'P'"


@query(CTAS)
def ctas_orc_zlib(spark, d):
    return made_as(spark, d, "orc", "zlib")


@query(CTAS)
def ctas_orc_zstd(spark, d):
    return made_as(spark, d, "orc", "zstd")


@query(CTAS)
def ctas_parquet_gzip(spark, d):
    return made_as(spark, d, "parquet", "gzip")


@query(CTAS)
def ctas_parquet_zstd(spark, d):
    return made_as(spark, d, "parquet", "zstd")


@query("SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM nation GROUP BY n_regionkey")
def view_over_csv(spark, d):
    """A view over compressed CSV files with a header."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_as(table(spark, d, "nation"), path, "csv", "gzip", header="true")
    sinks.view_over(spark, "granary_nation", "csv", path, header="true", inferSchema="true")
    return spark.sql("SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM granary_nation GROUP BY n_regionkey")


@query("SELECT event_id, user_id, trunc(value * 10) / 10 AS value, date_trunc('second', ts) AS ts FROM events")
def stream_import(spark, d):
    """Events typed as they arrive and appended to a folder; what is there now is read once."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = typed_stream(spark, f"{d}/events.parque[t]", schema, "iei-1-")
    import_stream(rows.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz")), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out").select("event_id", "user_id", "value", "ts")
