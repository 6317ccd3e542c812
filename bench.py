"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], then key dictionaries of the sizes for which
rates are published; prints one JSON line. $BENCH_KEYS lists their numbers of keys, empty for none."""

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.access import batch_lookup
from granary.operators.rowid import with_row_id
from granary.plans import registry
from granary.session import local_session, remove, scratch, shared_dir, stage, stored_bytes

HEADLINE = [
    "pk_batch_lookup", "pk_missing_keys", "pk_prefix_scan", "ordered_iteration", "rank_and_reverse", "sum_double", "sum_text_len", "column_stats", "dict_encode",
    "delta_roundtrip", "rle_runs", "twoway_postings", "secondary_composite", "word_frequency", "word_prefix_search", "verify_mismatches", "delegated_group_by", "delegated_window",
]
KEYS = "1099292,18058068"


def timed(name: str, df: DataFrame, took: dict[str, float]) -> None:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    took[name] = round(time.perf_counter() - began, 3)
    print(name, took[name], file=sys.stderr)


def dictionaries(spark: SparkSession, n: int, took: dict[str, float]) -> dict[str, dict[str, float]]:
    """Thousand keys a second and bytes stored for texts of about 20 bytes, which come sorted or
    shuffled: build (read, order, number, write), lookup of each key, reverse lookup of each row id."""
    out = {}
    text = F.concat_ws("_", F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 10), F.conv(F.col("id"), 10, 36))
    with scratch(spark):
        keys = stage(spark.range(n).select(text.alias("key")), "bench-keys")
        shuffled = stage(keys.repartition(8, F.xxhash64("key")).sortWithinPartitions(F.xxhash64("key", F.lit(1))), "bench-shuffled")
        for order, source in (("sorted", stage(keys.orderBy("key"), "bench-sorted")), ("shuffled", shuffled)):
            path = f"{shared_dir(spark)}/bench-table-{n}-{order}"
            name = f"keys_{n}_{order}"
            began = time.perf_counter()
            with scratch(spark):
                with_row_id(source, ["key"]).write.mode("overwrite").parquet(path)
            took[f"{name}_build"] = round(time.perf_counter() - began, 3)
            table = spark.read.parquet(path)
            timed(f"{name}_lookup", batch_lookup(table, source, ["key"], ["row_id"]), took)
            ids = spark.range(n).select(F.col("id").alias("row_id"))
            timed(f"{name}_reverse", batch_lookup(table, ids, ["row_id"], ["key"]), took)
            rate = lambda what: round(n / took[f"{name}_{what}"] / 1000, 1)  # noqa: B023, E731
            size = stored_bytes(spark, path)
            out[name] = {"build_k_s": rate("build"), "lookup_k_s": rate("lookup"), "reverse_k_s": rate("reverse"), "bytes": size}
            print(name, out[name], file=sys.stderr)
            remove(spark, path)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["sum_int"](spark, sf_dir).collect()  # starts the executors' code
    took: dict[str, float] = {}
    for name in HEADLINE:
        with scratch(spark):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr)
    total, rates = round(sum(took.values()), 3), {}
    for n in filter(None, os.environ.get("BENCH_KEYS", KEYS).split(",")):
        rates |= dictionaries(spark, int(n), took)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "keys": rates, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
