"""Readers by source kind; each gives a DataFrame."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import shared_dir


def select_text(table_or_select: str) -> str:
    text = table_or_select.strip()
    return text if re.match(r"(?i)(select|with)\b", text) else f"SELECT * FROM {text}"


def read_sql(spark: SparkSession, table_or_select: str) -> DataFrame:
    """A registered table's name, or a SELECT that is used as it stands."""
    return spark.sql(select_text(table_or_select))


def _from_stdin(spark: SparkSession) -> str:
    """Copy standard input to a file in the shared folder, piece by piece, and give its path."""
    path = f"{shared_dir(spark)}/stdin-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        while piece := sys.stdin.buffer.read(1 << 20):
            out.write(piece)
    finally:
        out.close()
    return path


def read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Header always on, doubled quotes, ``\\N`` is NULL, short rows end in NULLs; all text. The path
    ``stdin`` is standard input, which can be read once."""
    path = _from_stdin(spark) if path == "stdin" else path
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', nullValue="\\N", emptyValue="", mode="PERMISSIVE", enforceSchema=False)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, ",")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, "\t")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str = "row") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table_or_select: str, key: str | None = None, parts: int = 32, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """Any JDBC source; with a numeric key and its bounds the read is split over executors."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({select_text(table_or_select)}) t").options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def read_sqlite(spark: SparkSession, path: str, table_or_select: str) -> DataFrame:
    """A SQLite file beside the driver. It's one file with one reader, so rows pass the driver
    as Arrow batches; for large databases use ``read_jdbc``."""
    import sqlite3

    import pyarrow as pa

    con = sqlite3.connect(path)
    try:
        cursor = con.execute(select_text(table_or_select))
        names = [c[0] for c in cursor.description]
        rows = cursor.fetchall()
    finally:
        con.close()
    columns = [[r[i] for r in rows] for i in range(len(names))]
    kinds = [{type(v) for v in c if v is not None} for c in columns]
    cast = [pa.int64() if k == {int} else pa.float64() if k and k <= {int, float} else pa.binary() if k == {bytes} else pa.string() for k in kinds]
    arrays = [pa.array([v if v is None or t != pa.string() else str(v) for v in c], t) for c, t in zip(columns, cast, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names))


def read_duckdb(spark: SparkSession, path: str, table_or_select: str) -> DataFrame:
    """A DuckDB file beside the driver, as one Arrow table."""
    import duckdb

    con = duckdb.connect(path, read_only=path != ":memory:")
    try:
        return spark.createDataFrame(con.sql(select_text(table_or_select)).to_arrow_table())
    finally:
        con.close()


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("value").alias("key"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("line_no"), F.col("_metadata.file_block_start").alias("_split")
    ).where(F.length("key") > 0)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Keys, one a line: empty lines go, and of equal lines that follow each other one stays.

    Neighbours are compared within each file split by the position in the file, and a split's first
    line with the last one of the split before it that isn't empty (one row a split), so nothing is
    sorted globally; ``line_no`` grows with the position and isn't dense.
    """
    rows = _placed_lines(spark, path)
    order = Window.partitionBy("_file", "_split").orderBy("line_no")
    ends = rows.groupBy("_file", "_split").agg(F.max_by("key", "line_no").alias("_end"))
    ends = ends.select("_file", "_split", F.lag("_end").over(Window.partitionBy("_file").orderBy("_split")).alias("_end"))
    joined = rows.join(ends, ["_file", "_split"])
    return joined.withColumn("_before", F.coalesce(F.lag("key").over(order), "_end")).where(~F.col("key").eqNullSafe(F.col("_before"))).select("line_no", "key")


def lines_are_sorted(spark: SparkSession, path: str) -> bool:
    """Whether the lines that aren't empty come in byte order, files by their names. Neighbours are
    compared within splits, and splits by their first and last lines (one row a split)."""
    rows = _placed_lines(spark, path)
    before = F.lag("key").over(Window.partitionBy("_file", "_split").orderBy("line_no"))
    checked = rows.withColumn("_down", F.coalesce(before > F.col("key"), F.lit(False)))
    ends = checked.groupBy("_file", "_split").agg(F.min_by("key", "line_no").alias("first"), F.max_by("key", "line_no").alias("last"), F.bool_or("_down").alias("down"))
    turned = F.coalesce(F.lag("last").over(Window.orderBy("_file", "_split")) > F.col("first"), F.lit(False))
    return ends.select((F.col("down") | turned).alias("down")).where("down").isEmpty()


READERS: dict[str, Callable[..., DataFrame]] = {
    "sqlite3": read_sqlite, "duckdb": read_duckdb, "csv": read_csv, "tsv": read_tsv, "ndjson": read_ndjson,
    "xml": read_xml, "parquet": read_parquet, "jdbc": read_jdbc, "sql": read_sql, "lines": read_lines,
}


def reader(kind: str) -> Callable[..., DataFrame]:
    for name in sorted(READERS, key=len, reverse=True):
        if kind.startswith(name):
            return READERS[name]
    raise ValueError(f"unknown source {kind!r}; known: {', '.join(sorted(READERS))}")
