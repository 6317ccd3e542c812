"""Continuous import of files into a stored folder, one pass over each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.types import coerce, column_specs


def typed_stream(spark: SparkSession, path: str, schema: str, letters: str, kind: str = "parquet") -> DataFrame:
    """Rows of files as they arrive, typed as an import would type them. ``path`` is a folder, or a
    pattern of files and folders."""
    raw = spark.readStream.format(kind).schema(schema).load(path)
    kinds = dict(raw.dtypes)
    specs = [s for s in column_specs(raw.columns, letters) if s.letter not in "-S"]
    return raw.select(*[coerce(s, F.col(s.name), kinds[s.name]).alias(s.name) for s in specs])


def import_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append typed rows as Parquet, then stop: what came since the last call is read once."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, ts: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events in windows by key; rows later than ``late`` are outside the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
