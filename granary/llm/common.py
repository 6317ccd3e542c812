"""What the operators share: sources, held-out rows, bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows and bytes that a worker turns into Python objects at once; a longer row is a piece of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 23
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part`` over; null ids are held out."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts
    return F.coalesce(rest == part, F.lit(True))


def bound_batches(spark: SparkSession) -> None:
    """Let Spark send workers batches of ``BATCH_ROWS`` rows, so that long texts don't fill them on their
    way. It's a setting of the session, so the program that owns it calls this, not the operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded size, by the mean size of its rows."""
    step = max(1, min(BATCH_ROWS, BATCH_BYTES * batch.num_rows // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Run ``make()`` once a task and the function it gives on each piece of its Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch):
                yield work(piece)

    return df.mapInArrow(run, schema)


def schema_with(df: DataFrame, added: str) -> StructType:
    """``df``'s columns and the added ones, which are given as DDL."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields] + StructType.fromDDL(added).fields)


def one_text_each(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row an id, ``(doc_id, text)``: of several texts the one with the least hash. Repeated ids
    are reduced before the shuffle."""
    least = F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t")))
    return docs.groupBy(doc_id).agg(least.alias("_least")).select(doc_id, F.col("_least.t").alias(text))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def first_by_hash(df: DataFrame, doc_id: str, most: int) -> DataFrame:
    """A bounded sample that doesn't depend on partitions: the ``most`` least hashes of the id."""
    return df.orderBy(F.xxhash64(doc_id), doc_id).limit(most)
