"""Session defaults, and the place and the owner of intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWNERS: ContextVar[tuple[list[str], ...]] = ContextVar("owners", default=())


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster use the session that is there."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "256m")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and all runs in one process is a temporary folder made and
    remembered in the session; elsewhere each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive executors, so later stages never see other
    partition bounds or another order than the first run. The files belong to the innermost
    ``scratch`` block, or with ``keep`` to the one around it; without any they stay.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    owners = _OWNERS.get()[: -1 if keep else None]
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owner of what ``stage`` writes inside the block; it's deleted when the block ends, so results
    that read it must have been written or collected by then."""
    paths: list[str] = []
    token = _OWNERS.set((*_OWNERS.get(), paths))
    try:
        yield
    finally:
        _OWNERS.reset(token)
        for path in paths:
            remove(spark, path)


def _placed(spark: SparkSession, path: str):
    """A path and the file system that it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names."""
    place, system = _placed(spark, path)
    system.delete(place, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    place, system = _placed(spark, path)
    return system.getContentSummary(place).getLength()
