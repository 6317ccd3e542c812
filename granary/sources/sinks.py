"""Tables made from a SELECT in a format and codec of choice, and views over files of any format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.sources import select_text


def write_as(df: DataFrame, path: str, form: str, compression: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` in a format that Spark has a writer for, and read it back with the same types."""
    writer = df.write.format(form).options(**options)
    (writer.option("compression", compression) if compression else writer).save(path)
    return df.sparkSession.read.format(form).options(**options).schema(df.schema).load(path)


def create_table_as(spark: SparkSession, name: str, table_or_select: str, form: str, path: str, compression: str | None = None) -> DataFrame:
    """``CREATE TABLE ... USING ... AS SELECT`` with its files at ``path``."""
    codec = f"OPTIONS ('compression' = '{compression}')" if compression else ""
    spark.sql(f"CREATE TABLE {name} USING {form} {codec} LOCATION '{path}' AS {select_text(table_or_select)}")
    return spark.table(name)


def view_over(spark: SparkSession, name: str, form: str, path: str | None = None, **options: str) -> DataFrame:
    """A temporary view over files or, with ``jdbc``, over a table of another system."""
    given = options | ({"path": path} if path else {})
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in given.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} USING {form} OPTIONS ({listed})")
    return spark.table(name)
