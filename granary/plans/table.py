"""A stored table: typed Parquet in key order, its indexes and its description."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from granary.functions.words import Splitter, tokens
from granary.operators import index as ix
from granary.operators.access import lookup, require_unique
from granary.operators.rowid import in_order, with_row_id
from granary.operators.stats import column_stats
from granary.operators.verify import compare, index_gaps, null_and_empty, word_gaps
from granary.session import scratch
from granary.types import ColumnSpec, SpecError, coerce, column_specs


@dataclass
class Table:
    spark: SparkSession
    path: str
    keys: list[str]
    specs: list[ColumnSpec]
    secondary: list[list[str]] = field(default_factory=list)
    splitter: Splitter = tokens

    @staticmethod
    def build(df: DataFrame, path: str, letters: str, keys: list[str] | None = None, encodings: str | None = None, secondary: list[list[str]] | None = None, limit: int = 0, splitter: Splitter = tokens) -> Table:
        """Import rows: type them, put key columns first, refuse duplicate keys, number, write
        the data and every index that the letters ask for. ``limit`` 0 means all rows."""
        keys, secondary = keys or [], secondary or []
        specs = [s for s in column_specs(df.columns, letters, encodings) if s.letter not in "-S"]
        names = [s.name for s in specs]
        for k in keys:
            if k not in names:
                raise SpecError(f"key column {k!r} isn't stored")
            if next(s for s in specs if s.name == k).encoding != "u":
                raise SpecError(f"key column {k!r} must have encoding u")
        kinds = dict(df.dtypes)
        specs = [next(s for s in specs if s.name == k) for k in keys] + [s for s in specs if s.name not in keys]
        typed = df.select(*[coerce(s, F.col(s.name), kinds[s.name]).alias(s.name) for s in specs])
        typed = typed.limit(limit) if limit else typed
        table = Table(df.sparkSession, path, keys, specs, secondary, splitter)
        with scratch(table.spark):
            # Numbering writes the rows once; uniqueness is checked on what was written.
            numbered = with_row_id(typed, keys) if keys else in_order(typed)
            if keys:
                require_unique(numbered, keys)
            numbered.write.mode("overwrite").parquet(f"{path}/data")
        table.column_stats_frame().write.mode("overwrite").parquet(f"{path}/stats")
        for s in specs:
            if s.encoding == "T":
                ix.postings(table.data(), [s.name]).sort(s.name).write.mode("overwrite").parquet(f"{path}/idx_{s.name}")
            elif s.encoding == "W":
                words = ix.word_rows(table.data(), s.name, splitter=splitter)
                ix.postings(words, ["word"]).sort("word").write.mode("overwrite").parquet(f"{path}/words_{s.name}")
        for columns in secondary:
            ix.postings(table.data(), columns).sort(*columns).write.mode("overwrite").parquet(f"{path}/idx_{'+'.join(columns)}")
        meta = {"keys": keys, "specs": [[s.name, s.letter, s.encoding] for s in specs], "secondary": secondary}
        table.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return table

    @staticmethod
    def open(spark: SparkSession, path: str, splitter: Splitter = tokens) -> Table:
        """``splitter`` is the one the table was built with; it isn't stored."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return Table(spark, path, meta["keys"], [ColumnSpec(*s) for s in meta["specs"]], meta["secondary"], splitter)

    def data(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data")

    def index(self, columns: list[str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/idx_{'+'.join(columns)}")

    def words(self, column: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/words_{column}")

    def column_stats_frame(self) -> DataFrame:
        return column_stats(self.data(), [s.name for s in self.specs])

    def stats(self) -> DataFrame:
        """Written when the table was built; no scan of the data."""
        return self.spark.read.parquet(f"{self.path}/stats")

    def get(self, key: dict, columns: list[str] | None = None) -> DataFrame:
        return lookup(self.data(), key, columns)

    def cell(self, row_id: int, column: str) -> DataFrame:
        return self.data().where(F.col("row_id") == row_id).select(column)

    def scan(self, columns: list[str], start: int = 0) -> DataFrame:
        return self.data().where(F.col("row_id") >= start).select("row_id", *columns)

    def batches(self, columns: list[str], rows: int = 1024) -> Iterator[pa.RecordBatch]:
        """Arrow record batches of a projection, for another engine on the driver; the driver holds
        one partition at a time."""
        picked = self.data().select(*columns)
        schema = to_arrow_schema(picked.schema)
        stream = picked.toLocalIterator()
        while part := list(islice(stream, rows)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(schema)], schema=schema)

    def find(self, columns: list[str], values: list, prefix: bool = False, select: list[str] | None = None) -> DataFrame:
        """Rows whose columns equal the values (the last starts with its value if ``prefix``).

        Key columns go to the sorted data directly; an index on the columns is expanded and
        semi-joined; otherwise the data is scanned with pushed filters.
        """

        def hit() -> Column:
            tests = [F.col(c) == F.lit(v) for c, v in zip(columns, values, strict=True)]
            if prefix:
                tests[-1] = F.col(columns[-1]).startswith(values[-1])
            out = tests[0]
            for t in tests[1:]:
                out = out & t
            return out

        indexed = columns in self.secondary or len(columns) == 1 and any(s.name == columns[0] and s.encoding == "T" for s in self.specs)
        rows = ix.fetch(self.data(), ix.expand(self.index(columns).where(hit()))) if indexed and columns != self.keys[: len(columns)] else self.data().where(hit())
        return rows.select(*select) if select else rows

    def search(self, column: str, prefixes: list[str], select: list[str] | None = None) -> DataFrame:
        """Rows that have, for each prefix, a token that starts with it."""
        listed = self.words(column)
        rows = None
        for p in prefixes:
            some = ix.expand(listed.where(F.col("word").startswith(p)))
            rows = some if rows is None else rows.join(some, "row_id", "left_semi")
        found = ix.fetch(self.data(), rows)
        return found.select(*select) if select else found

    def verify(self, source: DataFrame) -> DataFrame:
        """Mismatches for each column between the source and what is stored."""
        kinds = dict(source.dtypes)
        typed = source.select(*[coerce(s, F.col(s.name), kinds[s.name]).alias(s.name) for s in self.specs])
        rest = [s.name for s in self.specs if s.name not in self.keys]
        if self.keys:
            return compare(typed, self.data(), self.keys, rest)
        return compare(in_order(typed), self.data(), ["row_id"], rest)

    def verify_nulls(self, source: DataFrame) -> DataFrame:
        """NULL and empty cells of the source and how many of them were lost; needs a key."""
        kinds = dict(source.dtypes)
        typed = source.select(*[coerce(s, F.col(s.name), kinds[s.name]).alias(s.name) for s in self.specs])
        return null_and_empty(typed, self.data(), self.keys, [s.name for s in self.specs if s.name not in self.keys])

    def verify_indexes(self) -> dict[str, int]:
        """Gaps of each stored index: values or words whose rows it lacks, or has too many of."""
        found = {}
        for s in self.specs:
            if s.encoding == "T":
                found[s.name] = index_gaps(self.data(), self.index([s.name]), [s.name]).count()
            elif s.encoding == "W":
                found[s.name] = word_gaps(self.data(), s.name, self.words(s.name), splitter=self.splitter).count()
        for columns in self.secondary:
            found["+".join(columns)] = index_gaps(self.data(), self.index(columns), columns).count()
        return found
