"""Import a source into a stored table, verify a stored table against its source, or both.

    python -m granary.plans.cli both csv orders.csv /tables/orders --types ittt --keys o_orderkey
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from granary.plans.table import Table
from granary.session import scratch
from granary.sources import reader


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="granary", description=__doc__.split("\n")[0])
    p.add_argument("action", choices=["import", "verify", "both"])
    p.add_argument("kind", help="kind of source: csv, tsv, ndjson, xml, parquet, sqlite3, duckdb, jdbc, sql, lines")
    p.add_argument("source", help="path, URL, stdin (csv and tsv), or for sql a table or SELECT")
    p.add_argument("path", nargs="?", help="folder of the stored table; by default the source's path with .granary")
    p.add_argument("--select", help="table or SELECT within a database")
    p.add_argument("--types", help="a storage letter for each column")
    p.add_argument("--encodings", help="an encoding letter for each column")
    p.add_argument("--keys", default="", help="key columns, separated by commas")
    p.add_argument("--secondary", default="", help="columns of secondary indexes: a+b,c")
    p.add_argument("--limit", type=int, default=0, help="rows to import, 0 for all")
    return p


def source(spark: SparkSession, kind: str, place: str, select: str | None) -> DataFrame:
    return reader(kind)(spark, place, select) if select else reader(kind)(spark, place)


def run(spark: SparkSession, argv: list[str]) -> int:
    """0 if all rows are stored and equal, 1 if verification found differences."""
    asked = parser()
    a = asked.parse_args(argv)
    if a.action != "verify" and not a.types:
        asked.error("--types is needed to import")
    if a.action == "both" and a.limit:
        asked.error("a limited import lacks rows of its source and can't be verified against it")
    if a.source == "stdin" and (a.action != "import" or not a.path):
        asked.error("standard input can be read once, so it can only be imported, and into a path that is given")
    if not a.path and a.kind in ("sql", "jdbc"):
        asked.error("this source has no path to name the stored table after")
    a.path = a.path or f"{a.source}.granary"
    df = source(spark, a.kind, a.source, a.select)
    if a.action != "verify":
        table = Table.build(df, a.path, a.types, a.keys.split(",") if a.keys else None, a.encodings, [s.split("+") for s in a.secondary.split(",") if s], a.limit)
        print(f"{table.data().count()} rows stored in {a.path}")
    if a.action == "import":
        return 0
    with scratch(spark):
        found = Table.open(spark, a.path).verify(df).first().asDict()
    for name, n in found.items():
        print(f"{name}: {n or 0}")
    return int(any(found.values()))


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("granary").getOrCreate(), sys.argv[1:]))
