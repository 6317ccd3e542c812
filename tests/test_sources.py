"""Readers of every kind, sinks, standard input and streams."""

import datetime
import io
import sqlite3
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from granary.plans import cli
from granary.plans.table import Table
from granary.sources import lines_are_sorted, read_csv, read_duckdb, read_jdbc, read_lines, read_ndjson, read_sql, read_sqlite, read_tsv, read_xml, reader, sinks
from granary.streaming import counts_by_window, import_stream, typed_stream


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x, ""y"""\n2,\\N\n3\n')
    assert rows(read_csv(spark, str(tmp_path / "a.csv"))) == [("1", 'x, "y"'), ("2", None), ("3", None)]
    (tmp_path / "a.tsv").write_text('id\tt\n1\t"x\t""y"""\n2\t\\N\n3\n4\ta,b\n5\t""\n')
    assert rows(read_tsv(spark, str(tmp_path / "a.tsv"))) == [("1", 'x\t"y"'), ("2", None), ("3", None), ("4", "a,b"), ("5", "")]


def test_xml_and_ndjson(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all><row><id>1</id><t>x &amp; y</t></row><row><id>2</id></row></all>")
    assert sorted(rows(read_xml(spark, str(tmp_path / "a.xml")).select("id", "t"))) == [(1, "x & y"), (2, None)]
    (tmp_path / "a.json").write_text('{"id": 1, "t": "x"}\n{"id": 2}\n{"id": 3, "t": null}\n')
    assert sorted(rows(read_ndjson(spark, str(tmp_path / "a.json")).select("id", "t"))) == [(1, "x"), (2, None), (3, None)]


def test_databases(spark, tmp_path):
    import duckdb

    con = sqlite3.connect(tmp_path / "s.db")
    con.execute("CREATE TABLE t (i INTEGER, r REAL, s TEXT)")
    con.execute("INSERT INTO t VALUES (1, 2.5, 'x'), (NULL, NULL, NULL)")
    con.commit()
    con.close()
    assert rows(read_sqlite(spark, str(tmp_path / "s.db"), "t")) == [(1, 2.5, "x"), (None, None, None)]
    con = duckdb.connect(str(tmp_path / "d.db"))
    con.execute("CREATE TABLE t AS SELECT 1::BIGINT AS i, 2.5::DOUBLE AS r, 'x' AS s, DATE '2024-02-29' AS d UNION ALL SELECT NULL, NULL, NULL, NULL")
    con.close()
    path = str(tmp_path / "d.db")
    assert set(rows(read_duckdb(spark, path, "t"))) == {(1, 2.5, "x", datetime.date(2024, 2, 29)), (None,) * 4}
    assert rows(read_duckdb(spark, path, "SELECT s, i + 1 AS j FROM t WHERE i > 0")) == [("x", 2)]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'derby'};create=true"
    spark.range(100).select(F.col("id").alias("K"), F.concat(F.lit("v"), F.col("id")).alias("V")).write.format("jdbc").options(url=url, dbtable="T").save()
    assert sorted(rows(read_jdbc(spark, url, "T", key="K", parts=4, bounds=(0, 100)))) == [(i, f"v{i}") for i in range(100)]
    assert rows(read_jdbc(spark, url, "SELECT V FROM T WHERE K = 7")) == [("v7",)]
    view = sinks.view_over(spark, "granary_jdbc", "jdbc", url=url, dbtable="T")
    assert view.where("K < 3").count() == 3


def test_sql_source(spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 2 AS d").createOrReplaceTempView("granary_five")
    assert rows(read_sql(spark, "granary_five").orderBy("id")) == [(i, 2 * i) for i in range(5)]
    assert rows(read_sql(spark, "  select d from granary_five where id = 3")) == [(6,)]
    assert rows(read_sql(spark, "WITH x AS (SELECT 1 AS one) SELECT * FROM x")) == [(1,)]
    assert reader("sqlite3") is read_sqlite and reader("csv") is read_csv
    with pytest.raises(ValueError):
        reader("nothing")
    assert cli.run(spark, ["both", "sql", "SELECT id, d FROM granary_five", str(tmp_path / "t"), "--types", "ii", "--keys", "id"]) == 0


def test_lines(spark, tmp_path):
    (tmp_path / "keys").write_text("a\na\n\nb\na\n")
    assert [r.key for r in read_lines(spark, str(tmp_path / "keys")).orderBy("line_no").collect()] == ["a", "b", "a"]
    lines = [x for i in range(40) for x in [f"key{i // 7}"] * 5 + [""] * (i % 9)]
    (tmp_path / "many").write_text("\n".join(lines))
    (tmp_path / "turned").write_text("\n".join([*lines[:-5], "kex", *lines[-5:]]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32")
    try:
        got = [r.key for r in read_lines(spark, str(tmp_path / "many")).orderBy("line_no").collect()]
        assert lines_are_sorted(spark, str(tmp_path / "many")) and not lines_are_sorted(spark, str(tmp_path / "turned"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [f"key{i}" for i in range(6)]
    assert not lines_are_sorted(spark, str(tmp_path / "keys"))


def test_standard_input_and_default_output(spark, tmp_path, monkeypatch):
    text = "id,t\n" + "".join(f"{i},w{i}\n" for i in range(30))
    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(text.encode())))
    assert cli.run(spark, ["import", "csv", "stdin", str(tmp_path / "t"), "--types", "it", "--keys", "id"]) == 0
    assert Table.open(spark, str(tmp_path / "t")).data().count() == 30
    for wrong in (["both", "csv", "stdin", "x", "--types", "it"], ["import", "csv", "stdin", "--types", "it"], ["import", "sql", "SELECT 1", "--types", "i"]):
        with pytest.raises(SystemExit):
            cli.run(spark, wrong)
    (tmp_path / "a.csv").write_text(text)
    assert cli.run(spark, ["both", "csv", str(tmp_path / "a.csv"), "--types", "it", "--keys", "id"]) == 0
    assert Table.open(spark, str(tmp_path / "a.csv.granary")).data().count() == 30


@pytest.mark.parametrize(("form", "codec"), [("orc", "zlib"), ("orc", "snappy"), ("parquet", "lz4"), ("json", "gzip")])
def test_formats(spark, tmp_path, form, codec):
    df = spark.createDataFrame([(1, "x", 2.5), (2, None, None), (3, "", -0.5)], "i bigint, t string, d double")
    assert sorted(rows(sinks.write_as(df, str(tmp_path / "o"), form, codec))) == sorted(rows(df))


def test_streams(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "id string, d string, at string"
    for i in range(2):
        spark.createDataFrame([(str(i), "1.29", "2024-01-01 10:00:00"), ("x", "bad", "no")], schema).coalesce(1).write.mode("append").parquet(source)
        import_stream(typed_stream(spark, source, schema, "i1e"), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == 2 * i + 2  # each file once
    assert sorted(rows(spark.read.parquet(out)), key=str) == [(0, 1.2, datetime.datetime(2024, 1, 1, 10)), (1, 1.2, datetime.datetime(2024, 1, 1, 10)), (None, None, None), (None, None, None)]
    events = str(tmp_path / "events")
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([(at(1, 5), "a"), (at(1, 55), "a"), (at(2, 5), "b"), (at(5, 0), "a")], "ts timestamp, k string").write.parquet(events)
    stream = counts_by_window(spark.readStream.schema("ts timestamp, k string").parquet(events), "ts", "k")
    stream.writeStream.format("memory").queryName("granary_counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.window.start.hour, r.k, r.n) for r in spark.table("granary_counts").collect()) == [(1, "a", 2), (2, "b", 1), (5, "a", 1)]
