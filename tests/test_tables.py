"""Hand-made edge cases of imports, indexes and transforms."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from granary.functions import keys, scalar
from granary.operators import encode, index, verify
from granary.operators.access import DuplicateKeyError
from granary.operators.rowid import assert_dense, with_row_id
from granary.operators.stats import column_stats
from granary.plans import cli
from granary.plans.table import Table
from granary.types import SpecError, column_specs, parse_datetime, truncate


def test_build_and_query(spark, tmp_path):
    rows = [(i, f"k{i % 7}", "a b " * (i % 3) + "x", float(i) / 3) for i in range(300)] + [(300, None, "", None), (301, " ", "!", -0.0)]
    df = spark.createDataFrame(rows, "id bigint, k string, t string, d double")
    table = Table.build(df, str(tmp_path / "t"), "itt2", keys=["id"], encodings="uTWu", secondary=[["k", "t"]])
    table = Table.open(spark, table.path)
    assert_dense(table.data())
    assert [tuple(r) for r in table.get({"id": 301}, ["k", "t", "d"]).collect()] == [(" ", "!", 0.0)]
    assert table.get({"id": 300}).first().k is None
    assert sorted(r.id for r in table.find(["k"], ["k3"]).collect()) == [i for i in range(300) if i % 7 == 3]
    assert table.find(["k"], ["k"], prefix=True).count() == 300
    assert table.search("t", ["b"]).count() == 200 and table.search("t", ["a", "x"]).count() == 200
    assert table.find(["k", "t"], ["k1", "x"]).count() == sum(i % 7 == 1 and i % 3 == 0 for i in range(300))
    assert not any(v for v in table.verify(df).first())
    assert table.verify_indexes() == {"k": 0, "t": 0, "k+t": 0}
    assert {r.column_name: tuple(r[1:]) for r in table.verify_nulls(df).collect()} == {"k": (1, 0, 0, 0), "t": (0, 1, 0, 0), "d": (1, 0, 0, 0)}
    assert {r.column_name: r.null_count for r in table.stats().collect()} == {"id": 0, "k": 1, "t": 0, "d": 1}
    got = list(table.batches(["id", "k"], 100))
    assert [b.num_rows for b in got] == [100, 100, 100, 2] and got[0].schema.names == ["id", "k"]
    assert sorted(x for b in got for x in b.column("id").to_pylist()) == list(range(302))


def test_splitter_and_limit(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a-{i % 3};b c;{i}") for i in range(50)], "id bigint, t string")
    by_mark = lambda c: F.split(c, ";")
    table = Table.build(df, str(tmp_path / "s"), "it", keys=["id"], encodings="uW", splitter=by_mark)
    assert table.search("t", ["b c"]).count() == 50 and table.search("t", ["a-1"]).count() == 17 and table.search("t", ["c"]).count() == 0
    assert table.verify_indexes() == {"t": 0} and Table.open(spark, table.path, by_mark).verify_indexes() == {"t": 0}
    unsure = df.withColumn("id", F.monotonically_increasing_id() + (F.rand() * 0).cast("bigint"))
    few = Table.build(unsure, str(tmp_path / "l"), "it", keys=["id"], limit=7)
    assert few.data().count() == 7
    plain = Table.build(df.repartition(3), str(tmp_path / "p"), "it")
    assert_dense(plain.data())
    assert plain.data().count() == 50


def test_refusals(spark, tmp_path):
    twice = spark.createDataFrame([(1,), (1,)], "id bigint")
    with pytest.raises(DuplicateKeyError):
        Table.build(twice, str(tmp_path / "d"), "i", keys=["id"])
    for letters, encodings in (("q", "u"), ("i", "w"), ("t", "d"), ("", "")):
        with pytest.raises(SpecError):
            column_specs(["x"], letters, encodings)


def test_truncation_and_dates(spark):
    values = spark.createDataFrame([(4.35,), (0.29,), (-1.15,), (19.99,)], "d double")
    got = [tuple(r) for r in values.select(*[truncate(F.col("d"), n) for n in (1, 2, 3)]).collect()]
    assert got == [(4.3, 4.34, 4.35), (0.2, 0.28, 0.29), (-1.1, -1.14, -1.15), (19.9, 19.98, 19.99)]
    dates = spark.createDataFrame([("2024-02-29 00:00:00.5",), ("1969-12-31 23:59:59.123456",), ("bad",), (None,)], "t string")
    got = [r[0] for r in dates.select(parse_datetime(F.col("t"), "g")).collect()]
    assert [x and x.microsecond for x in got] == [500000, 123000, None, None] and got[1].year == 1969


@pytest.mark.parametrize("n", [0, 63, 64, 65, 128, 513])
def test_blocks(spark, n):
    df = with_row_id(spark.createDataFrame([(i, (i * 7) % 5 - 2) for i in range(n)], "id bigint, v bigint"), ["id"])
    want = {i: (i * 7) % 5 - 2 for i in range(n)}
    for got in (encode.delta_decode(encode.delta(df, "v"), "v"), encode.runs_decode(encode.runs(df, "v"), "v"), encode.frame_decode(encode.frame_of_reference(df, "v"), "v")):
        assert {r.row_id: r.v for r in got.collect()} == want


def test_posting_ranges(spark):
    df = spark.createDataFrame([("v", i) for i in (1, 2, 3, 7, 9, 10)], "k string, row_id bigint")
    for size in (1, 2, 4, 1 << 20):
        assert sorted((r.row_start, r.row_end) for r in index.postings(df, ["k"], slice_rows=size).collect()) == [(1, 3), (7, 7), (9, 10)]


def test_frequent_values_are_sliced(spark):
    n, size = 20_000, 64
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, "even").when(F.col("id") < 9000, "low").otherwise(F.concat(F.lit("run"), F.floor(F.col("id") / 500))).alias("k"), F.col("id").alias("row_id"))
    whole = df.union(spark.range(n, 3 * n).select(F.lit("long"), F.col("id")))
    found = index.postings(whole, ["k"], slice_rows=size)
    assert "hashpartitioning(k" in (plan := found._jdf.queryExecution().toString()) and "_slice" in plan
    want, last = {}, None
    for r in sorted(whole.collect(), key=lambda r: (r.k, r.row_id)):
        if last and last[0] == r.k and last[2] + 1 == r.row_id:
            last[2] = r.row_id
        else:
            last = [r.k, r.row_id, r.row_id]
            want[r.k, r.row_id] = last
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.values()))
    # What meets again after the slices: two ranges of a value and slice at most.
    ranges = index._islands(whole.select("k", F.col("row_id").alias("row_start"), F.col("row_id").alias("row_end"), F.floor(F.col("row_id") / size).alias("_slice")), ["k", "_slice"])
    edge = ranges.where((F.col("row_start") % size == 0) | (F.col("row_end") % size == size - 1))
    assert edge.groupBy("k", "_slice").count().where("count > 2").isEmpty()


def test_long_ranges_are_listed_in_pieces(spark):
    ranges = spark.createDataFrame([("a", 5, 1030), ("b", 64, 127), ("c", 7, 7)], "k string, row_start bigint, row_end bigint")
    got = sorted(map(tuple, index.listed(ranges, ["k"], pieces=(256, 16)).collect()))
    assert got == [("a", i) for i in range(5, 1031)] + [("b", i) for i in range(64, 128)] + [("c", 7)]
    far = spark.createDataFrame([((1 << 40) - 2, (1 << 40) + 1)], "row_start bigint, row_end bigint")
    assert sorted(r.row_id for r in index.expand(far).collect()) == list(range((1 << 40) - 2, (1 << 40) + 2))


def test_statistics_of_integers_are_exact(spark):
    df = spark.createDataFrame([((1 << 53) + 1, -1.5, "é", datetime.date(2024, 2, 29)), (None, None, None, None)], "i bigint, d double, t string, b date")
    got = {r.column_name: tuple(r[1:]) for r in column_stats(df).collect()}
    days = (datetime.date(2024, 2, 29) - datetime.date(1970, 1, 1)).days
    assert got == {"i": (1, (1 << 53) + 1, (1 << 53) + 1, None, None, 16), "d": (1, None, None, -1.5, -1.5, 4), "t": (1, 2, 2, None, None, 2), "b": (1, days, days, None, None, 10)}


def test_decimals(spark):
    values = [0.0, 4.35, -1.15, 1e30, 1.5e-17, 123456789.125, float("nan"), float("inf"), None, 1e15, 0.1 + 0.2, 2.0**60]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id bigint, v double")
    scales = [r[0] for r in df.orderBy("row_id").select(scalar.decimal_scale(F.col("v"))).collect()]
    assert scales == [0, 2, 2, 0, 18, 3, None, None, None, 0, 17, 0]
    coded = {r.row_id: r for r in encode.decimal_blocks(df, "v").collect()}
    assert coded[1].places == 3 and coded[1].scaled == 4350 and coded[2].scaled == -1150 and coded[5].scaled == 123456789125
    assert all(coded[i].scaled is None and coded[i].raw == values[i] for i in (3, 4, 7, 10, 11))
    back = {r.row_id: r.v for r in encode.decimal_blocks_decode(encode.decimal_blocks(df, "v"), "v").collect()}
    assert all(back[i] == v or v != v and back[i] != back[i] for i, v in enumerate(values))


def test_words_as_references(spark):
    texts = ["one two one", "", None, "...", "two  two", "é, ü"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")
    codes = encode.word_dictionary(df, "text")
    coded = encode.word_encode(df, "text", codes)
    assert {r.row_id: r.refs and len(r.refs) for r in coded.collect()} == {0: 3, 1: [], 2: None, 3: 1, 4: 2, 5: 2}
    assert {r.row_id: r.text for r in encode.word_decode(coded, codes, "text").collect()} == dict(enumerate(texts))


def test_local_folders_are_refused_off_local():
    from types import SimpleNamespace

    from granary.session import shared_dir

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master)))


def test_scratch_clears_what_it_owns(spark):
    from pathlib import Path

    from granary.session import scratch, shared_dir, stage

    place = Path(shared_dir(spark).removeprefix("file://"))
    before = set(place.iterdir()) if place.exists() else set()
    with scratch(spark):
        with scratch(spark):
            stage(spark.range(3), "own")
            kept = stage(spark.range(5), "kept", keep=True)
        assert kept.count() == 5 and len(set(place.iterdir()) - before) == 1
    assert set(place.iterdir()) == before


def test_keys_sort_as_their_parts(spark):
    ints = [None, -(1 << 63), -(1 << 60), -1, 0, 1, 255, 256, (1 << 63) - 1]
    texts = [None, "", "\0", "\0\1", "\1", "a", "a\0", "a\0b", "aa", "é", "日本", "😀", "x" * 20_000]
    rows = [(i, t, j) for i in ints for t in texts for j in (None, -5, 7)]
    df = spark.createDataFrame(rows, "i bigint, t string, j int")
    parts = [(F.col("i"), "i"), (F.col("t"), "t"), (F.col("j"), "i")]
    got = df.withColumn("key", keys.key_bytes(parts)).select("*", *[keys.key_part(F.col("key"), "iti", n).alias(f"b{n}") for n in range(3)]).collect()
    assert all((r.i, r.t, r.j) == (r.b0, r.b1, r.b2) for r in got)

    def order(r):
        return [(v is not None, v.encode() if isinstance(v, str) else v) if v is not None else (False,) for v in (r.i, r.t, r.j)]

    assert [tuple(r[:3]) for r in sorted(got, key=lambda r: bytes(r.key))] == [tuple(r[:3]) for r in sorted(got, key=order)]
    assert len({bytes(r.key) for r in got}) == len(rows)


def test_keys_of_numbers_and_times(spark):
    doubles = [None, -math.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.5, 1e300, math.inf, math.nan]
    times = [None, datetime.datetime(1, 1, 1), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), datetime.datetime(2024, 2, 29, 1, 2, 3, 456789)]
    days = [None, datetime.date(1900, 3, 1), datetime.date(2024, 2, 29)]
    rows = [(d, e, b) for d in doubles for e in times for b in days]
    df = spark.createDataFrame(rows, "d double, e timestamp_ntz, b date")
    parts = [(F.col("d"), "."), (F.col("e"), "e"), (F.col("b"), "b")]
    got = df.withColumn("key", keys.key_bytes(parts)).select("*", *[keys.key_part(F.col("key"), ".eb", n).alias(f"b{n}") for n in range(3)]).collect()
    assert all((r.d == r.b0 or r.d != r.d and r.b0 != r.b0) and (r.e, r.b) == (r.b1, r.b2) for r in got)
    place = {repr(tuple(r)): i for i, r in enumerate(rows)}
    assert [place[repr(tuple(r[:3]))] for r in sorted(got, key=lambda r: bytes(r.key))] == list(range(len(rows)))
    zero = spark.createDataFrame([(0.0,), (-0.0,)], "d double").select(keys.key_bytes([(F.col("d"), ".")]).alias("k"))
    assert zero.distinct().count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("id,t,d\n" + "".join(f"{i},w{i % 3},{i}.25\n" for i in range(50)))
    where = [str(tmp_path / "a.csv"), str(tmp_path / "t")]
    assert cli.run(spark, ["both", "csv", *where, "--types", "it.", "--encodings", "uTu", "--keys", "id", "--secondary", "t+d"]) == 0
    assert "50 rows stored" in capsys.readouterr().out
    assert Table.open(spark, where[1]).find(["t", "d"], ["w1", 1.25]).count() == 1
    (tmp_path / "a.csv").write_text("id,t,d\n" + "".join(f"{i},w{i % 3},{i + (i == 7)}.25\n" for i in range(51)))
    assert cli.run(spark, ["verify", "csv", *where]) == 1
    said = capsys.readouterr().out
    assert "not_stored: 1" in said and "bad_d: 1" in said
    assert cli.run(spark, ["import", "csv", where[0], str(tmp_path / "u"), "--types", "it.", "--limit", "10"]) == 0
    assert Table.open(spark, str(tmp_path / "u")).data().count() == 10
    with pytest.raises(SystemExit):
        cli.run(spark, ["import", "csv", *where])


def test_word_gaps_are_found(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "two")], "row_id bigint, text string")
    whole = index.postings(index.word_rows(docs, "text"), ["word"])
    assert verify.word_gaps(docs, "text", whole).count() == 0
    wrong = whole.where("word <> 'one '").union(spark.createDataFrame([("x", 9, 9)], "word string, row_start bigint, row_end bigint"))
    assert sorted(map(tuple, verify.word_gaps(docs, "text", wrong).collect())) == [("one ", 1), ("x", 9)]
