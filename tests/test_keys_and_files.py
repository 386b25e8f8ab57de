"""Lossless keys of rows, and CSV files in every kind of line ends, read in parts."""

import csv
import datetime as dt
import io as text_io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from washline.operators import profile, rows
from washline.sources import csvlines
from washline.sources import tables as io


# keys

def test_nested_values_that_look_alike_are_kept_apart(spark):
    moments = spark.sql(
        "SELECT * FROM VALUES (array(timestamp'2024-01-01 00:00:00.000001')), "
        "(array(timestamp'2024-01-01 00:00:00.000002')), (array(timestamp'2024-01-01 00:00:00.000001')) AS t(a)"
    )
    assert rows.deduplicate(moments).count() == 2
    assert profile.overview(moments).first()["duplicate_rows"] == 1
    texts = spark.sql(
        "SELECT array('a', 'b') AS a, 'c' AS b UNION ALL SELECT array('a'), 'b' UNION ALL SELECT array('a,b'), 'c' "
        "UNION ALL SELECT array('a', NULL), 'c' UNION ALL SELECT array('a', ''), 'c' UNION ALL SELECT array(), '' "
        "UNION ALL SELECT NULL, '' UNION ALL SELECT array(), NULL"
    )
    assert rows.deduplicate(texts).count() == 8
    assert rows.deduplicate(texts, keep=False).count() == 8


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "UTC"])
def test_instants_that_read_alike_on_a_clock(spark, zone):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", zone)
    hours = session.range(48).select(F.timestamp_micros(F.lit(1_729_900_000_000_000) + F.col("id") * 3_600_000_000).alias("t"))
    nested = hours.select("t", F.struct("t", F.array("t")).alias("s"))
    assert rows.deduplicate(nested.union(nested)).count() == 48
    assert rows.deduplicate(hours.union(hours), keep=False).count() == 0
    assert profile.overview(hours).first()["duplicate_rows"] == 0


def test_equal_values_of_any_type_share_a_key(spark):
    equal = [
        ("map('a', 1, 'b', 2)", "map('b', 2, 'a', 1)"), ("array(0.0D)", "array(-0.0D)"),
        ("array(double('nan'))", "array(double('nan'))"), ("struct(map(1, array(1)))", "struct(map(1, array(1)))"),
        ("X'00FF'", "X'00FF'"), ("interval '25' hour", "interval '1 01' day to hour"), ("0.0F", "-0.0F"),
    ]
    for a, b in equal:
        assert rows.deduplicate(spark.sql(f"SELECT {a} AS v, 1 AS w UNION ALL SELECT {b}, 1")).count() == 1, a
    differ = [
        ("map('a', 1)", "map('a', 2)"), ("map('a', CAST(NULL AS INT))", "map('a', 0)"), ("X'00'", "X'0000'"),
        ("array(array(1), array())", "array(array(), array(1))"), ("1.1D", "1.1000000000000003D"),
        ("struct('1', CAST(NULL AS STRING))", "struct('1', '')"), ("interval '1' second", "interval '1.000001' second"),
        ("timestamp_ntz'2024-03-31 02:30:00'", "timestamp_ntz'2024-03-31 03:30:00'"), ("date'2024-01-01'", "date'2024-01-02'"),
    ]
    for a, b in differ:
        assert rows.deduplicate(spark.sql(f"SELECT {a} AS v, 1 AS w UNION ALL SELECT {b}, 1")).count() == 2, a


# CSV

def plain_ends(line, inside):
    """Whether a line ends inside quotes, a character at a time."""
    i, n = 0, len(line)
    while True:
        if not inside:
            if i < n and line[i] == '"':
                inside, i = True, i + 1
                continue
        else:
            while i < n:
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        i += 2
                        continue
                    break
                i += 1
            if i >= n:
                return True
            i += 1
        at = line.find(",", i)
        if at < 0:
            return False
        inside, i = False, at + 1


@settings(max_examples=2000, deadline=None)
@given(st.text(st.sampled_from('",ab'), max_size=14))
def test_what_a_line_does_to_quotes(line):
    assert csvlines.step(line.encode()) == (plain_ends(line, False), plain_ends(line, True))


def test_long_lines_do_not_exhaust_the_stack():
    assert csvlines.step(b'"' + b'a""' * 200_000) == (True, False)
    assert csvlines.step(b'"a",' * 200_000) == (False, False)


def some_rows(seed, many):
    rng = random.Random(seed)
    parts = ["a", "é", ",", '"', '""', "\n", "\r", "\r\n", " ", "x y", "漢字", "''", "1"]
    return [
        (i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) or None, rng.choice(["p", "q,", 'say "so"', ""]), i / 4)
        for i in range(many)
    ]


def as_csv(data, end, names=("n", "text", "kind", "x")):
    out = text_io.StringIO()
    writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    writer.writerow(names)
    for row in data:
        fields = ["" if v is None else v for v in row]
        writer.writerow(fields)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("part", [37, 400, 100_000])
def test_csv_in_parts(spark, tmp_path, end, part):
    data = some_rows(part, 120 if part < 100 else 600)
    path = tmp_path / "table.csv"
    path.write_bytes(as_csv(data, end).encode())
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(part))
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    df = io.read_table(session, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "string", "string", "double"]
    found = sorted(tuple(r) for r in df.collect())
    assert found == [(n, t, k or None, x) for n, t, k, x in data]
    if part < 1000:
        assert len(csvlines.lines_of(session, str(path)).groupBy("block").count().collect()) > 5


def test_csv_line_ends_mixed_marked_blank_and_without_last(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    path.write_bytes('﻿a,b\r\n1,x\n\n2,"y\r\nz"\r\n\r\n3,5" pipe\n4,\r\n5,""'.encode())
    for multiline, middle in [(True, "y\r\nz")]:
        df = io.read_table(spark, str(path), multiline=multiline)
        assert df.columns == ["a", "b"]
        assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, middle), (3, '5" pipe'), (4, None), (5, "")]
    plain = tmp_path / "plain.csv"
    plain.write_bytes(b"a,b\r\n1,2\r\n3,4\r\n")
    for multiline in (True, False):
        df = io.read_table(spark, str(plain), multiline=multiline)
        assert (df.columns, sorted(map(tuple, df.collect()))) == (["a", "b"], [(1, 2), (3, 4)])
        assert [f.dataType.simpleString() for f in df.schema] == ["int", "int"]


def test_csv_folders_headers_and_schemas(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.csv").write_text(as_csv([(i, "a\nb", None, dt.date(2024, 1, i + 1))], "\n", ("n", 'the "x",\ny', "n", "when")))
    df = io.read_table(spark, str(folder))
    assert df.columns == ["n0", 'the "x",\ny', "n2", "when"]
    assert sorted(tuple(r) for r in df.collect()) == [(i, "a\nb", None, dt.date(2024, 1, i + 1)) for i in range(3)]
    named = io.read_table(spark, str(folder), schema="p string, q string, r int, s string")
    assert sorted(tuple(r) for r in named.collect()) == [(str(i), "a\nb", None, f"2024-01-0{i + 1}") for i in range(3)]
    empty = tmp_path / "empty.csv"
    empty.write_bytes(b"")
    assert io.read_table(spark, str(empty)).columns == []
    only = tmp_path / "only.csv"
    only.write_bytes(b"a,b\r\n")
    assert (io.read_table(spark, str(only)).columns, io.read_table(spark, str(only)).count()) == (["a", "b"], 0)


def test_reading_options_of_a_whole_run(spark, tmp_path):
    from washline.plans.run import clean

    path = tmp_path / "t.csv"
    path.write_bytes(b"n,x\r\n1,2\r\n,3\r\n5,4\r\n")
    result = clean(spark, str(path), read={"multiline": False, "schema": "n double, x int"})
    assert [f.dataType.simpleString() for f in result.original.schema] == ["double", "int"]
    assert result.df.where("n IS NULL").count() == 0
