"""Sizes must not change answers: wide tables, both paths of an operator, texts in files."""

from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from washline.operators import charts, counts, dates, encode, impute, profile, quantiles, quality, ranges, rows, textcols
from washline.sources import tables as io


@pytest.fixture(scope="module")
def wide(spark):
    texts = [F.concat(F.lit("v"), (F.col("id") % (i % 7 + 2))).alias(f"t{i}") for i in range(200)]
    return spark.range(60).select(*texts).cache()


def test_two_hundred_text_columns(wide):
    found = {r["column"]: r for r in profile.profile(wide).collect()}
    assert len(found) == 200 and all(found[f"t{i}"]["unique_count"] == i % 7 + 2 for i in range(200))
    assert counts.modes(wide, wide.columns) == {f"t{i}": "v0" for i in range(200)}
    assert charts.top_categories(wide, wide.columns, k=1).count() == 200
    assert len(encode.encode(wide, keep_original=False).columns) == sum(i % 7 + 2 for i in range(200))
    some = wide.withColumn("t199", F.when(F.col("t199") != "v1", F.col("t199")))
    assert impute.impute(some, strategy="mode").where("t199 is null").count() == 0


@pytest.mark.parametrize("k", [3, 1000, 1001])
def test_top_values_are_cut_before_the_shuffle(spark, k):
    df = spark.range(5000).select((F.col("id") % 1700).cast("string").alias("s"))
    top = counts.top_counts(df, ["s"], k)
    got = [(r["v0"], r["n"]) for r in top.orderBy("rank").collect()]
    whole = df.groupBy("s").count().orderBy(F.desc("count"), "s").limit(k).collect()
    assert got == [(r["s"], r["count"]) for r in whole]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString() or "__part" in top._jdf.queryExecution().toString()


@pytest.mark.parametrize("order", ["sorted", "frequency"])
def test_fitted_codes_are_the_same_at_every_size(spark, order, monkeypatch):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",), (None,)], "s string")
    new = spark.createDataFrame([("c",), ("d",), ("z",), (None,)], "s string")
    got = []
    for limit in (10_000, 0):
        monkeypatch.setattr(encode, "MAX_DRIVER_LABELS", limit)
        monkeypatch.setattr(encode, "AUTO_ONE_HOT", 0)
        params = encode.fit_encode(df, "s", "label", keep_original=True, order=order)
        assert ("codes" in params["s"]) == (limit == 0)
        out = encode.apply_encode(new, params)
        got.append({r["s"]: r["s_encoded"] for r in out.collect()})
    assert got[0] == got[1]
    assert got[0] == ({"c": 2, "d": 3, "z": 4, None: 4} if order == "sorted" else {"c": 3, "d": 0, "z": 4, None: 4})


def test_fitted_codes_apply_to_a_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(encode, "MAX_DRIVER_LABELS", 0)
    monkeypatch.setattr(encode, "AUTO_ONE_HOT", 0)
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    params = encode.fit_encode(df, "s", "label", keep_original=False)
    df.union(spark.createDataFrame([("z",)], "s string")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string").parquet(str(tmp_path / "in"))
    query = encode.apply_encode(stream, params).writeStream.format("memory").queryName("coded").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["s"] for r in spark.table("coded").collect()) == [0, 1, 2]


@pytest.mark.parametrize("data", [[float("-inf"), float("-inf"), 1.0, 2.0], [1.0, 2.0, float("inf"), float("inf")],
                                  [float("-inf"), float("inf")], [5.0, 1.0, 1.0, 9.0, 2.5]])
def test_quantiles_do_not_depend_on_the_path(spark, data):
    df = spark.createDataFrame([(x,) for x in data], "x double")
    points = [0.0, 0.25, 0.5, 0.6, 1.0]
    direct = quantiles.quantiles(df, {"x": points})
    bracketed = quantiles.quantiles(df, {"x": points}, small=0, fetch=1)
    assert repr(direct) == repr(bracketed)


def test_bounds_tell_long_common_starts_apart(spark):
    df = spark.range(64).select(F.concat(F.lit("x" * 300), F.lpad(F.col("id").cast("string"), 3, "0")).alias("k"))
    bucket = ranges.ordered_buckets(df, ["k"], buckets=8)
    assert df.select(bucket.alias("b")).distinct().count() >= 6


TEXTS = ['say "hi", ok', "", None, "a\nb\r\nc", "x\ry", "  pad ", '"', '\\"q\\', ",", "tail\\", "\n", "#c"]


@pytest.mark.parametrize("single", [False, True])
def test_csv_keeps_texts(spark, tmp_path, single):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    path = str(tmp_path / "t.csv")
    io.write_table(df, path, single_file=single)
    assert (tmp_path / "t.csv").is_file() == single
    back = io.read_table(spark, path)
    assert back.dtypes == [("i", "int"), ("t", "string")]
    assert dict(back.collect()) == dict(enumerate(TEXTS))


def test_csv_of_other_tools(spark, tmp_path):
    (tmp_path / "o.csv").write_text('a,b\n1,"say ""hi"", ok"\n2,\n3,""\n4,"two\nlines"\n')
    got = dict(io.read_table(spark, str(tmp_path / "o.csv")).collect())
    assert got == {1: 'say "hi", ok', 2: None, 3: "", 4: "two\nlines"}


@pytest.mark.parametrize("format", ["json", "parquet"])
def test_single_files(spark, tmp_path, format):
    path = tmp_path / f"t.{format}"
    io.write_table(spark.range(10), str(path), single_file=True)
    assert path.is_file() and io.read_table(spark, str(path)).count() == 10


def test_json_kind_is_told_by_the_ends_of_a_line(spark, tmp_path):
    (tmp_path / "a.json").write_text("[" + ",".join('{"x": %d}' % i for i in range(500)) + "]")
    (tmp_path / "l.json").write_text("\n \n" + "\n".join('{"x": %d}' % i for i in range(5)))
    assert io.read_table(spark, str(tmp_path / "a.json")).count() == 500
    assert io.read_table(spark, str(tmp_path / "l.json")).count() == 5


def test_lemma_join_keeps_rows_with_equal_keys_apart(spark):
    df = spark.createDataFrame([(1, "dogs  run"), (1, "cats sit"), (1, None), (2, "")], "key int, t string")
    lemmas = spark.createDataFrame(
        [("dogs", "dog"), ("cats", "cat"), ("cats", "kat"), ("run", "run"), (None, "x")], "word string, lemma string")
    both = [
        sorted(map(str, textcols.lemmatize(df, "t", lemmas, gate=False, max_broadcast=n).collect()))
        for n in (100, 0)
    ]
    assert both[0] == both[1]
    tokens = df.withColumn("ws", F.split("t", " +"))
    both = [
        sorted(map(str, textcols.lemmatize_words(tokens, "ws", lemmas, max_broadcast=n).collect()))
        for n in (100, 0)
    ]
    assert both[0] == both[1]


def test_numbers_called_dates_are_left_alone(spark):
    df = spark.createDataFrame([(1.5, "2024-01-02")], "candidate_score double, signup_date string")
    out = dates.handle_datetime(df)
    assert "candidate_score" in out.columns and out.first()["signup_date_year"] == 2024
    named = spark.createDataFrame([(86400.0,)], "at_time double")
    assert dates.handle_datetime(named, "at_time").first()["at_time_day"] == 2


def test_duplicates_of_rows_with_maps(spark):
    df = spark.createDataFrame(
        [(1, {"a": 1}, 0.0), (1, {"a": 1}, -0.0), (2, {"a": 1}, 1.0), (3, None, None)], "i int, m map<string,int>, x double")
    assert rows.deduplicate(df).count() == 3
    alone = rows.deduplicate(df, keep=False)
    assert sorted(r["i"] for r in alone.collect()) == [2, 3]
    assert "SortAggregate" not in alone._jdf.queryExecution().toString()


def test_high_cardinality_is_one_sentence(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("b"), F.concat(F.lit("x"), "id").alias("a"))
    texts = [r["text"] for r in quality.recommendation_text(quality.recommendations(df)).collect()]
    assert texts == ["Consider feature engineering for high-cardinality columns: ['a', 'b']"]


def test_correlations_of_sixty_columns(spark):
    df = spark.range(40).select(*[
        F.when(F.col("id") % (i + 2) != 0, F.sin(F.col("id") * (i + 1)) + 1e6).alias(f"c{i}") for i in range(58)
    ], F.lit(0.1).alias("flat"), F.lit(None).cast("double").alias("empty"))
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in charts.correlations(df).collect()}
    frame = df.toPandas()
    want = frame.corr(min_periods=2).fillna(0.0)
    assert len(got) == 3600
    for (a, b), value in got.items():
        if a not in ("flat", "empty") and b not in ("flat", "empty"):
            assert value == pytest.approx(want.loc[a, b], abs=1e-6)
        else:
            assert value == 0.0


@pytest.mark.parametrize("own", [None, "65535", "4000"])
def test_rows_of_correlations_are_made_by_methods_that_are_compiled(spark, monkeypatch, own):
    name, held = "spark.sql.codegen.hugeMethodLimit", []
    plain = charts.stored
    monkeypatch.setattr(charts, "stored", lambda parts: held.append(int(spark.conf.get(name))) or plain(parts))
    values = [F.when((F.col("id") + i) % (5 + i % 9) != 0, (F.col("id") * (i + 1)).cast("double") + i) for i in range(60)]
    df = spark.range(50).select(*[c.alias(f"c{i}") for i, c in enumerate(values)])
    before = spark.conf.get(name, None)
    try:
        if own is not None:
            spark.conf.set(name, own)
        found = charts.correlations(df)
        assert spark.conf.get(name, None) == (before if own is None else own)
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            charts.correlations(df.select((F.lit(1) / (F.col("c0") - 1)).alias("broken")))
        assert spark.conf.get(name, None) == (before if own is None else own)
    finally:
        spark.conf.unset(name)
    assert held[0] == min(8000, int(own or 8000)) and found.count() == 3600
    assert all(r["corr"] == pytest.approx(1) for r in found.collect())


def test_correlations_of_every_kind_of_number(spark):
    rows = [(1, 2.0, Decimal("1.5"), 3.0), (2, float("nan"), Decimal("0.5"), 1.0), (None, 1.0, None, None),
            (4, 5.0, Decimal("2.5"), 0.5), (5, None, Decimal("4.0"), float("nan")), (7, 4.0, Decimal("1.0"), 2.0)]
    df = spark.createDataFrame(rows, "i int, d double, m decimal(5, 2), f float").repartition(3)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in charts.correlations(df).collect()}
    want = pd.DataFrame([[None if x is None else float(x) for x in r] for r in rows], columns=list("idmf")).corr(min_periods=2)
    assert len(got) == 16
    for (a, b), value in got.items():
        assert value == pytest.approx(want.loc[a, b], abs=1e-9)
    assert charts.correlations(df.limit(0)).where("corr = 0").count() == 16
    assert charts.correlations(df.select(F.lit("x").alias("s"))).count() == 0


def test_wide_rows_make_more_buckets(spark, monkeypatch):
    df = spark.range(40).select("id", F.repeat(F.lit("x"), 5000).alias("t"))
    assert ranges.ordered_buckets(df, ["id"]) is None
    monkeypatch.setattr(ranges, "BYTES_PER_BUCKET", 50_000)
    bucket = ranges.ordered_buckets(df, ["id"])
    assert 3 <= df.select(bucket.alias("b")).distinct().count() <= 5
    filled = impute.ordered_fill(df.withColumn("v", F.when(F.col("id") % 10 == 0, F.col("id"))), ["v"], "id")
    assert all(r["v"] == r["id"] // 10 * 10 for r in filled.collect())


def test_joined_lemmas_send_each_word_of_a_row_once(spark, monkeypatch):
    sent = []
    plain = textcols.join_by_value
    monkeypatch.setattr(textcols, "join_by_value", lambda df, *rest: sent.append(df.count()) or plain(df, *rest))
    df = spark.createDataFrame([(1, "cats and dogs and cats " * 50), (1, ""), (None, None), (2, "cats run")], "k int, t string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("run", "run")], "word string, lemma string")
    done = textcols.lemmatize(df, "t", lemmas, gate=False, max_broadcast=0).collect()
    assert sorted(map(str, done)) == sorted(map(str, spark.createDataFrame(
        [(1, " ".join(["cat and dog and cat"] * 50)), (1, ""), (None, None), (2, "cat run")], df.schema).collect()))
    assert sent == [5]


def test_distinct_numbers_are_sent_once_a_task(spark, monkeypatch):
    """Kinds of numbers, both zeros, missing values; several parts, and parts sent before the end of a task."""
    monkeypatch.setattr(counts, "value_counts", None)  # one row for each value of the table
    df = spark.range(3000, numPartitions=3).selectExpr(
        "id", "CAST(id % 7 AS FLOAT) AS f", "CASE WHEN id % 3 = 0 THEN double('NaN') WHEN id % 3 = 1 THEN -0.0D ELSE 0.0D END AS z",
        "IF(id % 2 = 0, NULL, CAST(id % 90 AS SMALLINT)) AS s", "concat('t', id % 11) AS t", "CAST(NULL AS DOUBLE) AS e",
        "concat(repeat('x', 70), id % 5) AS long")
    want = {"id": 3000, "f": 7, "z": 1, "s": 45, "t": 11, "e": 0, "long": 5}
    assert counts.distinct_counts(df, df.columns) == want
    for name, value in (("ROWS_PER_PART", 100), ("HELD", 50), ("HELD_TEXTS", 3)):
        monkeypatch.setattr(counts, name, value)
    assert counts.distinct_counts(df, df.columns) == want


def test_moments_of_many_columns_are_those_of_few(spark):
    cells = ["id * {i} + 0.5 AS c{i}", "IF(id % 4 = 0, NULL, id - {i}) AS c{i}", "IF(id = 3, double('NaN'), 1e3D + id * 1e-3D) AS c{i}",
             "CAST(NULL AS INT) AS c{i}", "IF(id = {i}, 7.0D, NULL) AS c{i}"]
    df = spark.range(500).selectExpr(*[cells[i % 5].format(i=i) for i in range(30)], "CAST(id AS STRING) AS t")
    few = profile.statistics(df, df.columns, profile._basics)
    many = profile.basic_statistics(df)
    for n in df.columns:
        for k, value in few[n].items():
            assert many[n][k] == (value if value is None else pytest.approx(value, rel=1e-9)), (n, k)


ODD_CELLS = [
    "CAST(id AS DOUBLE) * 0.5 - 40", "IF(id % 3 = 0, double('NaN'), IF(id % 2 = 0, -0.0D, 0.0D))", "CAST(NULL AS DOUBLE)",
    "IF(id % 50 = 0, double('Infinity'), id % 9)", "IF(id < 2, 9007199254740992L + id, id)", "IF(id % 4 = 0, NULL, CAST(id % 7 AS SMALLINT))",
    "CAST(id % 11 AS FLOAT) / 3", "CAST(id AS DECIMAL(20, 2)) / 8", "7", "IF(id = 5, 2.5D, NULL)",
]
ODD_TEXTS = [
    "concat('t', id % 13)", "IF(id % 3 = 0, NULL, '')", "CAST(NULL AS STRING)", "concat(repeat('é', 200), id % 5)",
    "concat('\\u00fe', '\\u00ff', char(0), id % 4)", "IF(id % 2 = 0, 'null', NULL)", "CAST(id AS STRING)",
]


def _wide(spark, texts=ODD_TEXTS, numbers=ODD_CELLS):
    cells = [f"{e} AS n{i}_{k}" for k in range(3) for i, e in enumerate(numbers)]
    cells += [f"{e} AS t{i}_{k}" for k in range(4) for i, e in enumerate(texts)]
    return spark.range(400, numPartitions=3).selectExpr(*cells, "id % 2 = 0 AS flag", "date_add(DATE'2020-01-01', CAST(id % 3 AS INT)) AS day")


def _analysed(df):
    return {r["column"]: tuple(None if x is None or x != x else x for x in r[2:]) for r in profile.column_analysis(df).collect()}


@pytest.mark.parametrize("small", [False, True])
def test_analysis_of_many_columns_is_that_of_few(spark, monkeypatch, small):
    """Columns held whole, and sent in many parts before the end of a task."""
    df = _wide(spark)
    few = _analysed(df.select(*[c for c in df.columns if c.endswith("_0")], "flag", "day"))
    for name, value in (("ROWS_PER_PART", 100), ("HELD", 500), ("HELD_TEXTS", 30)) if small else ():
        monkeypatch.setattr(counts, name, value)
    many = _analysed(df)
    assert set(many) == set(df.columns)
    for name, own in many.items():
        want = few.get(name, few.get(name[:-1] + "0"))
        assert own == tuple(pytest.approx(x, rel=1e-9) if isinstance(x, float) else x for x in want), name


def test_analysis_of_many_columns_scans_a_few_times(spark):
    """The number of rows, both halves of the numbers, all of the texts, and the values around the medians."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(400).mapInArrow(counted, "id long").selectExpr(
        *[f"id * {i} + 0.5D AS c{i}" for i in range(30)], *[f"concat(id, '-', {i}) AS t{i}" for i in range(30)])
    found = profile.column_analysis(df).collect()
    assert {(r["unique_count"], r["median"]) for r in found if r["column"] in ("c2", "t2")} == {(400, 399.5), (400, None)}
    assert read.value <= 5 * 400


def test_analysis_of_many_columns_without_rows(spark):
    df = _wide(spark).where("flag IS NULL")
    assert {(x[1], x[2], x[4], *x[6:]) for x in _analysed(df).values()} == {(0, 0, 0, *[None] * 5)}


def test_texts_that_are_not_utf8_are_counted(spark):
    cells = [f"CAST(unhex(concat('61', IF(id % 3 = 0, 'FF', 'FE'), hex(id % {i + 2}))) AS STRING) AS t{i}" for i in range(25)]
    df = spark.range(60).selectExpr(*cells)
    want = df.selectExpr(*[f"count(DISTINCT t{i})" for i in range(25)]).first()
    assert [r["unique_count"] for r in profile.column_analysis(df).collect()] == list(want)
    assert [r["non_null"] for r in profile.column_analysis(df).collect()] == [60] * 25


def test_heavy_and_wide_intervals_are_cut_further(spark, monkeypatch):
    """Intervals of a first scan that are too large to fetch, beside others that are not."""
    monkeypatch.setattr(quantiles, "FETCH", 20)
    monkeypatch.setattr(quantiles, "FETCH_MOST", 20)
    monkeypatch.setattr(quantiles, "HELD", 10)
    df = _wide(spark)
    few = {r["column"]: r["median"] for r in profile.column_analysis(df.select(*df.columns[:10])).collect()}
    many = {r["column"]: r["median"] for r in profile.column_analysis(df).collect()}
    assert {n: many[n] for n in few} == few
