"""Typing, profiles, quality and charts on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from washline.operators import charts, counts, encode, profile, quality, typing
from washline.operators import rows as row_ops
from washline.functions.columns import ROLE


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "Ann", 25.0, "x"), (2, "Bob", 30.0, "x"), (3, None, float("nan"), "x"), (4, "Ann", None, None)],
        "id int, first string, age double, same string",
    )


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_profile(people):
    rows = by_column(profile.profile(people))
    assert [r["position"] for r in rows.values()] is not None and len(rows) == 4
    age = rows["age"]
    assert (age["non_null"], age["nulls"], age["min"], age["max"], age["mean"]) == (2, 2, 25, 30, 27.5)
    assert rows["first"]["unique_count"] == 2 and rows["first"]["sample_unique"] == ["Ann", "Bob"]
    assert rows["id"]["unique_count"] is None and rows["id"]["sample_unique"] is None


def test_profile_preview_is_bounded(spark):
    df = spark.range(500).selectExpr("concat('v', lpad(id, 3, '0')) AS s")
    row = profile.profile(df).first()
    assert row["sample_unique"] == [f"v{i:03d}" for i in range(50)] and row["unique_count"] == 500


def test_profile_keeps_nested_columns(spark):
    df = spark.sql("SELECT 1 AS a, array(1, 2) AS xs, map('k', 1) AS m UNION ALL SELECT 2, NULL, NULL")
    rows = by_column(profile.profile(df))
    assert rows["xs"]["nulls"] == 1 and rows["m"]["non_null"] == 1 and rows["xs"]["unique_count"] is None


def test_approximate_profile(people):
    assert by_column(profile.profile(people, approx=True))["first"]["unique_count"] == 2


def test_long_texts_are_counted_by_digest(spark):
    df = spark.createDataFrame([("a" * 200,), ("a" * 200,), ("a" * 199 + "b",), ("short",), (None,)], "t string")
    assert by_column(profile.profile(df))["t"]["unique_count"] == 3


def test_samples(spark):
    df = spark.range(1000).selectExpr("id", "IF(id % 2 = 0, repeat('x', 400), NULL) AS t")
    rows = profile.column_samples(df, rows=5).collect()
    assert sorted(r["column"] for r in rows) == ["id"] * 5 + ["t"] * 5
    assert all(r["value"] == "x" * 300 + "..." for r in rows if r["column"] == "t")
    again = profile.column_samples(df, rows=5).collect()
    assert sorted(rows) == sorted(again)


def test_overview_counts_copies(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "b")], "a int, b string")
    row = profile.overview(df).first().asDict()
    assert (row["total_rows"], row["missing_values"], row["duplicate_rows"]) == (4, 3, 2)
    assert row["missing_percentage"] == 37.5


def test_overview_of_nothing(spark):
    row = profile.overview(spark.createDataFrame([], "a int")).first()
    assert row["total_rows"] == 0 and row["missing_percentage"] == 0


@pytest.mark.parametrize("data,score,grade", [
    ([(i, i) for i in range(100)], 100, "Excellent"),
    ([(i, None) for i in range(100)], 70, "Good"),
    ([(1, None)] * 100, 55, "Fair"),
])
def test_quality(spark, data, score, grade):
    row = quality.quality(spark.createDataFrame(data, "a int, b int")).first()
    assert (row["quality_score"], row["assessment"]) == (score, grade)


def test_recommendations_good(spark):
    df = spark.createDataFrame([(i % 10, "s") for i in range(100)], "a int, s string")
    assert [r["rule"] for r in quality.recommendations(df).collect()] == ["good_condition"]
    assert quality.recommendation_text(quality.recommendations(df)).first()["text"].startswith("Dataset appears")


def test_value_counts_of_several_columns(people):
    got = {
        (r["column"], r["v0"]): r["n"]
        for r in counts.value_counts(people, ["first", "same"], with_missing=True).collect()
    }
    assert got == {
        ("first", "Ann"): 2, ("first", "Bob"): 1, ("first", None): 1, ("same", "x"): 3, ("same", None): 1}


def test_modes_take_the_smaller_of_a_tie(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("a", 1), ("b", 1), (None, None), (None, None)], "s string, i int")
    assert counts.modes(df, ["s", "i"]) == {"s": "a", "i": 1}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i), 5) for i in range(31)] + [(None, None)], "x double, k int")
    rows = charts.histogram(df).collect()
    x = {r["bin"]: r["n"] for r in rows if r["column"] == "x"}
    assert sum(x.values()) == 31 and x[30] == 2 and min(x) == 1
    assert [(r["bin"], r["n"], r["low"], r["high"]) for r in rows if r["column"] == "k"] == [(1, 31, 5.0, 5.0)]


def test_correlation_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, None, 1.0)], "a double, b double, k double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in charts.correlations(df).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "k"] == 0 and got["k", "k"] == 0 and len(got) == 9


def test_missing_counts_count_missing_only(people):
    assert {r["column"]: r["missing"] for r in charts.missing_counts(people).collect()} == {
        "id": 0, "first": 1, "age": 2, "same": 1}


def test_repair_run_together(spark):
    df = spark.createDataFrame([("Male" * 30, "ok"), ("zzz", "ok"), (None, "ok"), ("", "ok")], "g string, s string")
    assert [r["g"] for r in charts.repair_run_together(df).collect()] == ["Male", "zzz", None, ""]
    loose = spark.createDataFrame([("female" * 30,), ("y" * 50,)], "g string")
    assert [r["g"] for r in charts.repair_run_together_loose(loose).collect()] == ["Male", "y" * 20]


def test_identifiers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Row ID` int, user_id int, idle int, `a.name` int")
    assert typing.identifier_columns(df) == ["Row ID", "user_id", "a.name"]
    assert typing.drop_identifiers(df).columns == ["idle"]


def test_one_hot_rows_sum_to_one(spark):
    df = spark.createDataFrame([("a.b",), ("c d",), (None,)], "`x.y` string")
    out = encode.encode(df, keep_original=False)
    assert out.columns == ["x.y_a.b", "x.y_c d", "x.y_nan"]
    assert [sum(r) for r in out.collect()] == [1, 1, 1]
    assert all(f.metadata[ROLE] == "onehot" for f in out.schema)


def test_one_hot_refuses_too_many(spark):
    with pytest.raises(encode.TooManyCategories):
        encode.encode(spark.range(50).selectExpr("concat('v', id) AS s"), max_categories=49)


def test_many_labels_match_few_labels(spark, monkeypatch):
    df = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('v', id % 900) END AS s")
    for order in ("sorted", "frequency"):
        few = encode.encode(df, "s", "label", order=order).select("id", "s_encoded")
        with monkeypatch.context() as limits:
            limits.setattr(encode, "MAX_DRIVER_LABELS", 5)
            many = encode.encode(df, "s", "label", order=order).select("id", "s_encoded")
        assert sorted(few.collect()) == sorted(many.collect())


def test_encoding_metadata(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert encode.encoding_metadata(encode.fit_encode(df, keep_original=False)) == [
        {"column": "s", "method": "onehot", "new_columns": ["s_a", "s_b"], "removed": True}]


def test_repeated_names(spark):
    df = spark.range(1).selectExpr("1 AS a", "2 AS b", "3 AS a")
    assert row_ops.drop_repeated_names(df).first().asDict() == {"a": 1, "b": 2}


def test_comparison_flags(spark):
    before = spark.createDataFrame([(1.0,), (2.0,), (None,), (100.0,)], "x double")
    after = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double")
    row = quality.compare(before, after).first()
    assert row["missing_reduced"] == 1 and row["outliers_handled"] and row["change_count"] == 1
    assert row["before_median"] == 2 and row["after_median"] == 2


def test_normal_quantiles_bound(people):
    with pytest.raises(ValueError, match="between"):
        charts.normal_quantiles(people, "age", points=101)


def test_normal_quantiles_middle(spark):
    df = spark.range(101).selectExpr("double(id) AS x")
    middle = charts.normal_quantiles(df, points=3).where("p = 0.5").first()
    assert middle["theoretical"] == pytest.approx(0) and middle["observed"] == 50


def test_binary(spark):
    df = spark.createDataFrame([(0, 1.0, 2), (1, None, 3)], "a int, b double, c int")
    assert typing.binary_columns(df) == ["a", "b"]


def test_short_categories(spark):
    df = spark.range(100).selectExpr("concat('v', id % 3) AS few", "concat('v', id) AS many")
    assert typing.short_categorical_columns(df) == ["few"]


def test_vector_width_and_slots(spark):
    from pyspark.ml.functions import vector_to_array
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "s string")
    out = encode.encode_vector(df, "s").select("s", vector_to_array("s_onehot").alias("v")).collect()
    assert {r["s"]: list(r["v"]) for r in out}["b"][0] == 1.0
    assert [list(r["v"]) for r in out if r["s"] is None][0][-1] == 1.0


def test_top_categories_label_missing(people):
    rows = charts.top_categories(people, "same").orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in rows] == [("x", 3), ("<NULL>", 1)]


def test_samples_keep_order_of_hash(people):
    assert profile.column_samples(people, names=["id"]).agg(F.count("*")).first()[0] == 4


def test_overview_of_nested_rows(spark):
    df = spark.sql("SELECT map('a', 1) AS m, array(1) AS xs UNION ALL SELECT map('a', 1), array(1) UNION ALL SELECT NULL, array()")
    row = profile.overview(df).first()
    assert (row["duplicate_rows"], row["missing_values"]) == (1, 1)
