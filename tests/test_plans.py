"""Plans: suggestion, order, guards, running, re-use and whole runs; sources and sinks."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from washline.operators import dates, encode
from washline.plans import run, suggest
from washline.sources import tables as io
from washline.streaming.apply import clean_stream

PEOPLE = "id,name,age,salary,department\n1,Ann,25,50000,A\n2,Bob,30,60000,B\n3,,35,70000,A\n4,Dan,,80000,B\n5,Eve,45,90000,A\n"


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "people.CSV"
    path.write_text(PEOPLE)
    return str(path)


def test_read_csv(spark, csv_file):
    df = io.read_table(spark, csv_file)
    assert dict(df.dtypes) == {
        "id": "int", "name": "string", "age": "int", "salary": "int", "department": "string"}
    assert df.count() == 5


def test_read_csv_with_schema(spark, csv_file):
    df = io.read_table(spark, csv_file, schema="id bigint, name string, age double, salary double, department string")
    assert df.schema["id"].dataType.simpleString() == "bigint"


def test_read_json_shapes(spark, tmp_path):
    users = [{"id": 1, "name": "a", "active": True}, {"id": 2, "name": "b", "active": None}]
    lines, array, nested = tmp_path / "l.json", tmp_path / "a.json", tmp_path / "n.json"
    lines.write_text("\n".join(json.dumps(u) for u in users))
    array.write_text(json.dumps(users, indent=1))
    nested.write_text(json.dumps({"users": users, "metadata": {"version": "1"}}, indent=1))
    assert io.read_table(spark, str(lines)).count() == 2
    assert sorted(io.read_table(spark, str(array)).columns) == ["active", "id", "name"]
    assert io.read_table(spark, str(nested)).select(F.size("users")).first()[0] == 2


@pytest.mark.parametrize("path", ["a.txt", "folder", "a.csv.gz"])
def test_unknown_ending(path):
    with pytest.raises(ValueError, match="unsupported"):
        io.detect_format(path)


@pytest.mark.parametrize("ending", ["csv", "json", "parquet"])
def test_write_and_read_back(spark, csv_file, tmp_path, ending):
    df = io.read_table(spark, csv_file)
    path = str(tmp_path / f"out.{ending}")
    io.write_table(df, path, single_file=True)
    back = io.read_table(spark, path).select(*df.columns)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_write_expands_vectors_and_joins_arrays(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("b", None)], "s string, words array<string>")
    path = str(tmp_path / "v.csv")
    io.write_table(encode.encode_vector(df, "s"), path)
    back = io.read_table(spark, path)
    assert back.columns == ["s", "words", "s_onehot_0", "s_onehot_1", "s_onehot_2"]
    assert {r["words"] for r in back.collect()} == {"x y", "", None}  # an empty array is an empty text


def test_snapshot_preview_and_pandas(spark, tmp_path):
    df = io.from_pandas(spark, pd.DataFrame({"a": range(20)}))
    stored, shape = io.snapshot(df, str(tmp_path), "initial")
    assert (shape["step"], shape["rows"], shape["columns"]) == ("initial", 20, 1)
    assert [r["a"] for r in io.preview(stored, 3, "a").collect()] == [0, 1, 2]


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-03 04:05:06",), ("02/03/2024",), ("never",), (None,)], "when_date string")
    out = dates.handle_datetime(df, keep_original=True).collect()
    assert out[0].asDict() == {
        "when_date": "2024-02-03 04:05:06", "when_date_year": 2024, "when_date_month": 2, "when_date_day": 3,
        "when_date_weekday": 5, "when_date_hour": 4}
    assert out[1]["when_date_day"] == 3 and out[2]["when_date_year"] is None
    one = dates.handle_datetime(df, "when_date", formats=["dd/MM/yyyy"]).collect()
    assert one[1]["when_date_month"] == 3 and one[0]["when_date_month"] is None


def test_order_and_waves(spark):
    plan = suggest.make_plan(spark, [
        {"column": "a", "operation": "standardize"}, {"column": "a", "operation": "fill_missing"},
        {"column": "b", "operation": "deduplicate"}, {"column": "b", "operation": "fill_missing"},
        {"column": "c", "operation": "fill_missing"},
    ])
    steps = run._planned(plan)
    assert [(s.column, s.operation) for s in steps] == [
        ("a", "fill_missing"), ("a", "standardize"), ("b", "fill_missing"), ("b", "deduplicate"), ("c", "fill_missing")]
    waves = [[(s.column, s.operation) for s in w] for w in run._waves(steps)]
    assert waves == [
        [("a", "fill_missing"), ("b", "fill_missing")], [("a", "standardize")], [("b", "deduplicate")],
        [("c", "fill_missing")]]


def test_failing_step(spark):
    df = spark.createDataFrame([("x",), (None,)], "s string")
    plan = suggest.make_plan(spark, [
        {"column": "s", "operation": "fill_missing", "parameters": {"strategy": "guess"}},
        {"column": "s", "operation": "onehot"},
    ])
    with pytest.raises(ValueError, match="guess"):
        run.run_plan(df, plan)
    ran = run.run_plan(df, plan, on_error="skip")
    assert [r["status"] for r in ran.log.orderBy("seq").collect()] == ["failed", "applied"]
    assert ran.df.columns == ["s_x", "s_nan"]


def test_length_guard_keeps_the_old_values(spark):
    df = spark.createDataFrame([("word " * 300 + str(i), "fine words " * 4 + str(i)) for i in range(5)], "t string, u string")
    plan = suggest.make_plan(spark, [{"column": c, "operation": "text_clean"} for c in ("t", "u")])
    ran = run.run_plan(df.withColumn("u", F.concat("u", F.lit(" The End"))), plan, length_guard=True)
    row = ran.df.first()
    assert row["t"].startswith("word word") and row["u"].endswith("end")
    assert {r["column"]: r["status"] for r in ran.log.collect()} == {"t": "skipped", "u": "applied"}


def test_every_step_runs_from_a_plan(spark):
    df = spark.range(60).selectExpr(
        "IF(id = 7, double('Infinity'), double(id * id)) AS x", "IF(id % 4 = 0, NULL, id) AS y",
        "concat('g', id % 3) AS g", "1 AS k", "concat('2024-01-', lpad(1 + id % 28, 2, '0')) AS when_date",
        "concat('The quick brown foxes number ', id, ' are running') AS review",
        "concat('Another long piece of writing ', id, ' about cats') AS essay",
    )
    lemmas = spark.createDataFrame([("foxes", "fox")], "word string, lemma string")
    steps = [
        ("x", "fix_infinite", {}), ("x", "remove_outliers", {}), ("x", "fill_missing", {}), ("x", "handle_skewness", {}),
        ("x", "normalize_range", {}), ("y", "fill_missing", {"strategy": "backward_fill", "order_by": "x"}),
        ("y", "standardize", {}), ("g", "label_encode", {}), ("g", "standardize", {}), ("k", "drop_constant", {}),
        ("when_date", "handle_datetime", {}), ("review", "text_clean", {"operations": "lowercase"}),
        ("review", "remove_stopwords", {}), ("review", "lemmatize", {}), ("essay", "tfidf", {"max_features": "3"}),
        ("y", "deduplicate", {}),
    ]
    plan = suggest.make_plan(spark, [{"column": c, "operation": o, "parameters": p} for c, o, p in steps])
    ran = run.run_plan(df, plan, lemmas=lemmas, checkpoint=True)
    statuses = {(r["column"], r["operation"]): r["status"] for r in ran.log.collect()}
    assert statuses.pop(("g", "standardize")) == "skipped"
    assert set(statuses.values()) == {"applied"}
    row = ran.df.where("review LIKE '%number 8%'").first()
    assert row["review"] == "quick brown fox number 8 running"
    assert "k" not in ran.df.columns and "essay_tfidf_2" in ran.df.columns
    assert ran.df.agg(F.min("x"), F.max("x")).first() == (0.0, 1.0)


def test_cleaner_on_new_data_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None)], "x double, s string")
    plan = suggest.make_plan(spark, [
        {"column": "x", "operation": "fill_missing"}, {"column": "x", "operation": "normalize_range"},
        {"column": "s", "operation": "label"},
    ])
    ran = run.run_plan(df, plan)
    new = spark.createDataFrame([(5.0, "b"), (None, "zzz")], "x double, s string")
    assert ran.cleaner.apply(new).collect() == [(2.0, 1), (0.5, 2)]  # unseen: the code after the last
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    new.write.parquet(source)
    stream = clean_stream(ran.cleaner, spark.readStream.schema(new.schema).parquet(source))
    query = (
        stream.writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(spark.read.parquet(sink).collect()) == [(0.5, 2), (2.0, 1)]
    ran.cleaner.steps += run.run_plan(df, suggest.make_plan(spark, [{"column": "x", "operation": "deduplicate"}])).cleaner.steps
    with pytest.raises(ValueError, match="compare rows"):
        clean_stream(ran.cleaner, spark.readStream.schema(new.schema).parquet(source))


def test_clean_a_file(spark, csv_file, tmp_path):
    out = str(tmp_path / "cleaned.csv")
    result = run.clean(spark, csv_file, output=out)
    assert result.df.count() == 5 and io.read_table(spark, out).count() == 5
    assert result.df.where("age IS NULL").count() == 0
    assert {"salary", "id", "age"} <= set(result.df.columns)
    assert set(result.charts()) == {
        "missing", "missing_patterns", "histogram", "box_plot", "correlations", "top_categories"}
    report = result.report()
    assert report["quality"].first()["quality_score"] is not None
    assert all(t.count() > 0 for t in report.values())
    assert result.comparison().where("column = 'age'").first()["missing_reduced"] == 1


def test_summary_without_a_log(spark):
    plan = suggest.make_plan(spark, [
        {"column": "a", "operation": "skip"}, {"column": "b", "operation": "fill_missing", "reason": "gaps"}])
    assert sorted(run.operation_summary(plan).collect()) == [
        ("a", "skip", "", "skipped"), ("b", "fill_missing", "gaps", "applied")]
    totals = run.summary_totals(plan, snapshots=[{"step": "initial"}]).first()
    assert (totals["total_suggestions"], totals["applied"], totals["snapshot_steps"]) == (2, 1, ["initial"])


def test_given_method_wins_over_an_alias(spark):
    plan = suggest.make_plan(spark, [
        {"column": "a", "operation": "onehot", "parameters": {"method": "label"}},
        {"column": "b", "operation": "categorical_encode", "parameters": {"strategy": "label", "keep_original": "True"}},
    ])
    got = {r["column"]: r["parameters"] for r in suggest.resolve_plan(plan).collect()}
    assert got["a"]["strategy"] == "label" and got["a"]["method"] == "categorical_encode"
    assert got["b"] == {"strategy": "label", "keep_original": "True", "method": "categorical_encode"}


def test_single_file_of_many_parts(spark, tmp_path):
    path = tmp_path / "a.csv"
    for rows in (300, 4):  # the second one takes the first one's place
        io.write_table(spark.range(rows).repartition(7), str(path), single_file=True)
        assert path.is_file() and io.read_table(spark, str(path)).count() == rows
    assert not [p for p in tmp_path.iterdir() if "parts" in p.name]
