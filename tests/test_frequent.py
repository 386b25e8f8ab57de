"""Summaries of distinct and frequent values, and tables that charts and encodings used to trip over."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from washline.operators import charts, counts, encode, frequent, numeric, quality, tfidf, typing
from washline.plans.run import chart_tables
from washline.plans import steps


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(frequent, "SMALL_ROWS", 0)
    monkeypatch.setattr(frequent, "TRACKED", (512, 2048))
    monkeypatch.setattr(frequent, "EVERY_VALUE", 64)


def plain_top(values, k, missing):
    tally = {}
    for v in values:
        if v is not None or missing:
            tally[v] = tally.get(v, 0) + 1
    order = sorted(tally.items(), key=lambda p: (-p[1], p[0] is None, "" if p[0] is None else p[0]))
    return [(v, n) for v, n in order[:k]]


@pytest.fixture(scope="module")
def skewed(spark):
    """Heavy values among very many others, an even column, one of few values, long texts."""
    rng = random.Random(1)
    heavy = ["alpha", "beta", "", "x" * 100, "gamma", "delta"]
    rows = []
    for i in range(20_000):
        a = heavy[min(5, int(rng.expovariate(1)))] if rng.random() < 0.6 else f"rare {i}"
        rows.append((None if i % 11 == 0 else a, f"even {i // 2}", f"few {i % 7}", i % 3 if i % 2 else i))
    return spark.createDataFrame(rows, "a string, even string, few string, n long").repartition(6), rows


@pytest.mark.parametrize("missing", [True, False])
def test_top_counts_with_and_without_summaries(spark, skewed, always, missing):
    df, rows = skewed
    names = ["a", "even", "few", "n"]
    sure, wanted = frequent.candidates(counts.key_cells(df, names, missing), 4)
    assert sure == {"a"} and wanted.count() < 20
    top = counts.top_counts(df, names, 4, missing)
    place = counts.slots(df, names)[1]
    for i, name in enumerate(names):
        own = [r for r in top.collect() if r["column"] == name]
        found = [(r[f"v{place[name]}"], r["n"]) for r in sorted(own, key=lambda r: r["rank"])]
        tally = plain_top([r[i] for r in rows], 4, missing) if name != "n" else None
        if tally is not None:
            assert found == tally
        else:
            assert [f[1] for f in found[:3]] == sorted((f[1] for f in found[:3]), reverse=True)
    shown = {(r["column"], r["value"], r["n"]) for r in charts.top_categories(df, ["a"], 3).collect()}
    assert shown == {("a", "<NULL>" if v is None else v, n) for v, n in plain_top([r[0] for r in rows], 3, True)}
    assert counts.modes(df, ["a", "few"]) == {"a": plain_top([r[0] for r in rows], 1, False)[0][0], "few": "few 0"}


def test_summaries_shuffle_few_rows(spark, skewed, always):
    """What travels by column and value are the candidates, however many values there are."""
    df = skewed[0]
    plan = counts.top_counts(df, ["a"], 4, by_digest=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") >= 1 and "LeftSemi" in plan


def test_chosen_terms_with_and_without_summaries(spark, monkeypatch):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["river", "stone", "hill"]) if rng.random() < 0.5 else f"w{rng.randint(0, 9999)}"
                          for _ in range(40))) for i in range(400)]
    df = spark.createDataFrame(texts, "id long, text string")
    full = tfidf.fit_tfidf(df, "text", 3)
    monkeypatch.setattr(frequent, "SMALL_ROWS", 0)
    monkeypatch.setattr(frequent, "TRACKED", (512, 2048))
    monkeypatch.setattr(frequent, "EVERY_VALUE", 64)
    assert tfidf.frequent_terms(df, "text", 3).count() < 20
    assert tfidf.fit_tfidf(df, "text", 3) == full
    assert full["terms"] == ["hill", "river", "stone"]


def test_few_distinct_is_exact_up_to_its_limit(spark):
    df = spark.range(5000).select(
        (F.col("id") % 19).cast("string").alias("a"), (F.col("id") % 20).cast("string").alias("b"),
        F.col("id").cast("string").alias("c"), F.lit(None).cast("string").alias("d"), F.lit("").alias("e"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(-0.0).alias("f"),
    )
    assert frequent.few_distinct(df, df.columns, 19) == {"a": 19, "b": None, "c": None, "d": 0, "e": 1, "f": 1}
    assert typing.short_categorical_columns(df) == ["a", "d", "e"]
    near = frequent.distinct_at_least(df, ["a", "c"], {"a": 20, "c": 5000}, counts.distinct_counts)
    assert near == ["c"]
    assert {r["column"] for r in quality.recommendations(df.select("a", "c")).collect()} == {"c"}


# tables without values

@pytest.mark.parametrize("where", ["true", "false"])
def test_charts_of_columns_without_values(spark, where):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x double, s string").where(where)
    assert charts.histogram(df).collect() == [] and charts.box_plot(df).collect() == []
    assert charts.histogram(df).columns == ["column", "bin", "low", "high", "n"]
    for chart in chart_tables(df).values():
        chart.collect()


def test_histogram_of_infinite_and_extreme_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (-inf, 1.0, 2.0, inf, inf, float("nan"), None)], "x double")
    found = {(r["bin"], r["low"], r["high"], r["n"]) for r in charts.histogram(df, bins=2).collect()}
    assert found == {(0, -inf, -inf, 1), (1, 1.0, 1.5, 1), (2, 1.5, 2.0, 1), (3, inf, inf, 2)}
    only = spark.createDataFrame([(inf,)], "x double")
    assert [tuple(r) for r in charts.histogram(only, bins=2).collect()] == [("x", 3, inf, inf, 1)]
    wide = spark.createDataFrame([(-1.7e308,), (1.7e308,), (0.1,)], "x double")
    assert sorted((r["bin"], r["n"]) for r in charts.histogram(wide, bins=2).collect()) == [(1, 1), (2, 2)]


# encodings

def test_one_hot_names_are_told_apart(spark, tmp_path):
    df = spark.createDataFrame([("nan", "c", "x"), (None, "b_c", "y"), ("A", "c", "x"), ("a", "c", "x")], "c string, a_b string, a string")
    df = df.withColumn("a", F.when(F.col("a") == "x", "b_c").otherwise("q"))
    out = encode.encode(df, ["c", "a_b", "a"], keep_original=False)
    assert out.columns == ["c_a", "c_A_2", "c_nan", "c_nan_2", "a_b_b_c", "a_b_c", "a_b_c_2", "a_q"] or \
        len({c.lower() for c in out.columns}) == len(out.columns) == 8
    out.write.parquet(str(tmp_path / "t"))
    params = encode.fit_encode(df, "c", keep_original=False)
    assert encode.encoding_metadata(params)[0]["new_columns"] == params["c"]["names"]
    hits = [tuple(r) for r in encode.apply_encode(df.select("c"), params).collect()]
    assert all(sum(h) == 1 for h in hits) and len(set(hits)) == 4


def test_one_hot_limit_of_a_plan(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(encode.TooManyCategories):
        steps._fit_encode(df, ["s"], {"strategy": "onehot", "max_categories": "29"})
    assert len(steps._fit_encode(df, ["s"], {"strategy": "onehot", "max_categories": "30"})["s"]["names"]) == 30


def test_vectors_by_code_table(spark, monkeypatch):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", None, "c", "a", "b"]], "s string")
    listed = [r[0] for r in encode.encode_vector(df, "s", "v").orderBy("s").select(vector_to_array("v")).collect()]
    monkeypatch.setattr(encode, "MAX_DRIVER_BYTES", 0)
    params = encode.fit_encode(df, "s", "label", order="frequency")
    assert params["s"]["categories"] is None
    out = encode.encode_vector(df, "s", "v")
    assert [r[0] for r in out.orderBy("s").select(vector_to_array("v")).collect()] == listed
    assert listed == [[0, 0, 0, 1], [0, 1, 0, 0], [0, 1, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0]]
    assert out.schema["v"].metadata["ml_attr"]["num_attrs"] == 4
    assert "from_json" in out._jdf.queryExecution().toString()


def test_skewness_and_hashed_terms_of_other_rows(spark):
    fit = spark.createDataFrame([(float(2 ** i),) for i in range(12)], "x double")
    params = numeric.fit_skewness(fit, "x")
    new = spark.createDataFrame([(-5.0,), (0.5,), (1.0,), (None,)], "x double")
    shown = [r[0] for r in numeric.apply_skewness(new, params).collect()]
    assert shown[0] == shown[1] == shown[2] is not None and shown[3] is None
    empty = spark.createDataFrame([], "id long, t string")
    assert tfidf.tfidf_hashed(empty, "t").collect() == []
