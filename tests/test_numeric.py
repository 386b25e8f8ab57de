"""Hand-made frames: fills, scaling, outliers, quantiles, and the invariants they keep."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from washline.operators import impute, numeric, rows, scale
from washline.operators.quantiles import quantiles
from washline.operators.ranges import number_distinct, ordered_buckets


@pytest.fixture
def with_missing(spark):
    return spark.createDataFrame(
        [(1.0, "A", 10), (2.0, "B", 20), (None, None, 30), (4.0, "A", 40), (5.0, "B", 50)],
        "numeric_col double, categorical_col string, complete_col int",
    )


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_impute_vectors(with_missing):
    assert column(impute.impute(with_missing, "numeric_col", "mean"), "numeric_col")[2] == 3.0
    assert column(impute.impute(with_missing, "numeric_col", "median"), "numeric_col")[2] == 3.0
    assert column(impute.impute(with_missing, "categorical_col", "mode"), "categorical_col")[2] == "A"
    assert column(impute.impute(with_missing, "complete_col"), "complete_col") == [10, 20, 30, 40, 50]


def test_impute_auto_leaves_nothing_missing(with_missing):
    done = impute.impute(with_missing)
    assert done.where(" OR ".join(f"{c} IS NULL" for c in done.columns)).count() == 0


def test_impute_reads_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert column(impute.impute(df, "x", "mean"), "x") == [1.0, 2.0, 3.0]


def test_impute_unknown_strategy(with_missing):
    with pytest.raises(ValueError, match="strategy"):
        impute.impute(with_missing, strategy="guess")


def test_impute_all_missing_stays(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    assert impute.impute(df).where("x IS NULL AND s IS NULL").count() == 2


def test_integers_become_doubles_when_filled(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (4,), (4,)], "x int")
    assert column(impute.impute(df, "x", "mean"), "x")[2] == 2.75


@pytest.mark.parametrize("buckets", [None, 1, 3])
def test_ordered_fill_vectors(spark, buckets):
    df = spark.createDataFrame(list(enumerate([1.0, None, 3.0, None, 5.0])), "k int, col double")
    forward = impute.ordered_fill(df, ["col"], "k", buckets=buckets).orderBy("k")
    assert column(forward, "col") == [1, 1, 3, 3, 5]
    backward = impute.ordered_fill(df, ["col"], "k", forward=False, buckets=buckets).orderBy("k")
    assert column(backward, "col") == [1, 3, 3, 5, 5]


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("parts", [[], ["g"]])
def test_ordered_fill_matches_pandas(spark, forward, parts):
    rng = random.Random(5)
    data = pd.DataFrame({
        # one group holds most rows, one key column is partly missing
        "g": [None if rng.random() < 0.05 else rng.choice("aaaaaab") for _ in range(3000)],
        "k": rng.sample(range(10_000), 3000),
        "x": [rng.random() if rng.random() < 0.02 else None for _ in range(3000)],
    })
    df = spark.createDataFrame(
        [(g, int(k), None if math.isnan(x) else x) for g, k, x in data.itertuples(index=False)],
        "g string, k int, x double",
    ).repartition(7)
    got = impute.ordered_fill(df, ["x"], "k", parts, forward, buckets=40).toPandas()
    got = got.sort_values("k")["x"].to_numpy()
    by_key = data.sort_values("k")
    series = by_key.groupby("g", dropna=False)["x"] if parts else by_key["x"]
    want = (series.ffill() if forward else series.bfill()).to_numpy()
    np.testing.assert_array_equal(got, want)


@pytest.mark.parametrize("buckets", [1, 4])
def test_no_fill_reads_its_frame_anew_for_every_row(spark, buckets):
    """A frame that ends at the last row costs the square of its rows; the other kind runs along."""
    df = spark.range(100).selectExpr("id AS k", "IF(id % 9 = 4, id, NULL) AS x")
    filled = impute.ordered_fill(df, ["x"], "k", forward=False, buckets=buckets)
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower()
    want = [min((i for i in range(k, 100) if i % 9 == 4), default=None) for k in range(100)]
    assert column(filled.orderBy("k"), "x") == want


def test_ordered_fill_needs_an_order(with_missing):
    with pytest.raises(ValueError, match="order_by"):
        impute.impute(with_missing, "numeric_col", "forward_fill")


GRID = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("kind", ["even", "skewed", "few", "one", "hot"])
def test_bracketed_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "even": rng.random(20_000),
        "skewed": np.exp(rng.normal(size=20_000) * 4),
        "few": rng.integers(0, 5, 20_000).astype(float),
        "one": np.full(20_000, 7.5),
        "hot": np.where(rng.random(20_000) < 0.4, 0.0, rng.normal(size=20_000)),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(6)
    got = quantiles(df, {"x": GRID}, small=0, fetch=50)["x"]
    np.testing.assert_allclose([got[p] for p in GRID], np.quantile(values, GRID), rtol=1e-12)


def test_all_ranks_are_bracketed_in_few_scans(spark):
    """Each round is one scan, whatever the number of wanted ranks; signs of zero, infinities and
    frequent values do no harm."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(8)
    odd = [0.0, -0.0, math.inf, -math.inf, 1e308, -1e308] * 3
    values = np.concatenate([rng.normal(size=6000), rng.integers(0, 3, 3000) * 1.0, odd])
    df = spark.createDataFrame(pd.DataFrame({"x": values})).mapInArrow(counted, "x double")
    grid = [i / 100 for i in range(1, 100)]
    got = quantiles(df, {"x": grid}, {"x": len(values)}, small=0, fetch=20)["x"]
    np.testing.assert_allclose([got[p] for p in grid], np.quantile(values, grid), rtol=1e-12)
    assert read.value <= 3 * len(values)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles(df, {"x": [0.5]}) == {"x": {0.5: None}}


@pytest.mark.parametrize("prefix", ["v", "é" * 300])
def test_number_distinct_over_buckets(spark, prefix):
    df = spark.createDataFrame([(f"{prefix}{i:04d}",) for i in range(2000)], "value string").repartition(5)
    got = number_distinct(df, ["value"], buckets=16).orderBy("value").collect()
    assert [r["position"] for r in got] == list(range(2000))


def test_minmax_lies_in_unit_range(spark):
    df = spark.createDataFrame([(-5,), (0,), (None,), (20,)], "x int")
    assert column(scale.normalize(df), "x") == [0.0, 0.2, None, 1.0]


@pytest.mark.parametrize("method", scale.METHODS)
def test_zero_spread(spark, method):
    df = spark.createDataFrame([(3.0, None), (None, None), (3.0, None)], "x double, e double")
    zero = scale.apply_scale(df, scale.fit_scale(df, None, method))
    assert column(zero, "x") == [0.0, 0.0, 0.0]
    assert column(zero, "e") == [None, None, None]
    kept = scale.apply_scale(df, scale.fit_scale(df, "x", method, on_constant="keep"))
    assert column(kept, "x") == [3.0, None, 3.0]


def test_std_of_one_row_is_missing(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    assert column(scale.standardize(df), "x") == [None]


def test_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    assert column(numeric.handle_outliers(df, "x", "clip"), "x") == [1, 2, 3, 4, 7, None]
    assert column(numeric.handle_outliers(df, "x", "median"), "x") == [1, 2, 3, 4, 3, None]
    assert column(numeric.handle_outliers(df, "x", "nan"), "x") == [1, 2, 3, 4, None, None]


def test_skewness_shift(spark):
    values = [-1.0, 0.0, 1.0, 2.0, 500.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = [math.log1p(v + 1 + 1) for v in values]
    assert column(numeric.handle_skewness(df), "x") == pytest.approx(want)
    even = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert column(numeric.handle_skewness(even), "x") == [1, 2, 3]


def test_skewness_and_kurtosis_are_corrected(spark):
    from washline.functions import stats
    data = [1.0, 2.0, 3.0, 4.0, 50.0]
    df = spark.createDataFrame([(v,) for v in data], "x double")
    g1, g2 = df.agg(stats.skewness(F.col("x")), stats.kurtosis(F.col("x"))).first()
    assert g1 == pytest.approx(pd.Series(data).skew())
    assert g2 == pytest.approx(pd.Series(data).kurt())
    few = df.limit(2).agg(stats.skewness(F.col("x")), stats.kurtosis(F.col("x"))).first()
    assert tuple(few) == (None, None)


def test_fix_infinite(spark):
    df = spark.createDataFrame(
        [(1.0, 1), (float("inf"), 2), (float("-inf"), 3), (float("nan"), 4)], "x double, k int")
    assert column(numeric.fix_infinite(df), "x") == [1.0, None, None, None]


def test_dedup_keeps(spark):
    df = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 2), (2, "c", 3), (None, "d", 4), (None, "e", 5)], "k int, v string, t int")
    def values(**options):
        return sorted(column(rows.deduplicate(df, "k", **options), "v"))
    assert values(keep="first", order_by="t") == ["a", "c", "d"]
    assert values(keep="last", order_by="t") == ["b", "c", "e"]
    assert values(keep=False) == ["c"]
    with pytest.raises(ValueError, match="order_by"):
        rows.deduplicate(df, "k")


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    once = rows.deduplicate(df)
    assert once.count() == rows.deduplicate(once).count() == 2


def test_dedup_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("string(id % 3) AS k", "id AS t")
    plan = rows.deduplicate(df, "k", "first", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange


def test_drop_constant(spark):
    df = spark.createDataFrame([(1, None, 1.0, "s"), (2, None, 1.0, None)], "a int, e double, k double, s string")
    assert rows.drop_constant(df).columns == ["a"]
    assert rows.drop_constant(df, "k").columns == ["a", "e", "s"]


def test_one_huge_group_is_split_over_buckets(spark):
    df = spark.range(20_000).selectExpr("IF(id % 10 = 0, id % 50, -1) AS g", "id AS k")
    bucketed = df.withColumn("b", ordered_buckets(df, ["g", "k"], buckets=32))
    largest = bucketed.groupBy("b").count().agg(F.max("count")).first()[0]
    assert largest < 20_000 / 32 * 3
    steps = bucketed.orderBy("g", "k").select("b").collect()
    assert all(a["b"] <= b["b"] for a, b in zip(steps, steps[1:]))
