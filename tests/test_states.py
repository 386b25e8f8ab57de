"""Profile states of parts add up to the state of the whole."""

import random

import pytest
from pyspark.sql import functions as F

from washline.operators import profile, states


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [
        (rng.gauss(1e6, 3) if i % 7 else None, rng.randint(-5, 5), rng.choice(["a", "b", "", "long " * 30, None]),
         f"v{i % 900}", [i % 3], float("nan") if i % 2 else i / 8)
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, "x double, n int, s string, v string, a array<int>, d double").repartition(5)


def rows_of(df):
    return {r["column"]: r.asDict(recursive=True) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 4])
def test_states_of_parts(spark, table, tmp_path, parts):
    pieces = [table.where(F.pmod(F.xxhash64("v", "n"), F.lit(parts)) == i) for i in range(parts)]
    stored = []
    for i, piece in enumerate([*pieces, table.limit(0)]):
        states.profile_state(piece).write.parquet(str(tmp_path / f"s{i}"))
        stored.append(spark.read.parquet(str(tmp_path / f"s{i}")))
    found = rows_of(states.profile_of_state(states.merge_states(stored)))
    whole = rows_of(profile.profile(table))
    assert set(found) == set(whole)
    analysis = rows_of(profile.column_analysis(table))
    for name, own in whole.items():
        for k in ("dtype", "kind", "non_null", "nulls", "position"):
            assert found[name][k] == own[k], (name, k)
        for k in ("min", "max", "mean", "std"):
            assert found[name][k] == (None if own[k] is None else pytest.approx(own[k], rel=1e-9)), (name, k)
    for name in ("s", "v"):
        assert found[name]["unique_count"] == whole[name]["unique_count"]
    assert found["v"]["sample_unique"] == whole["v"]["sample_unique"]
    assert len(found["s"]["sample_unique"]) == 4
    top = profile.top_values(table, 5, ["s"]).collect()
    assert sorted(t["n"] for t in found["s"]["top_values"]) == sorted(r["n"] for r in top)
    exact = table.selectExpr(
        "skewness(x) * sqrt(count(x) * (count(x) - 1)) / (count(x) - 2)", "kurtosis(x)", "count(x)").first()
    assert found["x"]["skewness"] == pytest.approx(exact[0], rel=1e-6, abs=1e-9)
    n = exact[2]
    assert found["x"]["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * exact[1] + 6), rel=1e-6, abs=1e-9)
    for name in ("x", "n", "d"):
        share = table.selectExpr(f"avg(CAST({name} <= {found[name]['median']!r} AS DOUBLE)) FILTER (WHERE {name} IS NOT NULL AND NOT isnan({name}))").first()[0]
        below = table.selectExpr(f"avg(CAST({name} < {found[name]['median']!r} AS DOUBLE)) FILTER (WHERE {name} IS NOT NULL AND NOT isnan({name}))").first()[0]
        assert below - 2 * states.RANK_ERROR <= 0.5 <= share + 2 * states.RANK_ERROR
    assert analysis["x"]["non_null"] == found["x"]["non_null"]


def test_states_without_values_or_of_other_types(spark, table):
    empty = states.profile_state(table.limit(0))
    found = rows_of(states.profile_of_state(states.merge_states([empty, empty])))
    assert found["x"]["mean"] is None and found["x"]["median"] is None and found["s"]["unique_count"] == 0
    numbers = rows_of(states.profile_of_state(states.profile_state(table.select("x", "n"))))
    assert numbers["n"]["min"] == -5 and numbers["n"]["top_values"] is None
    other = states.profile_state(spark.createDataFrame([("t",)], "n string"))
    with pytest.raises(Exception, match="has types"):
        states.merge_states([states.profile_state(table.select("n")), other]).collect()
