"""Quality score, recommendations and before/after comparison."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import no_value, number, numeric_columns, string_columns, tidy
from ..functions.stats import kurtosis, skewness
from .counts import distinct_counts
from .fit import scalars
from .frequent import distinct_at_least
from .numeric import fences
from .profile import overview, statistics
from .quantiles import quantiles
from .rows import fit_constant

HIGH_CARDINALITY = 0.5
HIGH_SKEW = 2
OUTLIER_SHARE = 0.05
MEANINGFUL = 0.01

# Wording of issues and recommendations.
ISSUES = {
    "many_missing": "High missing values: %.1f%%",
    "some_missing": "Moderate missing values: %.1f%%",
    "many_copies": "High duplicate rate: %.1f%%",
    "some_copies": "Moderate duplicate rate: %.1f%%",
    "constant": "Constant columns found: ",
}
SENTENCES = {
    "high_cardinality": "Consider feature engineering for high-cardinality columns: [%s]",
    "skewed": "Column '%s' is highly skewed (skewness: %.2f). Consider transformation.",
    "outliers": "Column '%s' has potential outliers (%d rows). Consider investigation.",
    "good_condition": "Dataset appears to be in good condition for analysis.",
}


def quality(df: DataFrame) -> DataFrame:
    """One row: score from 0 to 100, grade, and the issues that cost points."""
    constant = fit_constant(df)
    facts = overview(df).select(
        F.col("missing_percentage").alias("missing"),
        F.coalesce(
            F.try_divide(F.col("duplicate_rows") * 100.0, F.col("total_rows")), F.lit(0.0)
        ).alias("duplicates"),
    )
    missing, duplicates = F.col("missing"), F.col("duplicates")
    score = (
        F.lit(100)
        - F.when(missing > 10, 20).when(missing > 5, 10).otherwise(0)
        - F.when(duplicates > 5, 15).when(duplicates > 1, 5).otherwise(0)
        - F.lit(10 if constant else 0)
    )
    issues = F.array_compact(F.array(
        F.when(missing > 10, F.format_string(ISSUES["many_missing"], missing))
        .when(missing > 5, F.format_string(ISSUES["some_missing"], missing)),
        F.when(duplicates > 5, F.format_string(ISSUES["many_copies"], duplicates))
        .when(duplicates > 1, F.format_string(ISSUES["some_copies"], duplicates)),
        F.lit(ISSUES["constant"] + str(constant) if constant else None).cast("string"),
    ))
    s = F.col("quality_score")
    grade = (
        F.when(s >= 90, "Excellent").when(s >= 70, "Good").when(s >= 50, "Fair").otherwise("Poor")
    )
    return facts.select(F.greatest(score, F.lit(0)).alias("quality_score"), issues.alias("issues")) \
        .select("quality_score", grade.alias("assessment"), "issues")


def recommendations(df: DataFrame, approx: bool = False) -> DataFrame:
    """``(rule, column, measure)`` for each finding: ``high_cardinality`` (distinct share),
    ``skewed`` (skewness), ``outliers`` (rows beyond the fences), or the one rule ``good_condition``.
    """
    numeric, strings = numeric_columns(df), string_columns(df)
    values = tidy(df, numeric)
    wanted = {(n, "skew"): skewness(number(values, n)) for n in numeric}
    wanted |= {(n, "count"): F.count(number(values, n)) for n in numeric}
    seen = scalars(values, {"rows": F.count(F.lit(1)), **wanted})
    rows = seen["rows"]
    q = quantiles(df, {n: [0.25, 0.75] for n in numeric}, {n: seen[n, "count"] for n in numeric}, approx)
    limits = {n: fences(q[n][0.25], q[n][0.75]) for n in numeric if q[n][0.25] is not None}
    beyond = scalars(values, {
        n: F.count_if((number(values, n) < F.lit(low)) | (number(values, n) > F.lit(high)))
        for n, (low, high) in limits.items()
    })
    high = distinct_at_least(
        df, strings, {n: rows * HIGH_CARDINALITY for n in strings}, partial(distinct_counts, approx=approx)
    )
    distinct = distinct_counts(df, high, approx)
    found = [
        ("high_cardinality", n, d / rows) for n, d in distinct.items() if d > rows * HIGH_CARDINALITY
    ]
    found += [
        ("skewed", n, seen[n, "skew"]) for n in numeric
        if seen[n, "skew"] is not None and abs(seen[n, "skew"]) > HIGH_SKEW
    ]
    found += [("outliers", n, float(k)) for n, k in beyond.items() if k > rows * OUTLIER_SHARE]
    return df.sparkSession.createDataFrame(  # at most two rows per column
        found or [("good_condition", None, None)], "rule string, column string, measure double"
    )


def recommendation_text(found: DataFrame) -> DataFrame:
    """``(rule, column, text)``: the findings as sentences. The high-cardinality columns share one
    sentence, in the order of their names, with a null ``column``."""
    rule, c, m = F.col("rule"), F.col("column"), F.col("measure")
    together = rule == "high_cardinality"
    names = F.array_sort(F.collect_list(F.concat(F.lit("'"), c, F.lit("'"))))  # columns of one table
    one = found.where(together).groupBy("rule").agg(
        F.format_string(SENTENCES["high_cardinality"], F.array_join(names, ", ")).alias("text")
    ).select("rule", no_value("string").alias("column"), "text")
    return one.unionByName(found.where(~together).select(
        "rule", "column",
        F.when(rule == "skewed", F.format_string(SENTENCES["skewed"], c, m))
        .when(rule == "outliers", F.format_string(SENTENCES["outliers"], c, m.cast("bigint")))
        .otherwise(SENTENCES["good_condition"]).alias("text"),
    ))


def comparable_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns numeric on both sides, sorted."""
    return sorted(set(numeric_columns(before)) & set(numeric_columns(after)))


STATISTICS = (
    "column string, count bigint, missing bigint, missing_pct double, mean double, median double, "
    "std double, min double, max double, range double, skewness double, kurtosis double"
)


def column_statistics(df: DataFrame, names: list[str], approx: bool = False) -> DataFrame:
    """Count, missing, mean, median, std, min, max, range, skewness and kurtosis per column."""
    def measures(values: DataFrame, n: str) -> dict[str, Column]:
        v = number(values, n)
        missing = F.count_if(v.isNull())
        return {
            "count": F.count(v),
            "missing": missing,
            "missing_pct": F.try_divide(missing * 100.0, F.count(F.lit(1))),
            "mean": F.avg(v),
            "std": F.stddev(v),
            "min": F.min(v),
            "max": F.max(v),
            "range": F.max(v) - F.min(v),
            "skewness": skewness(v),
            "kurtosis": kurtosis(v),
        }

    seen = statistics(df, names, measures)
    medians = quantiles(df, {n: [0.5] for n in names}, {n: seen[n]["count"] for n in names}, approx)
    fields = [f.split()[0] for f in STATISTICS.split(", ")]
    rows = [
        tuple({"column": n, "median": medians[n][0.5], **seen[n]}[f] for f in fields) for n in names
    ]
    return df.sparkSession.createDataFrame(rows, STATISTICS)  # one row per column


def compare(before: DataFrame, after: DataFrame, approx: bool = False) -> DataFrame:
    """Statistics of each comparable column on both sides, their changes and what improved."""
    names = comparable_columns(before, after)
    b = column_statistics(before, names, approx)
    a = column_statistics(after, names, approx)
    measures = [m for m in b.columns if m != "column"]
    left = b.select("column", *[F.col(m).alias(f"before_{m}") for m in measures])
    right = a.select("column", *[F.col(m).alias(f"after_{m}") for m in measures])
    joined = left.join(F.broadcast(right), "column")  # one row per column

    def magnitude(side: str) -> Column:
        return F.coalesce(F.abs(F.col(f"{side}_skewness")), F.lit(0.0))

    b_std = F.coalesce("before_std", F.lit(0.0))
    a_std = F.coalesce("after_std", F.lit(0.0))
    changes = [
        (F.col(f"after_{m}") - F.col(f"before_{m}")).alias(f"change_{m}")
        for m in measures if m not in ("missing", "missing_pct")
    ]
    return joined.select(
        "*", *changes,
        (F.col("before_missing") - F.col("after_missing")).alias("missing_reduced"),
        (magnitude("before") - magnitude("after") > MEANINGFUL).alias("skewness_improved"),
        ((b_std > 0) & (a_std > 0) & (b_std - a_std > MEANINGFUL)).alias("outliers_handled"),
    )
