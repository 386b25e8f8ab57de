"""Profiles that are added to: a stored state of mergeable parts, a row a column.

A state holds counts, the first four central moments, ends, the first distinct values in order, a quantile
sketch, a theta sketch of the distinct values and a summary of the frequent ones. States of parts of a table
- days, files - add up to the state of the whole, so a profile of old and new rows reads the new ones only.

Exact after any number of merges: counts, ends, previews, moments (up to rounding), and distinct counts up to
``EXACT_DISTINCT``. Bounded: ranks of quantiles within about ``RANK_ERROR``; distinct counts above within some
percent; counts of frequent values too high by at most ``3.5 * 0.75 / TRACKED`` of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    col, distinct_key, field, is_numeric, is_scalar, no_value, number, present, scalar_columns, tidy,
)
from .frequent import text_key
from .profile import MAX_UNIQUE_PREVIEW, TOP_VALUES, per_column

BITS = 12
EXACT_DISTINCT = 1 << BITS
RANK_ERROR = 0.0133  # of the quantile sketch at its default size
TRACKED = 1_024
MOMENTS = ("mean", "m2", "m3", "m4")


def profile_state(df: DataFrame) -> DataFrame:
    """The state of a table, from one scan. Missing is NULL or NaN; nested columns have counts only. A table
    without rows has a state as well."""
    def measures(values: DataFrame, n: str) -> dict[str, Column]:
        dtype = field(values, n).dataType
        v = present(values, n) if is_scalar(dtype) else col(n)
        counted = {
            "dtype": F.lit(dtype.simpleString()), "rows": F.count(F.lit(1)), "non_null": F.count(v),
            **{k: no_value("double") for k in ("min", "max", *MOMENTS)}, "quantiles": no_value("binary"),
            "distinct": no_value("binary"), "first": no_value("array<string>"),
        }
        if is_numeric(dtype):
            x = number(values, n)
            size, spread = F.count(x), F.coalesce(F.var_pop(x), F.lit(0.0))
            counted |= {
                "min": F.min(x), "max": F.max(x), "mean": F.coalesce(F.avg(x), F.lit(0.0)), "m2": size * spread,
                "m3": F.coalesce(F.skewness(x), F.lit(0.0)) * size * F.pow(spread, F.lit(1.5)),
                "m4": F.when(spread > 0, (F.kurtosis(x) + 3) * size * spread * spread).otherwise(0.0),
                "quantiles": F.kll_sketch_agg_double(x),
            }
        if is_scalar(dtype):
            counted["distinct"] = F.theta_sketch_agg(text_key(values, n), F.lit(BITS))
        return counted

    base = per_column(df, df.columns, measures)
    names = [n for n in scalar_columns(df) if not is_numeric(field(df, n).dataType)]
    if not names:
        return base.withColumn("frequent", _no_frequent()).withColumn("first", no_value("array<string>"))
    return base.drop("first").join(F.broadcast(_text_parts(tidy(df, names), names)), "column", "left")


def _no_frequent() -> Column:
    return no_value("struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>")


def _shown(df: DataFrame, name: str) -> Column:
    """What reports show of a value: short ones as they are, long texts by their digest."""
    return distinct_key(df, name).cast("string")


def _text_parts(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, frequent, first)``: summaries and the first distinct values, merged on the map side."""
    cells = df.select(F.inline(F.array_compact(F.array(*[
        F.when(_shown(df, n).isNotNull(), F.struct(F.lit(n).alias("column"), _shown(df, n).alias("v"))) for n in names
    ]))))
    frequent = cells.groupBy("column").agg(F.expr(f"approx_top_k_accumulate(v, {TRACKED})").alias("frequent"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("v"))
    first = cells.distinct().withColumn("place", place).where(F.col("place") <= MAX_UNIQUE_PREVIEW)
    listed = first.groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("first"))
    return frequent.join(listed, "column")


def merge_states(states: Iterable[DataFrame]) -> DataFrame:
    """The state of all rows together. States must be of the same columns with the same types."""
    every = reduce(DataFrame.unionByName, list(states))
    whole = Window.partitionBy("column")
    size = F.sum("non_null").over(whole)
    center = F.coalesce(F.try_divide(F.sum(F.col("non_null") * F.col("mean")).over(whole), size), F.lit(0.0))
    spread = every.withColumn("center", F.when(F.col("mean").isNotNull(), center)) \
        .withColumn("off", F.col("mean") - F.col("center")).withColumn("states", F.count(F.lit(1)).over(whole))
    n, d = F.col("non_null"), F.col("off")
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    first = F.flatten(F.collect_list("first"))
    merged = spread.groupBy("column").agg(
        F.min("position").alias("position"), F.min("dtype").alias("dtype"), F.max("dtype").alias("other"),
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.max("center").alias("mean"),
        F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.theta_union_agg("distinct", F.lit(BITS)).alias("distinct"),
        F.slice(F.array_sort(F.array_distinct(first)), 1, MAX_UNIQUE_PREVIEW).alias("first"),
        F.max("first").isNotNull().alias("is_text"),
    )
    combined = every.where(F.col("frequent").isNotNull()).groupBy("column").agg(
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent")
    )
    merged = merged.join(F.broadcast(combined), "column", "left")  # a row a column
    same = F.when(F.col("dtype") == F.col("other"), F.col("dtype")).otherwise(
        F.raise_error(F.format_string("column %s has types %s and %s", "column", "dtype", "other")).cast("string")
    )
    kept = {"dtype": same, "first": F.when(F.col("is_text"), F.col("first"))}
    return merged.select(*[kept.get(c, F.col(c)).alias(c) for c in every.columns])


def profile_of_state(state: DataFrame) -> DataFrame:
    """The profile that a state holds, with median, skewness, kurtosis and the most frequent values, which a
    stored profile cannot be added up to. ``sample_unique`` and ``top_values`` show long texts by their digest.
    """
    n = F.col("non_null").cast("double")
    some = F.col("mean").isNotNull() & (n > 0)
    skew = F.try_divide(F.sqrt(n) * F.col("m3"), F.pow("m2", F.lit(1.5))) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    peak = F.try_divide(n * F.col("m4"), F.col("m2") * F.col("m2")) - 3
    excess = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * peak + 6)
    quantile = lambda q: F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(q)))
    top = F.when(F.col("frequent").isNotNull(), F.expr(f"approx_top_k_estimate(frequent, {TOP_VALUES})"))
    return state.select(
        "position", "column", "dtype",
        F.when(F.col("mean").isNotNull(), "numerical").otherwise("categorical").alias("kind"),
        "non_null", (F.col("rows") - F.col("non_null")).alias("nulls"), "min", "max",
        F.when(some, F.col("mean")).alias("mean"),
        F.when(some, F.sqrt(F.try_divide(F.col("m2"), n - 1))).alias("std"),
        quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"),
        F.when(some & (n > 2), skew).alias("skewness"), F.when(some & (n > 3), excess).alias("kurtosis"),
        F.theta_sketch_estimate("distinct").alias("unique_count"), F.col("first").alias("sample_unique"),
        F.transform(top, lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n"))).alias("top_values"),
    )
