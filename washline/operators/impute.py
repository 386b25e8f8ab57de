"""Filling missing values: mean, median, mode, automatic choice, and ordered fills."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    col, field, is_numeric, number, present, replace_columns, scalar_columns, targets, tidy,
)
from .counts import modes
from .fit import scalars
from .quantiles import quantiles
from .ranges import ordered_buckets

STRATEGIES = ("auto", "mean", "median", "mode", "forward_fill", "backward_fill")
Z_LIMIT = 3


def impute(
    df: DataFrame,
    column: str | list[str] | None = None,
    strategy: str = "auto",
    order_by: str | list[str] | None = None,
    partition_by: str | list[str] | None = None,
    approx: bool = False,
) -> DataFrame:
    """Fill missing values. The ordered strategies need ``order_by``, a key without ties."""
    if strategy in ("forward_fill", "backward_fill"):
        names = targets(df, column, scalar_columns(df))
        return ordered_fill(df, names, order_by, partition_by, strategy == "forward_fill")
    return apply_impute(df, fit_impute(df, column, strategy, approx))


def fit_impute(
    df: DataFrame,
    column: str | list[str] | None = None,
    strategy: str = "auto",
    approx: bool = False,
) -> dict[str, dict[str, Any]]:
    """The fill value per column that has missing values.

    Mean and median on a non-numeric column fall back to the mode. ``auto`` takes the mode of
    non-numeric columns, the median of numeric ones with a z-score beyond 3, else the mean.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
    if strategy in ("forward_fill", "backward_fill"):
        raise ValueError(f"{strategy} has no fill value to fit; use ordered_fill")
    names = targets(df, column, scalar_columns(df))
    values, wanted = tidy(df, names), {}
    for name in names:
        wanted[name, "missing"] = F.count_if(present(values, name).isNull())
        wanted[name, "count"] = F.count(present(values, name))
        if is_numeric(field(df, name).dataType):
            v = number(values, name)
            wanted[name, "mean"] = F.avg(v)
            far = F.greatest(F.max(v) - F.avg(v), F.avg(v) - F.min(v))
            wanted[name, "far"] = far / F.when(F.stddev(v) > 0, F.stddev(v))
    seen = scalars(values, wanted)

    chosen: dict[str, str] = {}
    for name in names:
        if not seen[name, "missing"] or not seen[name, "count"]:
            continue
        if not is_numeric(field(df, name).dataType):
            chosen[name] = "mode"
        elif strategy == "auto":
            chosen[name] = "median" if (seen[name, "far"] or 0) > Z_LIMIT else "mean"
        else:
            chosen[name] = strategy

    by_median = [n for n, s in chosen.items() if s == "median"]
    medians = quantiles(
        df, {n: [0.5] for n in by_median}, {n: seen[n, "count"] for n in by_median}, approx
    )
    common = modes(df, [n for n, s in chosen.items() if s == "mode"])
    value_of = {
        "mean": lambda n: seen[n, "mean"],
        "median": lambda n: medians[n][0.5],
        "mode": lambda n: common[n],
    }
    return {n: {"strategy": s, "value": value_of[s](n)} for n, s in chosen.items()}


def apply_impute(df: DataFrame, params: dict[str, dict[str, Any]]) -> DataFrame:
    def filled(name: str) -> Column:
        value = params[name]["value"]
        if params[name]["strategy"] == "mode":
            return F.coalesce(present(df, name), F.lit(value).cast(field(df, name).dataType))
        return F.coalesce(number(df, name), F.lit(value))

    return replace_columns(df, {name: filled(name) for name in params if name in df.columns})


def ordered_fill(
    df: DataFrame,
    names: list[str],
    order_by: str | list[str] | None,
    partition_by: str | list[str] | None = None,
    forward: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Carry the last present value forward (or the next one backward) in ``order_by`` order.

    Rows are cut into ordered buckets over (partition_by, order_by). Inside a bucket a window
    fills the gaps; the value that enters a bucket comes from a table of one row per bucket.
    Neither a table without a partition key nor one huge key ends up in a single task.
    """
    if not order_by:
        raise ValueError("ordered fills need order_by: a table has no order of its own")
    orders = [order_by] if isinstance(order_by, str) else list(order_by)
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    keys = parts + orders
    key = F.struct(*[col(k) for k in keys])
    group = F.struct(F.lit(1), *[col(p) for p in parts])
    bucket = ordered_buckets(df, keys, buckets)
    ordered = [col(o) for o in orders]
    so_far = (Window.unboundedPreceding, Window.currentRow)

    def places(rows: DataFrame, by: list[Column]) -> tuple[DataFrame, Window]:
        """Rows with the window whose last present value fills a gap. Backward fills walk the same order from
        its end: a frame that reaches to the end would be read anew for every row."""
        window = Window.partitionBy(*by).orderBy(*ordered)
        if forward:
            return rows, window.rowsBetween(*so_far)
        placed = rows.withColumn("__place", F.row_number().over(window))
        return placed, Window.partitionBy(*by).orderBy(F.desc("__place")).rowsBetween(*so_far)

    def last_present(n: str, window: Window) -> Column:
        return F.last(present(df, n), ignorenulls=True).over(window)

    if bucket is None:  # small enough for a plain window
        rows, window = places(df, [col(p) for p in parts])
        return replace_columns(rows, {n: last_present(n, window) for n in names}).select(
            *[col(c) for c in df.columns]
        )

    bucketed = df.withColumn("__bucket", bucket)
    edge = F.max_by if forward else F.min_by
    edges = bucketed.groupBy("__bucket").agg(*[
        edge(
            F.struct(group.alias("g"), present(df, n).alias("v")),
            F.when(present(df, n).isNotNull(), key),
        ).alias(f"__e{i}")
        for i, n in enumerate(names)
    ])
    # one row per bucket (at most ranges.MAX_BUCKETS): safe in one task and safe to broadcast
    across = Window.orderBy(F.asc("__bucket") if forward else F.desc("__bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = edges.select(F.col("__bucket").alias("__from"), *[
        F.last(f"__e{i}", ignorenulls=True).over(across).alias(f"__c{i}") for i in range(len(names))
    ])

    # null-safe: from a plain equality the optimizer may infer filters on the rows' keys for the other side
    joined = bucketed.join(F.broadcast(carried), F.col("__bucket").eqNullSafe(F.col("__from")), "left")
    joined, inside = places(joined, [F.col("__bucket"), *[col(p) for p in parts]])
    new = {}
    for i, n in enumerate(names):
        # the carried value belongs to this row only if it comes from the same group
        entering = F.when(F.col(f"__c{i}.g").eqNullSafe(group), F.col(f"__c{i}.v"))
        new[n] = F.coalesce(last_present(n, inside), entering)
    return replace_columns(joined, new).select(*[col(c) for c in df.columns])
