"""The numbers behind charts, over the whole table: no sampling, no drawing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    col, number, numeric_columns, present, replace_columns, scalar_columns, string_columns, targets, tidy,
)
from ..functions.text import first_category
from ..functions.words import LOOSE_CATEGORIES, STRICT_CATEGORIES
from .checkpoints import stored
from .counts import long_columns, picked_values, top_counts
from .fit import compiled_methods, scalars
from .numeric import fences
from .profile import per_column
from .quantiles import quantiles

BINS = 30
CHART_CATEGORIES = 20
CHART_COLUMNS = 10
MISSING_LABEL = "<NULL>"
RUN_TOGETHER = 100
GRID = 99
BOX = (
    "column string, q1 double, median double, q3 double, whisker_low double, whisker_high double, outliers bigint"
)


def histogram(df: DataFrame, column=None, bins: int = BINS) -> DataFrame:
    """``(column, bin, low, high, n)``: equal-width bins between the least and the largest finite value,
    the last one closed; a column with one value has one bin. Empty bins have no row. Infinities are
    counted in bins of their own, 0 below and ``bins + 1`` above, whose bounds they are."""
    names = targets(df, column, numeric_columns(df))
    df = tidy(df, names)
    infinite = {n: F.abs(number(df, n)) == float("inf") for n in names}
    finite = {n: F.when(~infinite[n], number(df, n)) for n in names}
    seen = scalars(df, {(n, k): f(finite[n]) for n in names for k, f in (("min", F.min), ("max", F.max))})
    cells = []
    for n in names:
        low, high = seen[n, "min"], seen[n, "max"]
        v = number(df, n)
        if low is None:
            low, place, width = 0.0, F.lit(1), 0.0
        elif low == high:
            place, width = F.lit(1), 0.0
        else:
            half = high / 2 - low / 2  # the whole difference may be beyond a double
            share = (finite[n] / 2 - F.lit(low / 2)) / F.lit(half) if half * 2 == float("inf") \
                else (finite[n] - F.lit(low)) / F.lit(high - low)
            place, width = F.least(F.floor(share * bins) + 1, F.lit(bins)), half / bins * 2
        place = F.when(infinite[n], F.when(v < 0, 0).otherwise(bins + 1)).otherwise(place)
        cells.append(F.when(v.isNotNull(), F.struct(
            F.lit(n).alias("column"), place.cast("int").alias("bin"),
            F.when(infinite[n], v).otherwise(F.lit(low)).alias("__low"),
            F.when(infinite[n], 0.0).otherwise(F.lit(width)).alias("__width"),
        )))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, n long")
    return (
        df.select(F.inline(F.array_compact(F.array(*cells))))
        .groupBy("column", "bin", "__low", "__width").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "column", "bin",
            (F.col("__low") + (F.col("bin") - 1) * F.col("__width")).alias("low"),
            (F.col("__low") + F.col("bin") * F.col("__width")).alias("high"),
            "n",
        )
    )


def box_plot(df: DataFrame, column=None, approx: bool = False) -> DataFrame:
    """Quartiles, whiskers at the furthest values inside the fences, outliers beyond them. Columns without
    values have no row."""
    names = targets(df, column, numeric_columns(df))
    q = quantiles(df, {n: [0.25, 0.5, 0.75] for n in names}, approx=approx)
    names = [n for n in names if q[n][0.5] is not None]
    if not names:
        return df.sparkSession.createDataFrame([], BOX)

    def measures(values: DataFrame, n: str) -> dict[str, Column]:
        low, high = fences(q[n][0.25], q[n][0.75])
        v = number(values, n)
        inside = F.when((v >= F.lit(low)) & (v <= F.lit(high)), v)
        return {
            "q1": F.lit(q[n][0.25]), "median": F.lit(q[n][0.5]), "q3": F.lit(q[n][0.75]),
            "whisker_low": F.min(inside), "whisker_high": F.max(inside),
            "outliers": F.count(v) - F.count(inside),
        }

    return per_column(df, names, measures).drop("position")


def top_categories(
    df: DataFrame, column=None, k: int = CHART_CATEGORIES, missing_label: str = MISSING_LABEL
) -> DataFrame:
    """``(column, rank, value, n)`` for the first ten string columns, missing values labelled."""
    names = string_columns(df)[:CHART_COLUMNS] if column is None \
        else targets(df, column, scalar_columns(df))
    top = top_counts(df, names, k, with_missing=True, by_digest=True)
    shown = picked_values(df, names, top, long_columns(df, names))
    value = F.coalesce("value", F.lit(missing_label))
    return shown.select("column", "rank", value.alias("value"), "n")


def correlations(df: DataFrame, column=None) -> DataFrame:
    """``(col_a, col_b, corr)`` for every ordered pair of numeric columns, over the rows where both are
    present; 0 where either has no spread there.

    Each task adds up, as matrix products over its Arrow batches, the counts, sums and products of all
    pairs, so what is written and shuffled is one row a pair and task, however many rows or columns there are.
    """
    names = targets(df, column, numeric_columns(df))
    if not names:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    values = df.select(F.array(*[col(n).cast("double") for n in names]).alias("row"))  # a matrix a batch
    with compiled_methods(df.sparkSession):
        parts = stored(values.mapInArrow(_pair_sums(len(names)), PAIR))
    # parts have sums around means of their own; a middle of these is the centre of them all
    pair = Window.partitionBy("a", "b")
    dx, dy = F.col("mx") - F.avg("mx").over(pair), F.col("my") - F.avg("my").over(pair)
    n = F.col("n")
    near = parts.select("a", "b", "n", "mx", "my", dx.alias("dx"), dy.alias("dy"), "xx", "yy", "xy")
    total = near.groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.sum(n * F.col("dx")).alias("x"), F.sum(n * F.col("dy")).alias("y"),
        F.sum(F.col("xx") + n * F.col("dx") * F.col("dx")).alias("xx"),
        F.sum(F.col("yy") + n * F.col("dy") * F.col("dy")).alias("yy"),
        F.sum(F.col("xy") + n * F.col("dx") * F.col("dy")).alias("xy"),
        F.max(F.abs("mx")).alias("mx"), F.max(F.abs("my")).alias("my"),
    )

    def variance(squares: str, off: str, mean: str) -> Column:
        v = (F.col(squares) - F.col(off) * F.col(off) / n) / n
        return F.when(v > F.pow(mean, F.lit(2)) * F.lit(1e-22), v)  # the rest is rounding of equal values

    covariance = (F.col("xy") - F.col("x") * F.col("y") / n) / n
    spread = F.sqrt(variance("xx", "x", "mx")) * F.sqrt(variance("yy", "y", "my"))
    corr = F.coalesce(F.try_divide(covariance, spread), F.lit(0.0))
    every = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("a"))
    sums = every.select("a", F.explode(F.sequence(F.col("a"), F.lit(len(names) - 1))).alias("b")).join(
        total, ["a", "b"], "left"
    )
    label = F.array(*[F.lit(x) for x in names])
    one, two = F.get(label, F.col("a")), F.get(label, F.col("b"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(one.alias("col_a"), two.alias("col_b")))) \
        .otherwise(F.array(F.struct(one.alias("col_a"), two.alias("col_b")),
                           F.struct(two.alias("col_a"), one.alias("col_b"))))
    return sums.select(F.inline(both), corr.alias("corr"))


PAIR = "a int, b int, n double, mx double, my double, xx double, yy double, xy double"


def _pair_sums(m: int):
    """For every pair of columns the rows where both are present, the means there, and the sums of squares and
    products around them: one row a pair and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares, products = (np.zeros((m, m)) for _ in range(4))
        shift = None  # near the values, so that little cancels
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            gaps = np.isnan(x)  # NULL as well
            if shift is None:
                shift = np.array([np.median(c[~g]) if not g.all() else 0.0 for c, g in zip(x.T, gaps.T)])
                shift[~np.isfinite(shift)] = 0
            x = x - shift
            if gaps.any():
                x[gaps] = 0
                there = (~gaps).astype(np.float64)
                n += there.T @ there
                sums += x.T @ there
                squares += (x * x).T @ there
            else:  # all rows count for every pair
                n += len(x)
                sums += x.sum(axis=0)[:, None]
                squares += (x * x).sum(axis=0)[:, None]
            products += x.T @ x
        if shift is None:
            return
        a, b = np.triu_indices(m)
        many = n[a, b]
        a, b, many = a[many > 0], b[many > 0], many[many > 0]
        x, y = sums[a, b] / many, sums[b, a] / many
        columns = [
            many, x + shift[a], y + shift[b], squares[a, b] - many * x * x, squares[b, a] - many * y * y,
            products[a, b] - many * x * y,
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *[pa.array(c) for c in columns]],
            ["a", "b", "n", "mx", "my", "xx", "yy", "xy"],
        )

    return run


def missing_patterns(df: DataFrame, column=None) -> DataFrame:
    """``(pattern, n)``: one character per column, 1 where missing, and the rows that share it."""
    names = targets(df, column, scalar_columns(df))
    marks = [F.when(present(df, n).isNull(), "1").otherwise("0") for n in names]
    return df.groupBy(F.concat(*marks).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame) -> DataFrame:
    """``(column, missing)`` for every column."""
    names = scalar_columns(df)
    return per_column(
        df, names, lambda values, n: {"missing": F.count_if(present(values, n).isNull())}
    ).drop("position")


def normal_quantiles(df: DataFrame, column=None, points: int = GRID, approx: bool = False) -> DataFrame:
    """``(column, p, theoretical, observed)`` on an even grid of at most 100 probabilities."""
    if not 1 <= points <= 100:
        raise ValueError("points must be between 1 and 100")
    grid = [i / (points + 1) for i in range(1, points + 1)]
    names = targets(df, column, numeric_columns(df))
    found = quantiles(df, {n: grid for n in names}, approx=approx)
    rows = [
        (n, p, NormalDist().inv_cdf(p), found[n][p])  # points rows per column
        for n in names for p in grid if found[n][p] is not None
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, p double, theoretical double, observed double"
    )


def compare_normal_quantiles(before: DataFrame, after: DataFrame, column: str, points: int = GRID):
    """Q-Q points of one column on both sides, on the same grid."""
    b = normal_quantiles(before, column, points).withColumnRenamed("observed", "before")
    a = normal_quantiles(after, column, points).select("column", "p", F.col("observed").alias("after"))
    return b.join(F.broadcast(a), ["column", "p"], "left")


def repair_run_together(
    df: DataFrame,
    column=None,
    keywords: Sequence[str] = STRICT_CATEGORIES,
    any_case: bool = False,
    longest: int = RUN_TOGETHER,
) -> DataFrame:
    """Where a string column holds values above 100 characters, reduce every value to the first
    keyword it contains, else its first 20 characters."""
    names = targets(df, column, string_columns(df))
    seen = scalars(df, {n: F.max(F.length(present(df, n))) for n in names})
    long = [n for n in names if (seen[n] or 0) > longest]
    if any_case:
        lowered = {n: f"__lower_{n}" for n in long}
        wide = df.select("*", *[F.lower(col(n)).alias(low) for n, low in lowered.items()])
    else:
        lowered, wide = {n: n for n in long}, df
    repaired = {n: first_category(col(n), col(lowered[n]), keywords, any_case) for n in long}
    return replace_columns(wide, repaired).select(*[col(n) for n in df.columns])


def repair_run_together_loose(df: DataFrame, column=None) -> DataFrame:
    """The chart form: more keywords, any case."""
    return repair_run_together(df, column, LOOSE_CATEGORIES, any_case=True)
