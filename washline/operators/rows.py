"""Dropping duplicate rows, constant columns and repeated column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    col, distinct_key, present, replace_columns, row_digest, scalar_columns, targets,
)
from .fit import scalars


def deduplicate(
    df: DataFrame,
    subset: str | list[str] | None = None,
    keep: str | bool = "first",
    order_by: str | list[str] | None = None,
) -> DataFrame:
    """One row per key: ``first`` or ``last`` in ``order_by``, or with ``keep=False`` only rows
    whose key occurs once.

    Without a subset the key is the whole row. Every form cuts a repeated key down to one row
    per input task before the shuffle.
    """
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    keys = [subset] if isinstance(subset, str) else list(subset or df.columns)
    if keep is False:
        return _only_unique(df, keys)
    if set(keys) == set(df.columns):
        return _distinct(df)
    if not order_by:
        raise ValueError("keep='first' or 'last' on a subset needs order_by")
    orders = [order_by] if isinstance(order_by, str) else list(order_by)
    sense = (lambda c: c.asc()) if keep == "first" else (lambda c: c.desc())
    # a row-number limit is applied on the map side too, before rows are shuffled by key
    place = F.row_number().over(
        Window.partitionBy(*[distinct_key(df, k) for k in keys]).orderBy(*[sense(col(o)) for o in orders])
    )
    return df.withColumn("__place", place).where(F.col("__place") == 1).drop("__place")


def _distinct(df: DataFrame) -> DataFrame:
    """Equal rows are alike, so a row-number limit keeps any one of them; it works on the map side too."""
    place = F.row_number().over(Window.partitionBy("__digest").orderBy(F.lit(1)))
    return (
        df.withColumn("__digest", row_digest(df, df.columns)).withColumn("__place", place)
        .where(F.col("__place") == 1).drop("__digest", "__place")
    )


def _only_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Digests are counted first; the rows are then kept by the digests that occur once."""
    keyed = df.withColumn("__digest", row_digest(df, keys))
    counted = keyed.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n"))
    once = counted.where(F.col("__n") == 1).select("__digest")
    return keyed.join(once, "__digest", "left_semi").select(*[col(c) for c in df.columns])


def fit_constant(df: DataFrame, column=None) -> list[str]:
    """Columns with at most one distinct present value; an all-missing column counts."""
    names = targets(df, column, scalar_columns(df))
    differs = scalars(df, {n: F.min(present(df, n)) < F.max(present(df, n)) for n in names})
    return [n for n in names if not differs[n]]


def drop_constant(df: DataFrame, column=None) -> DataFrame:
    return replace_columns(df, {n: None for n in fit_constant(df, column)})


def drop_repeated_names(df: DataFrame) -> DataFrame:
    """Keep the first of columns that share a name."""
    unique = [f"c{i}" for i in range(len(df.columns))]
    first = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    renamed = df.toDF(*unique)
    return renamed.select(*[F.col(unique[i]).alias(n) for n, i in sorted(first.items(), key=lambda x: x[1])])
