"""Distinct values and frequent values from mergeable sketches: no value travels but in a bounded summary.

Distinct values: a theta sketch keeps the smallest hashes it has met, so it counts exactly up to its size
and estimates beyond, and "more than k?" has a sure answer for any k well below that size. Shares near a
threshold, where an estimate cannot tell, are counted exactly.

Frequent values: a task's summary holds at most ``tracked`` values; a count in it is too high by at most the
share ``slack`` of all rows, and a value that it does not return is on at most twice that share. If the k-th
estimate is above three times the slack, the k most frequent values are therefore among those whose
estimate is within the slack of it: they are few, and a second scan counts them exactly. If it is not,
summaries of more values are tried, and a column that is too even for those is counted in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distinct_key, field, is_scalar
from ..functions.rowkey import value_key
from .checkpoints import stored
from .fit import scalars

SMALL_ROWS = 1_000_000  # below it counting every value costs less than a scan for summaries
TRACKED = (8_192, 131_072)
EVERY_VALUE = 2_048  # so few distinct values are all counted
SPREAD = 0.1  # an estimate this far from a threshold decides


def text_key(df: DataFrame, name: str) -> Column:
    """The value as a text of its own, never empty; NULL if missing."""
    key, dtype = distinct_key(df, name), field(df, name).dataType
    return F.concat(F.lit("="), value_key(key, dtype) if is_scalar(dtype) else key)


def estimates(df: DataFrame, names: list[str], size: int) -> dict[str, int]:
    """Distinct present values per column: exact up to ``size`` of them, estimated beyond."""
    bits = min(26, max(12, (size - 1).bit_length()))
    return scalars(df, {
        n: F.theta_sketch_estimate(F.theta_sketch_agg(text_key(df, n), F.lit(bits))) for n in names
    }) if names else {}


def few_distinct(df: DataFrame, names: list[str], most: int) -> dict[str, int | None]:
    """Distinct present values per column, None above ``most``."""
    found = estimates(df, names, 2 * most)
    return {n: found[n] if found[n] <= most else None for n in names}


def distinct_at_least(df: DataFrame, names: list[str], least: dict[str, float], exact) -> list[str]:
    """The columns with at least ``least`` distinct present values; ``exact(df, names)`` counts those whose
    estimates are near it."""
    found = estimates(df, names, 1 << 14)
    near = [n for n in names if abs(found[n] - least[n]) <= SPREAD * max(found[n], least[n])]
    found |= exact(df, near)
    return [n for n in names if found[n] >= least[n]]


def candidates(cells: DataFrame, k: int) -> tuple[set[str], DataFrame | None]:
    """From ``(column, key)``: the columns whose ``k`` most frequent keys are among the returned
    ``(column, key)`` for sure, and those. The other columns are to be counted in full."""
    sure: set[str] = set()
    found, left = None, cells
    for tracked in TRACKED:
        slack = 3.5 * 0.75 / tracked * F.col("n")
        items = f"approx_top_k(key, {tracked}, {tracked})"
        summary = stored(left.groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.expr(items).alias("items"),
            F.theta_sketch_estimate(F.theta_sketch_agg("key", F.lit(12))).alias("distinct"),
        ).select(
            "column", slack.alias("slack"), "items", "distinct",
            F.get("items", F.lit(k - 1))["count"].alias("last"),
        ))
        proven = (F.col("distinct") > EVERY_VALUE) & (F.col("last") > 3 * F.col("slack"))
        part = summary.where(proven).select("column", F.explode(F.filter(
            "items", lambda x: x["count"] >= F.col("last") - F.col("slack")
        )).alias("x")).select("column", F.col("x.item").alias("key"))
        state = summary.select("column", proven.alias("proven"), "distinct").collect()  # a row a column
        sure |= {r["column"] for r in state if r["proven"]}
        found = part if found is None else found.unionByName(part)
        open_columns = [r["column"] for r in state if not r["proven"] and r["distinct"] > EVERY_VALUE]
        if not open_columns:
            break
        left = cells.where(F.col("column").isin(open_columns))
    return sure, found if sure else None
