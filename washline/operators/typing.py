"""Which operator applies to which column: logical types and column tests."""

from __future__ import annotations

import re
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    col, field, is_datetime, is_numeric, number, string_columns, targets,
)
from ..functions.text import token_count
from ..functions.words import CATEGORY_PARTS, DATETIME_PARTS, IDENTIFIER_PARTS, IDENTIFIER_WORDS
from .counts import distinct_counts
from .fit import scalars
from .frequent import distinct_at_least, few_distinct

DIGIT_LIKE = r"^(?:\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)\z"  # digits with at most one dot
MAX_DIGIT_SHARE = 0.8
MIN_MEAN_LENGTH = 15
MIN_MEAN_WORDS = 3
MIN_DISTINCT_SHARE = 0.05
MAX_SHORT_CATEGORIES = 20


def logical_types(df: DataFrame) -> dict[str, str]:
    """``numerical`` or ``categorical`` per column; booleans and everything else are categorical."""
    return {
        f.name: "numerical" if is_numeric(f.dataType) else "categorical" for f in df.schema
    }


def identifier_columns(df: DataFrame) -> list[str]:
    """Columns whose name contains an identifier word as a whole word (split at non-letters)."""
    found = []
    for name in df.columns:
        plain = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
        if any(re.search(rf"(^|_){word}(_|$)", plain) for word in IDENTIFIER_WORDS):
            found.append(name)
    return found


def drop_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*[col(n) for n in identifier_columns(df)])


def datetime_columns(df: DataFrame) -> list[str]:
    """Date and timestamp columns, and those whose name says date or time."""
    return [
        f.name for f in df.schema
        if is_datetime(f.dataType) or any(part in f.name.lower() for part in DATETIME_PARTS)
    ]


def name_allows_text(name: str) -> bool:
    lowered = name.lower()
    return not any(part in lowered for part in [*IDENTIFIER_PARTS, *CATEGORY_PARTS])


def text_measures(df: DataFrame, names: list[str]) -> dict[str, dict[str, Any]]:
    """Rows, share of digit-like values, mean length and mean words per column, in one scan."""
    wanted = {}
    for n in names:
        c = col(n)
        wanted[n, "rows"] = F.count(F.lit(1))
        wanted[n, "digit_share"] = F.avg(c.rlike(DIGIT_LIKE).cast("int"))
        wanted[n, "mean_length"] = F.avg(F.length(c))
        wanted[n, "mean_words"] = F.avg(token_count(c).cast("double"))
    seen = scalars(df, wanted)
    return {
        n: {k: seen[n, k] for k in ("rows", "digit_share", "mean_length", "mean_words")} for n in names
    }


def _wordy(name: str, m: dict[str, Any]) -> bool:
    """A name that allows text, few digit-like values, long and wordy."""
    return (
        name_allows_text(name)
        and m["mean_length"] is not None
        and m["digit_share"] <= MAX_DIGIT_SHARE
        and m["mean_length"] > MIN_MEAN_LENGTH
        and m["mean_words"] > MIN_MEAN_WORDS
    )


def long_text_columns(df: DataFrame, column=None, approx: bool = False) -> list[str]:
    """String columns that hold long text: wordy, and at least 5 % distinct values.

    One scan of the columns whose name allows text; distinct values are counted only for the
    wordy ones among them.
    """
    names = [n for n in targets(df, column, string_columns(df)) if name_allows_text(n)]
    seen = text_measures(df, names)
    wordy = [n for n in names if _wordy(n, seen[n])]
    least = {n: seen[n]["rows"] * MIN_DISTINCT_SHARE for n in wordy}
    return distinct_at_least(df, wordy, least, partial(distinct_counts, approx=approx))


def text_test(df: DataFrame, column=None, approx: bool = False) -> DataFrame:
    """The long-text test as a table: one row per string column with its measures and verdict."""
    names = targets(df, column, string_columns(df))
    seen = text_measures(df, names)
    distinct = distinct_counts(df, names, approx)
    rows = []
    for n in names:
        m = seen[n]
        share = distinct[n] / m["rows"] if m["rows"] else None
        verdict = _wordy(n, m) and share >= MIN_DISTINCT_SHARE
        rows.append((n, m["digit_share"], m["mean_length"], m["mean_words"], distinct[n], share, verdict))
    return df.sparkSession.createDataFrame(
        rows, "column string, digit_share double, mean_length double, mean_words double, "
        "distinct bigint, distinct_share double, is_text boolean"
    )


def short_categorical_columns(
    df: DataFrame, column=None, approx: bool = False, distinct: dict[str, int] | None = None
) -> list[str]:
    """String columns with fewer than 20 distinct values that are not long text.

    ``distinct`` are the distinct counts when the caller already has them. Only columns with few
    values are then read for the long-text test.
    """
    names = targets(df, column, string_columns(df))
    if distinct is None:
        distinct = few_distinct(df, names, MAX_SHORT_CATEGORIES)
    few = [n for n in names if distinct[n] is not None and distinct[n] < MAX_SHORT_CATEGORIES]
    text = set(long_text_columns(df, few, approx))
    return [n for n in few if n not in text]


def binary_test(df: DataFrame, name: str) -> Column:
    """Whether the present values are all 0 or 1 (numeric columns only)."""
    if not is_numeric(field(df, name).dataType):
        return F.lit(False)
    return F.coalesce(F.bool_and(number(df, name).isin(0.0, 1.0)), F.lit(True))


def binary_columns(df: DataFrame, column=None) -> list[str]:
    names = targets(df, column, [f.name for f in df.schema if is_numeric(f.dataType)])
    seen = scalars(df, {n: binary_test(df, n) for n in names})
    return [n for n in names if seen[n]]
