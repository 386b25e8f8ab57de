"""Parsing dates and splitting them into integer parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    col, field, is_datetime, is_numeric, replace_columns, string_columns, targets,
)
from .typing import datetime_columns

# Formats tried in order after ISO 8601.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy")


def parse_datetime(
    df: DataFrame, column: str, formats: Sequence[str] | None = None
) -> Column:
    """The column as a timestamp; a value that fits no format is NULL.

    Numbers are seconds since 1970 (UTC); other types than texts and dates are all NULL.
    """
    c = col(column)
    dtype = field(df, column).dataType
    if is_datetime(dtype):
        return c
    if is_numeric(dtype):
        return c.try_cast("double").try_cast("timestamp")
    if column not in string_columns(df):
        return F.lit(None).cast("timestamp")
    if formats:
        tries = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    else:
        tries = [c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS]]
    return F.coalesce(*tries)


def parse_datetimes(df: DataFrame, column=None, formats: Sequence[str] | None = None) -> DataFrame:
    names = _names(df, column)
    return replace_columns(df, {n: parse_datetime(df, n, formats) for n in names})


def handle_datetime(
    df: DataFrame,
    column=None,
    formats: Sequence[str] | None = None,
    keep_original: bool = False,
    is_weekend: bool = False,
    quarter: bool = False,
) -> DataFrame:
    """Replace each date column by year, month, day, weekday (Monday is 0) and hour columns."""
    new: dict[str, list[Column]] = {}
    for name in _names(df, column):
        at = parse_datetime(df, name, formats)
        parts = {
            "year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at),
            "weekday": F.weekday(at), "hour": F.hour(at),
        }
        if is_weekend:
            parts["is_weekend"] = F.weekday(at) >= 5
        if quarter:
            parts["quarter"] = F.quarter(at)
        kept = [col(name)] if keep_original else []
        new[name] = kept + [c.alias(f"{name}_{part}") for part, c in parts.items()]
    return replace_columns(df, new)


def _names(df: DataFrame, column) -> list[str]:
    """Without names given, dates and the texts that look like them: a number is not a date just
    because its column is called one."""
    if column is not None:
        return targets(df, column, df.columns)
    texts = string_columns(df)
    return [n for n in datetime_columns(df) if n in texts or is_datetime(field(df, n).dataType)]
