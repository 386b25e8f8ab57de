"""Scaling numeric columns: min-max, quantile range, z-score, robust."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number, numeric_columns, replace_columns, targets, tidy
from .fit import scalars
from .quantiles import quantiles

# method -> (centre, spread); quantile names are probabilities
METHODS = ("minmax", "quantile_range", "standard", "robust")


def normalize(df: DataFrame, column=None, method: str = "minmax", on_constant: str = "zero",
              approx: bool = False) -> DataFrame:
    """Scale to the column's range: ``minmax`` or ``robust``, which uses the middle half."""
    method = {"minmax": "minmax", "robust": "quantile_range"}.get(method, method)
    return apply_scale(df, fit_scale(df, column, method, on_constant, approx))


def standardize(df: DataFrame, column=None, method: str = "standard", on_constant: str = "zero",
                approx: bool = False) -> DataFrame:
    """``standard`` is (x - mean) / sample std, ``robust`` is (x - median) / IQR."""
    method = {"standardize": "standard"}.get(method, method)
    return apply_scale(df, fit_scale(df, column, method, on_constant, approx))


def fit_scale(
    df: DataFrame, column=None, method: str = "standard", on_constant: str = "zero",
    approx: bool = False,
) -> dict[str, dict[str, Any]]:
    """Centre and spread per column; one scan for minmax and standard."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    if on_constant not in ("zero", "keep"):
        raise ValueError("on_constant must be 'zero' or 'keep'")
    names = targets(df, column, numeric_columns(df))
    if method in ("minmax", "standard"):
        pair = (
            (lambda v: F.min(v), lambda v: F.max(v) - F.min(v)) if method == "minmax"
            else (lambda v: F.avg(v), lambda v: F.stddev(v))
        )
        values = tidy(df, names)
        seen = scalars(values, {
            (n, part): f(number(values, n)) for n in names for part, f in zip(("centre", "spread"), pair)
        })
        found = {n: (seen[n, "centre"], seen[n, "spread"]) for n in names}
    else:
        found = {}
        for n, q in quantiles(df, {n: [0.25, 0.5, 0.75] for n in names}, approx=approx).items():
            centre = q[0.25] if method == "quantile_range" else q[0.5]
            found[n] = (centre, None if centre is None else q[0.75] - q[0.25])
    return {
        n: {"centre": centre, "spread": spread, "on_constant": on_constant}
        for n, (centre, spread) in found.items()
    }


def apply_scale(df: DataFrame, params: dict[str, dict[str, Any]]) -> DataFrame:
    """Project every fitted column; without spread a column becomes 0.0 on every row."""
    def scaled(name: str) -> Column:
        p, value = params[name], number(df, name)
        if p["spread"] is None:
            return F.lit(None).cast("double")
        if p["spread"] == 0:
            return F.lit(0.0) if p["on_constant"] == "zero" else value
        return (value - F.lit(p["centre"])) / F.lit(p["spread"])

    return replace_columns(df, {n: scaled(n) for n in params if n in df.columns})
