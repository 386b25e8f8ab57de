"""Numeric repair: infinities, inter-quartile outliers, skewness, missing numbers to zero."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    field, is_floating, number, numeric_columns, present, replace_columns, targets, tidy,
)
from ..functions.stats import skewness
from .fit import scalars
from .quantiles import quantiles

OUTLIER_STRATEGIES = ("clip", "median", "nan")
FENCE = 1.5
SKEW_THRESHOLD = 1.0


def fix_infinite(df: DataFrame, column=None) -> DataFrame:
    """Infinities and NaN become NULL; only float and double columns can hold them."""
    names = targets(df, column, [f.name for f in df.schema if is_floating(f.dataType)])
    infinite = [float("inf"), float("-inf")]
    return replace_columns(df, {
        n: F.when(~present(df, n).isin(infinite), present(df, n)) for n in names
    })


def handle_outliers(df: DataFrame, column=None, strategy: str = "clip", approx: bool = False):
    """Treat values beyond 1.5 inter-quartile ranges: clip, replace by the median, or blank."""
    return apply_outliers(df, fit_outliers(df, column, strategy, approx))


def fit_outliers(
    df: DataFrame, column=None, strategy: str = "clip", approx: bool = False
) -> dict[str, dict[str, Any]]:
    if strategy not in OUTLIER_STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {OUTLIER_STRATEGIES}")
    names = targets(df, column, numeric_columns(df))
    params = {}
    for n, q in quantiles(df, {n: [0.25, 0.5, 0.75] for n in names}, approx=approx).items():
        if q[0.5] is not None:
            low, high = fences(q[0.25], q[0.75])
            params[n] = {"low": low, "high": high, "median": q[0.5], "strategy": strategy}
    return params


def fences(q1: float, q3: float) -> tuple[float, float]:
    return q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)


def apply_outliers(df: DataFrame, params: dict[str, dict[str, Any]]) -> DataFrame:
    def treated(name: str) -> Column:
        p, value = params[name], number(df, name)
        low, high = F.lit(p["low"]), F.lit(p["high"])
        if p["strategy"] == "clip":
            return F.when(value < low, low).when(value > high, high).otherwise(value)
        instead = F.lit(p["median"] if p["strategy"] == "median" else None).cast("double")
        return F.when((value < low) | (value > high), instead).otherwise(value)

    return replace_columns(df, {n: treated(n) for n in params if n in df.columns})


def handle_skewness(df: DataFrame, column=None, threshold: float = SKEW_THRESHOLD) -> DataFrame:
    """log1p of columns whose skewness exceeds the threshold, shifted when the minimum is <= 0."""
    return apply_skewness(df, fit_skewness(df, column, threshold))


def fit_skewness(df: DataFrame, column=None, threshold: float = SKEW_THRESHOLD) -> dict[str, Any]:
    names = targets(df, column, numeric_columns(df))
    values = tidy(df, names)
    wanted = {(n, "skew"): skewness(number(values, n)) for n in names}
    wanted |= {(n, "min"): F.min(number(values, n)) for n in names}
    seen = scalars(values, wanted)
    params = {}
    for n in names:
        if seen[n, "skew"] is not None and abs(seen[n, "skew"]) > threshold:
            low = seen[n, "min"]
            params[n] = {"skew": seen[n, "skew"], "low": low, "shift": None if low > 0 else low}
    return params


def apply_skewness(df: DataFrame, params: dict[str, dict[str, Any]]) -> DataFrame:
    """On other rows than those of the fit, values below the fitted minimum count as the minimum."""
    def logged(name: str) -> Column:
        shift, low, value = params[name]["shift"], F.lit(params[name]["low"]), number(df, name)
        value = F.when(value < low, low).otherwise(value)
        return F.log1p(value) if shift is None else F.log1p(value - F.lit(shift) + 1)

    return replace_columns(df, {n: logged(n) for n in params if n in df.columns})


def fill_numeric_with_zero(df: DataFrame, column=None) -> DataFrame:
    """Every missing number becomes 0."""
    names = targets(df, column, numeric_columns(df))
    return replace_columns(df, {
        n: F.coalesce(present(df, n), F.lit(0).cast(field(df, n).dataType)) for n in names
    })
