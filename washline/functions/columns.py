"""Schema walks and per-column expressions shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rowkey import digest, value_key

ROLE = "role"  # StructField.metadata key; values "label" and "onehot"
TIDY = "tidy"  # StructField.metadata key: NaN is already NULL in this column
LONG = 64  # texts above this many characters are counted by digest


def col(name: str) -> Column:
    """Column by exact name, whatever dots, spaces or backticks it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, name: str) -> T.StructField:
    return df.schema[name]


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_scalar(dtype: T.DataType) -> bool:
    """Types that can be grouped, ordered and printed; nested types pass through untouched."""
    return isinstance(dtype, T.AtomicType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_scalar(f.dataType)]


def role(df: DataFrame, name: str) -> str | None:
    return field(df, name).metadata.get(ROLE)


def targets(df: DataFrame, column: str | Iterable[str] | None, eligible: list[str]) -> list[str]:
    """Resolve a ``column`` argument: None is every eligible column, else the eligible ones named."""
    if column is None:
        return eligible
    names = [column] if isinstance(column, str) else list(column)
    for name in names:
        if name not in df.columns:
            raise ValueError(f"no column {name!r}")
    return [name for name in names if name in eligible]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing, so that missing means NULL everywhere after."""
    c = col(name)
    f = field(df, name)
    if not is_floating(f.dataType) or f.metadata.get(TIDY):
        return c
    return F.nanvl(c, F.lit(None).cast(f.dataType))


def number(df: DataFrame, name: str) -> Column:
    """The column as a double, NaN read as missing."""
    return present(df, name).cast("double")


def tidy(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The named columns with NaN as NULL, worked out once per row and not once per aggregate."""
    return df.select(*[
        present(df, n).alias(n, metadata={TIDY: True}) if is_floating(field(df, n).dataType) else col(n)
        for n in (df.columns if names is None else names)
    ])


def replace_columns(df: DataFrame, new: dict[str, Column | list[Column] | None]) -> DataFrame:
    """One projection over the whole table: swap, expand or drop (None) the named columns."""
    out: list[Column] = []
    for name in df.columns:
        if name not in new:
            out.append(col(name))
        elif isinstance(new[name], list):
            out.extend(new[name])
        elif new[name] is not None:
            out.append(new[name].alias(name))
    return df.select(*out)


def distinct_key(df: DataFrame, name: str) -> Column:
    """A key equal exactly when the values are equal, at most 65 characters wide; NULL if missing.

    Comparing long texts and nested values then sorts and shuffles digests, not the values.
    """
    dtype = field(df, name).dataType
    if not is_scalar(dtype):
        return F.sha2(value_key(col(name), dtype).cast("binary"), 256)
    c = present(df, name)
    if isinstance(dtype, T.StringType):
        return F.when(F.length(c) > LONG, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)
    return c


def row_digest(df: DataFrame, keys: Iterable[str]) -> Column:
    """256 bits equal exactly when the keys are: whole rows are never hashed, sorted or shuffled as
    keys, and maps and missing values compare as well."""
    def key(name: str) -> Column:
        c, dtype = distinct_key(df, name), field(df, name).dataType
        return value_key(c, dtype) if is_scalar(dtype) else c

    return digest([key(name) for name in keys])


def no_value(dtype: str) -> Column:
    return F.lit(None).cast(dtype)
