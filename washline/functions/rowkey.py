"""Lossless keys: texts that are equal exactly when two values are, whatever their type.

Every part of a key carries its length and whether it is missing, so parts cannot run into each other.
Instants count microseconds since 1970 and do not depend on the session's time zone or on the digits that a
format shows; numbers are written so that reading them back gives the same number, with one zero and one
NaN; the entries of a map are sorted; arrays, structs and maps are taken apart to any depth.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value_key(c: Column, dtype: T.DataType) -> Column:
    """The value as text, NULL if it is missing; equal texts for equal values of one type."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0).cast(dtype)).cast("string")  # a negative zero is a zero
    if isinstance(dtype, T.ArrayType):
        return F.concat(F.size(c).cast("string"), F.lit("["), _joined(F.transform(c, _part_of(dtype.elementType))))
    if isinstance(dtype, T.StructType):
        inside = F.concat(F.lit("("), *[part(c[f.name], f.dataType) for f in dtype])
        return F.when(c.isNotNull(), inside)
    if isinstance(dtype, T.MapType):
        key, value = _part_of(dtype.keyType), _part_of(dtype.valueType)
        entries = F.transform(F.map_entries(c), lambda e: F.concat(key(e["key"]), value(e["value"])))
        return F.concat(F.size(c).cast("string"), F.lit("{"), _joined(F.array_sort(entries)))
    if isinstance(dtype, VectorUDT):  # dense and sparse forms of one vector are equal
        return value_key(vector_to_array(c), T.ArrayType(T.DoubleType()))
    return c.cast("string")  # whole numbers, decimals, booleans, times without a zone, intervals


def part(c: Column, dtype: T.DataType) -> Column:
    """``value_key`` with its length before it, and a mark of its own if it is missing."""
    return sized(value_key(c, dtype))


def sized(key: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(key).cast("string"), F.lit(":"), key), F.lit("-"))


def digest(keys: Iterable[Column]) -> Column:
    """256 bits equal exactly when all of the keys are, in their order."""
    return F.sha2(F.concat(*[sized(k) for k in keys]).cast("binary"), 256)


def _part_of(dtype: T.DataType):
    return lambda c: part(c, dtype)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")
