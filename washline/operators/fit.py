"""The shared fit step: many statistics, one scan, a handful of scalars on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", 8000)  # bytes; the JVM never compiles a longer method


def scalars(df: DataFrame, wanted: dict[Any, Column]) -> dict[Any, Any]:
    """Compute every requested aggregate in one job and return one scalar per key."""
    if not wanted:
        return {}
    row = df.agg(*[expr.alias(f"v{i}") for i, expr in enumerate(wanted.values())]).first()
    return dict(zip(wanted, row))


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Stages whose generated method the JVM would interpret, as for the expressions of many columns, run as
    several small methods instead. The session's own setting comes back afterwards."""
    name, limit = METHOD_LIMIT
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(limit if before is None else min(limit, int(before))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
