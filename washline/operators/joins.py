"""Looking values up in a table too large to broadcast, whatever the skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

HOT_SHARE = 1000


def join_by_value(df: DataFrame, key: str, counts: DataFrame, table: DataFrame) -> DataFrame:
    """Left join ``table`` (unique ``value`` and payload columns) on ``df[key]``.

    ``counts`` is ``(value, n)`` over ``df[key]``. Values on more than 1/1000 of the rows - fewer
    than 1000 of them - join by broadcast, missing keys not at all, and the rest by shuffle, so
    no shuffle partition is forced to hold more than 1/1000 of the rows.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > total // HOT_SHARE).select("value")
    hot_table = F.broadcast(hot.join(table, "value", "left"))
    same = col(key) == F.col("value")
    payload = [c for c in table.columns if c != "value"]
    columns = [*[col(c) for c in df.columns], *[col(c) for c in payload]]
    nothing = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in payload]
    frequent = df.join(hot_table, same).select(*columns)
    others = df.join(F.broadcast(hot), same, "left_anti").where(col(key).isNotNull())
    rare = others.join(table, same, "left").select(*columns)
    missing = df.where(col(key).isNull()).select(*[col(c) for c in df.columns], *nothing)
    return frequent.unionByName(rare).unionByName(missing)
