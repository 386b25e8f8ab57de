"""Ordered buckets over composite keys, so that ordered work never needs a one-task window.

A bucket is a pure function of the key: bounds are taken once from a sample of bounded size and
written into the plan as a literal, so a recomputed task always lands rows in the same bucket.
Bounds over the whole composite key also split a partition key that holds most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.columns import col

ROWS_PER_BUCKET = 2_000_000
BYTES_PER_BUCKET = 256 << 20
MAX_BUCKETS = 16_384
SAMPLES_PER_BUCKET = 8


def ordered_buckets(
    df: DataFrame, keys: list[str], buckets: int | None = None, rows: int | None = None
) -> Column | None:
    """An integer column that never decreases as ``keys`` grow (ascending, NULL first).

    None when one bucket is enough: below 2,000,000 rows and 256 MB. Bounds are whole keys, so keys with
    a long common start are told apart too. ``keys`` should order rows without large ties, as equal
    keys share a bucket.
    """
    if buckets is None:
        rows, size = _rows_and_bytes(df)
        wanted = max(-(-rows // ROWS_PER_BUCKET), -(-size // BYTES_PER_BUCKET))
        buckets = min(MAX_BUCKETS, wanted)
    if buckets <= 1:
        return None
    rows = df.count() if rows is None else rows
    share = min(1.0, buckets * SAMPLES_PER_BUCKET / max(rows, 1))
    key = F.struct(*[col(k).alias(k) for k in keys])
    sampled = df.select(key.alias("key")).sample(share, seed=11).orderBy("key")
    texts = [r[0] for r in sampled.select(F.to_json("key")).collect()]  # a few per bucket
    step = len(texts) / buckets
    chosen = [texts[int(i * step)] for i in range(1, buckets) if int(i * step) < len(texts)]
    if not chosen:
        return None
    kind = T.ArrayType(T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys]))
    bounds = F.from_json(F.lit("[" + ",".join(chosen) + "]"), kind)
    return at_or_below(key, bounds, len(chosen))


def _rows_and_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows, and their size with every text and binary value at its length, in one scan."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    sums = [F.coalesce(F.sum(F.octet_length(col(n))), F.lit(0)) for n in wide]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[x.alias(f"b{i}") for i, x in enumerate(sums)]).first()
    return seen["rows"], sum(seen[1:]) + 16 * len(df.columns) * seen["rows"]


def at_or_below(value: Column, bounds: Column, n: int) -> Column:
    """How many of the ``n`` sorted bounds are at or below the value, by halving."""
    steps = [F.lit(1 << i) for i in reversed(range(max(n, 1).bit_length()))]
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, by: F.when(F.get(bounds, at + by - 1) <= value, at + by).otherwise(at),
    )


def number_distinct(values: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``position``, the zero-based rank of each row in the order of its (distinct) keys."""
    ordered = [col(k) for k in keys]
    bucket = ordered_buckets(values, keys, buckets)
    if bucket is None:
        return values.withColumn("position", F.row_number().over(Window.orderBy(*ordered)) - 1)
    bucketed = values.withColumn("__bucket", bucket)
    per_bucket = bucketed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most MAX_BUCKETS rows, so the single-partition window and the broadcast stay small
    starts = per_bucket.select(
        "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*ordered))
    return (
        bucketed.withColumn("__row", inside)
        .join(F.broadcast(starts), "__bucket", "left")
        .withColumn("position", F.col("__start") + F.col("__row") - 1)
        .drop("__bucket", "__start", "__row")
    )
