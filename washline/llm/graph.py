"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (two columns of one ordered type).

    ``root`` is the smallest node of the component. Every round points each node and its larger
    neighbours at the smallest neighbour (first all larger ones, then the smaller ones), so the
    number of rounds grows with the logarithm of the longest chain. Only two numbers a round
    reach the driver; the links stay in written tables. Self links and repeated links are harmless;
    rows with a null end are left out.
    """
    a, b = links.columns
    now = written(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    )
    seen = _state(now)
    while seen[0]:
        both = now.union(now.select("low", "high")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("least"))
        larger = both.where(F.col("other") > F.col("node")).join(least, "node").select(
            F.col("other").alias("node"), F.least("least", F.col("node")).alias("other")
        ).distinct()
        down = larger.groupBy("node").agg(F.min("other").alias("least"))
        smaller = larger.join(down, "node").where(F.col("other") != F.col("least")).select(
            F.col("other"), F.col("least")
        )
        now = written(smaller.union(down).toDF("high", "low").distinct())
        before, seen = seen, _state(now)
        if seen == before:
            break
    roots = now.select(F.col("low").alias("node")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        roots.join(now.select(F.col("high").alias("node")), "node", "left_anti")
        .select("node", F.col("node").alias("root"))
    )


def _state(links: DataFrame) -> tuple[int, int]:
    mixed = F.xxhash64("high", "low").cast("decimal(38,0)")
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(mixed).alias("total")).first()
    return row["n"], int(row["total"] or 0)
