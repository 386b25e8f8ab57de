"""Boilerplate lines: those on a large share of the pages of their own site.

Built-in functions only. A line is known by two 64-bit hashes of its trimmed text. Every page sends
each of its lines once; the counts by site and line are added up before the shuffle, so a line on every
page of a huge site costs one row a task. A site has at most (mean lines a page / ratio) boilerplate
lines, whatever its size, so they travel as one array a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RATIO = 0.1
PAGES = 5
BROADCAST_LINES = 200_000


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    docs: DataFrame, host: str, text: str, ratio: float = RATIO, pages: int = PAGES, distinct: bool = False
) -> DataFrame:
    """``(host, line)`` for lines on more than ``ratio`` of the host's pages and on ``pages`` or more.

    ``line`` is the struct of hashes. A null host is the site with the empty name. With ``distinct`` the
    rows of a host that have one text (by two hashes) are one page.
    """
    site = F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))
    full = F.filter(F.transform(_lines(F.col(f"`{text}`")), lambda x: F.trim(x)), lambda x: x != "")
    seen = docs.select(
        site.alias("host"), _hash(F.col(f"`{text}`")).alias("page"),
        F.array_distinct(F.transform(full, _hash)).alias("lines"),
    )
    if distinct:  # hashes only, and copies go on the map side
        seen = written(seen.groupBy("host", "page").agg(F.first("lines").alias("lines")))
    counts = seen.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= pages)
    totals = (seen if distinct else docs.select(site.alias("host"))).groupBy("host").agg(
        F.count(F.lit(1)).alias("total")
    )
    return counts.join(totals, "host").where(F.col("n") > F.col("total") * ratio).select("host", "line")


def remove_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
    pages: int = PAGES, distinct: bool = False,
) -> DataFrame:
    """All columns of ``docs`` with the boilerplate lines of its site taken out of ``text``, then
    ``n_lines`` and ``n_dropped`` (replacing columns of these names).

    Lines end at a line feed; they are compared without spaces at their ends, blank lines are never
    boilerplate. A null text stays null, with no lines; an empty text is one blank line. A text that
    consists of boilerplate becomes empty. Repeated rows are pages of their own, or with ``distinct`` one
    page for each text of a site.
    """
    found = written(boilerplate(docs, host, text, ratio, pages, distinct))
    sites = found.groupBy("host").agg(F.collect_list("line").alias("__drop")).withColumnRenamed(
        "host", "__host"
    )
    if found.count() <= BROADCAST_LINES:  # 24 bytes a line
        sites = F.broadcast(sites)
    else:  # written, so that Spark can split a site that holds much of the table
        sites = written(sites)
    site = F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))
    lines = _lines(F.col(f"`{text}`"))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("__drop", _hash(F.trim(x))))
    new = F.when(F.col("__drop").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    left = F.when(F.col("__drop").isNull(), lines).otherwise(kept)
    return (
        docs.drop("n_lines", "n_dropped").withColumn("__site", site)
        .join(sites, F.col("__site") == F.col("__host"), "left")
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.col("n_lines") - F.coalesce(F.size(left), F.lit(0)))
        .withColumn(text, new)
        .drop("__site", "__host", "__drop")
    )
