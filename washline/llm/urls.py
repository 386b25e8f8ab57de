"""URL rules on hosts and paths by a sorted sweep over reversed-host keys.

Built-in functions only. The key of a host is its labels from the last to the first, each followed by
a dot, so a host and all its subdomains are one interval of keys and intervals are nested or apart.
Distinct host keys and the ends of the rules' intervals are dealt into ranges of keys, with bounds from
a sample of bounded size; an interval is cut at the bounds of the ranges that it crosses. Within a
range, sorted by key, a running count of opened and closed intervals gives the depth of the stack, and
a running last value for each depth gives the rules on it. Every URL then takes, of the rules on its
host's stack whose path its own starts with, the longest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import at_or_below
from .common import written

HOSTS_PER_RANGE = 200_000
RANGES = 512
SAMPLES_PER_RANGE = 16
AFTER_ALL = "\U0010ffff"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """``host`` and ``path``; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def judge(
    urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """All columns of ``urls``, then ``host``, ``path``, ``rule`` and ``verdict`` (replacing columns of
    these names).

    ``rules`` has ``host``, ``path`` (it may be empty) and ``action``. A rule fits its host and all
    subdomains if the path of the URL starts with the rule's. The longest fitting rule (host and path
    as one text) wins; on ties the longer host, then the smaller action. Without one ``rule`` is null
    and ``verdict`` is ``default``. Rows of ``rules`` with a null are left out, repeated ones do no
    harm. A null URL, or one without ``://``, has an empty host and path, which no rule fits.
    Repeated rows of ``urls`` stay.
    """
    host, path = split_url(F.col(f"`{url}`"))
    # split before columns of these names go, as the URL's own may be one
    parts = urls.withColumns({"__own_host": host, "__own_path": path}).drop("host", "path", "rule", "verdict") \
        .withColumnsRenamed({"__own_host": "host", "__own_path": "path"})
    base = parts.drop("host", "path")
    hosts = written(
        parts.where("host <> ''").select("host").distinct().select("host", host_key(F.col("host")).alias("key"))
    )
    by_host = written(
        rules.where("host IS NOT NULL AND path IS NOT NULL AND action IS NOT NULL AND host <> ''")
        .groupBy(host_key(ascii_lower(F.col("host"))).alias("key")).agg(F.collect_set(F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
            F.concat("host", "path").alias("rule"), F.col("path").alias("under"), "action",
        )).alias("rules"))
    )
    stacks = _sweep(hosts, by_host)
    fitting = F.filter("__rules", lambda r: F.startswith(F.col("path"), r["under"]))
    best = F.array_sort(
        fitting, lambda a, b: F.when(a["size"] != b["size"], b["size"] - a["size"])
        .when(a["host_size"] != b["host_size"], b["host_size"] - a["host_size"])
        .when(a["action"] < b["action"], -1).when(a["action"] > b["action"], 1).otherwise(0),
    )
    judged = parts.join(
        stacks.select(F.col("host").alias("__host"), F.col("rules").alias("__rules")),
        F.col("host") == F.col("__host"), "left",
    ).withColumn("__best", F.get(best, F.lit(0)))
    return judged.select(
        *[F.col(f"`{c}`") for c in base.columns], "host", "path",
        F.col("__best.rule").alias("rule"),
        F.coalesce(F.col("__best.action"), F.lit(default)).alias("verdict"),
    )


def _sweep(hosts: DataFrame, by_host: DataFrame) -> DataFrame:
    """``(host, rules)`` for the hosts inside an interval, with all rules of the stack."""
    deepest = by_host.agg(F.max(F.size(F.split("key", r"\."))).alias("n")).first()["n"]
    if deepest is None:
        return hosts.select("host", F.lit(None).cast(by_host.schema["rules"].dataType).alias("rules")).limit(0)
    bounds = _bounds(hosts)
    range_of = _range_of(F.col("key"), bounds)
    end = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))  # '/' follows '.'
    opened = by_host.select("key", end.alias("end"), "rules").withColumn(
        "range", F.explode(F.sequence(range_of, _range_of(F.col("end"), bounds)))
    )
    nothing = F.lit(None).cast(by_host.schema["rules"].dataType)
    # at one key the intervals close first, then open (wide ones first by key), then hosts are read
    events = reduce(DataFrame.unionByName, [
        opened.select("range", "key", F.lit(1).alias("kind"), F.lit(1).alias("step"),
                      F.lit(None).cast("string").alias("host"), "rules"),
        opened.select("range", F.col("end").alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("step"),
                      F.lit(None).cast("string").alias("host"), nothing.alias("rules")),
        hosts.select(range_of.alias("range"), "key", F.lit(2).alias("kind"), F.lit(0).alias("step"),
                     "host", nothing.alias("rules")),
    ])
    order = Window.partitionBy("range").orderBy("key", "kind")
    depth = events.withColumn("depth", F.sum("step").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ))
    levels = [
        F.last(F.when((F.col("kind") == 1) & (F.col("depth") == d), F.col("rules")), ignorenulls=True)
        .over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        for d in range(1, deepest + 1)
    ]
    stacked = depth.select("host", "kind", "depth", *[x.alias(f"r{d}") for d, x in enumerate(levels, 1)])
    on_stack = F.array(*[F.when(F.col("depth") >= d, F.col(f"r{d}")) for d in range(1, deepest + 1)])
    return stacked.where("kind = 2 AND depth > 0").select(
        "host", F.flatten(F.array_compact(on_stack)).alias("rules")
    )


def _bounds(hosts: DataFrame) -> list[str]:
    """Keys that cut the hosts into even ranges, from the hosts of the smallest hashes."""
    ranges = min(RANGES, -(-hosts.count() // HOSTS_PER_RANGE))
    if ranges <= 1:
        return []
    rows = hosts.orderBy(F.xxhash64("key")).limit(ranges * SAMPLES_PER_RANGE).select("key").collect()
    keys = sorted((r["key"] for r in rows), key=str.encode)
    return list(dict.fromkeys(keys[SAMPLES_PER_RANGE::SAMPLES_PER_RANGE]))


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at or below the key."""
    if not bounds:
        return F.lit(0)
    return at_or_below(key, F.array(*[F.lit(b) for b in bounds]), len(bounds))
