"""Profiles and reports: one row per column, computed as aggregates over the whole table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    LONG, col, field, is_numeric, is_scalar, no_value, number, numeric_columns, present, row_digest,
    scalar_columns, string_columns, tidy,
)
from .counts import (
    MANY_TEXTS, distinct_counts, long_columns, number_summaries, picked_values, plain_numbers, plain_texts, ranked,
    slot_columns, text_summaries, top_counts, value_counts,
)
from .fit import scalars
from .quantiles import quantiles

# Report sizes.
MAX_UNIQUE_PREVIEW = 50
SAMPLE_ROWS = 20
MAX_TEXT = 300
TOP_VALUES = 5
SAMPLE_SEED = 42
OVERSAMPLING = 50
MANY_NUMBERS = 20


def per_column(df: DataFrame, names: list[str], measures) -> DataFrame:
    """One row per name from a single aggregate: ``measures(tidy table, name)`` gives its columns."""
    if not names:
        raise ValueError("no columns to describe")
    values = tidy(df, names)
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(n).alias("column"),
            *[e.alias(k) for k, e in measures(values, n).items()],
        )
        for i, n in enumerate(names)
    ]
    return values.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _present(df: DataFrame, name: str) -> Column:
    return present(df, name) if is_scalar(field(df, name).dataType) else col(name)


def _kind(df: DataFrame, name: str) -> str:
    return "numerical" if is_numeric(field(df, name).dataType) else "categorical"


def _moments(df: DataFrame, name: str) -> dict[str, Column]:
    """min, max, mean and std of a numeric column."""
    if not is_numeric(field(df, name).dataType):
        return {}
    v = number(df, name)
    return {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev(v)}


def statistics(df: DataFrame, names: list[str], measures) -> dict[str, dict[str, Any]]:
    """``measures(tidy table, name)`` of every name, in one scan."""
    values = tidy(df, names)
    found = scalars(values, {(n, k): e for n in names for k, e in measures(values, n).items()})
    out: dict[str, dict[str, Any]] = {n: {} for n in names}
    for (n, k), value in found.items():
        out[n][k] = value
    return out


def _basics(values: DataFrame, n: str) -> dict[str, Column]:
    v = _present(values, n)
    basics = {"non_null": F.count(v), "nulls": F.count_if(v.isNull()), **_moments(values, n)}
    if isinstance(field(values, n).dataType, T.StringType):
        basics["longest"] = F.max(F.length(v))
    return basics


def basic_statistics(df: DataFrame) -> dict[str, dict[str, Any]]:
    """``_basics`` of every column. Above ``MANY_NUMBERS`` numeric columns their counts and moments are added up over
    Arrow batches: that many aggregates in one row are beyond what Spark compiles."""
    numbers = numeric_columns(df)
    if len(numbers) <= MANY_NUMBERS:
        return statistics(df, df.columns, _basics)
    others = [n for n in df.columns if n not in numbers]
    return (statistics(df, others, _basics) if others else {}) | number_summaries(df, numbers)


PROFILE_SCHEMA = (
    "position int, column string, dtype string, kind string, non_null bigint, nulls bigint, "
    "min double, max double, mean double, std double, unique_count bigint"
)


def profile(df: DataFrame, preview: int | None = MAX_UNIQUE_PREVIEW, approx: bool = False) -> DataFrame:
    """dtype, counts, and min/max/mean/std or distinct count and a preview of distinct values.

    One scan gives the statistics, one shuffle of counted values the distinct counts. The preview,
    worked out only when read, is the first ``preview`` values in order, long texts in order of
    their digest; with ``preview=None`` there is none.
    """
    names = [n for n in scalar_columns(df) if not is_numeric(field(df, n).dataType)]
    seen = basic_statistics(df)
    distinct = distinct_counts(df, names, approx)
    rows = [
        (i, n, field(df, n).dataType.simpleString(), _kind(df, n),
         *[seen[n].get(k) for k in ("non_null", "nulls", "min", "max", "mean", "std")], distinct.get(n))
        for i, n in enumerate(df.columns)
    ]
    base = df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)  # one row per column
    if not preview or not names:
        return base.withColumn("sample_unique", no_value("array<string>"))
    long = [n for n in names if (seen[n].get("longest") or 0) > LONG]
    return base.join(F.broadcast(_previews(df, names, preview, long)), "column", "left").select(
        *base.columns, "sample_unique"
    )


def _previews(df: DataFrame, names: list[str], k: int, long: list[str]) -> DataFrame:
    """``(column, sample_unique)``, at most ``k`` values per column."""
    counted = value_counts(df, names, by_digest=True)
    keys = [F.col(c).asc_nulls_last() for c in slot_columns(counted)]
    first = ranked(counted, ["column"], keys, k).withColumnRenamed("rank", "place")
    pair = F.struct("place", "value")
    return picked_values(df, names, first, long).groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["value"]).alias("sample_unique")
    )


def column_samples(
    df: DataFrame, rows: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED, names: Sequence[str] | None = None,
    key: str | Sequence[str] | None = None,
) -> DataFrame:
    """``(column, place, value)``: a repeatable sample of present values per column.

    With ``key`` columns that identify a row, the draw is the MD5 of seed, key and value, the same
    however the files are laid out. Without, every row draws a seeded random number, and the sample
    repeats as long as the files stay the same. The lowest draws win, so copies do not crowd a sample.
    Only draws below a limit are ranked: one that about fifty times the wanted rows pass, or all
    rows of a column with fewer values. Texts above 300 characters are cut there and get dots.
    """
    names = list(names or scalar_columns(df))
    keys = [key] if isinstance(key, str) else list(key or ())
    counts = statistics(df, names, lambda values, n: {"count": F.count(present(values, n))})
    random = F.rand(seed).alias("__random")  # one draw a row
    draws = df if keys else df.select("*", random)
    entries = []
    for n in names:
        share = min(1.0, OVERSAMPLING * rows / max(counts[n]["count"], 1))
        value = present(draws, n)
        if keys:
            parts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]
            draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts, value.cast("string")).cast("binary"))
            limit = F.lit(f"{min(int(share * 16**8), 16**8 - 1):08x}" + "g")  # 'g' follows all digits
        else:
            draw, limit = F.col("__random"), F.lit(share)
        entries.append(F.when(
            value.isNotNull() & (draw < limit),
            F.struct(F.lit(n).alias("column"), draw.alias("__draw"), _cut(value.cast("string")).alias("value")),
        ))
    drawn = draws.select(F.inline(F.array_compact(F.array(*entries))))
    return ranked(drawn, ["column"], [F.col("__draw"), F.col("value")], rows).select(
        "column", F.col("rank").alias("place"), "value"
    )


def _cut(c: Column) -> Column:
    return F.when(F.length(c) > MAX_TEXT, F.concat(F.left(c, F.lit(MAX_TEXT)), F.lit("..."))).otherwise(c)


def overview(df: DataFrame) -> DataFrame:
    """One row: size, missing cells, duplicate rows, and how many columns are of which kind."""
    columns = len(df.columns)
    nulls = sum((_present(df, n).isNull().cast("bigint") for n in df.columns), F.lit(0).cast("bigint"))
    # missing cells are added up on the map side, and only 256 bits of each row are shuffled
    rows = df.select(row_digest(df, df.columns).alias("__digest"), nulls.alias("__nulls"))
    distinct = rows.groupBy("__digest").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__nulls").alias("__nulls")
    )
    total = F.coalesce(F.sum("__n"), F.lit(0))
    missing = F.coalesce(F.sum("__nulls"), F.lit(0))
    return distinct.agg(
        total.alias("total_rows"),
        F.lit(columns).alias("total_columns"),
        missing.alias("missing_values"),
        F.coalesce(F.try_divide(missing * 100.0, total * columns), F.lit(0.0)).alias("missing_percentage"),
        (total - F.count(F.lit(1))).alias("duplicate_rows"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(string_columns(df))).alias("categorical_columns"),
    )


ANALYSIS_SCHEMA = (
    "position int, column string, dtype string, non_null bigint, null_count bigint, "
    "null_percentage double, unique_count bigint, unique_percentage double, mean double, "
    "median double, std double, min double, max double"
)


def column_analysis(df: DataFrame, approx: bool = False) -> DataFrame:
    """Counts, shares, distinct values and, for numbers, mean, median, std, min and max."""
    numeric, scalar, texts = numeric_columns(df), scalar_columns(df), plain_texts(df)
    seen: dict[str, dict[str, Any]] = {}
    if not approx and len(numeric) > MANY_NUMBERS:  # all that one scan finds of them
        seen |= number_summaries(df, numeric, plain_numbers(df), points=[0.5])
    if not approx and len(texts) > MANY_TEXTS:
        found = text_summaries(df, texts)
        seen |= {n: x for n, x in found.items() if "nulls" in x}
    rest = [n for n in df.columns if n not in seen]
    if rest:
        seen |= basic_statistics(df.select(*map(col, rest)))
    counts = {n: seen[n]["non_null"] for n in numeric}
    first = {n: seen[n]["first"] for n in numeric if seen[n].get("first")}
    medians = quantiles(df, {n: [0.5] for n in numeric}, counts, approx, first=first)
    distinct = {n: seen[n]["distinct"] for n in [*plain_numbers(df), *texts] if "distinct" in seen[n] and not approx}
    distinct |= distinct_counts(df, [n for n in scalar if n not in distinct], approx)

    def share(part: int | None, n: str) -> float | None:
        rows = seen[n]["non_null"] + seen[n]["nulls"]
        return part * 100.0 / rows if rows and part is not None else None

    rows = [
        (i, n, field(df, n).dataType.simpleString(), seen[n]["non_null"], seen[n]["nulls"],
         share(seen[n]["nulls"], n), distinct.get(n), share(distinct.get(n), n),
         seen[n].get("mean"), medians.get(n, {}).get(0.5), seen[n].get("std"), seen[n].get("min"),
         seen[n].get("max"))
        for i, n in enumerate(df.columns)
    ]
    return df.sparkSession.createDataFrame(rows, ANALYSIS_SCHEMA)  # one row per column


def top_values(df: DataFrame, k: int = TOP_VALUES, names: Sequence[str] | None = None) -> DataFrame:
    """``(column, rank, value, n)``: the most frequent present values of non-numeric columns."""
    names = list(names or [n for n in scalar_columns(df) if not is_numeric(field(df, n).dataType)])
    top = top_counts(df, names, k, by_digest=True)
    return picked_values(df, names, top, long_columns(df, names)).select("column", "rank", "value", "n")


def analysis_from_profile(profiled: DataFrame) -> DataFrame:
    """The column analysis as far as a stored profile tells: no median, std or value counts."""
    has_range = F.col("min").isNotNull()
    return profiled.select(
        "position", "column", "dtype", "non_null",
        F.col("nulls").alias("null_count"),
        no_value("double").alias("null_percentage"),
        F.coalesce("unique_count", F.lit(0).cast("bigint")).alias("unique_count"),
        F.when(has_range, F.col("mean")).alias("mean"),
        no_value("double").alias("median"),
        no_value("double").alias("std"),
        F.col("min"), F.col("max"),
        F.when(~has_range, F.slice("sample_unique", 1, TOP_VALUES)).alias("top_values"),
    )


def metadata(df: DataFrame) -> DataFrame:
    """One row per column with its type, next to the shape of the table."""
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"))
        for i, f in enumerate(df.schema)
    ]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.inline(F.array(*rows))
    )
