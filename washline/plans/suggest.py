"""Plans as tables: one row per column and step, derived from a profile by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import string_columns
from ..operators.typing import short_categorical_columns

PLAN_SCHEMA = (
    "position int, column string, step int, operation string, reason string, "
    "parameters map<string,string>"
)

# Thresholds of the suggestion rules.
OUTLIER_RANGE_TO_MEAN = 200
WIDE_RANGE = 1000
MODERATE_RANGE = 100
FEW_VALUES = 10

# Wording of the reasons, full rules then short rules.
REASONS = {
    "fill_missing": "%d missing values (%.1f%% of data)",
    "remove_outliers": "High coefficient of variation (%.1f%%) suggests outliers in range [%.2f, %.2f]",
    "normalize_range": "Wide numeric range (%.2f) requires scaling for ML algorithms",
    "standardize": "Moderate range (%.2f) - standardization recommended for better ML performance",
    "text_clean": "Text column with %d unique values needs cleaning and normalization",
    "categorical_encode": "Low cardinality categorical column (%d categories) - encoding recommended",
    "skip": "Column appears clean and ready for analysis",
}
BASIC_REASONS = {
    "fill_missing": "%d missing values",
    "normalize_range": "Wide numeric range",
    "text_clean": "High cardinality text",
    "skip": "No preprocessing required",
}
FORCED_SKIP = "Short categorical column (was: %s)"

# The order in which one column's steps run; unknown steps run last.
STEP_ORDER = {
    "skip": 0,
    "fix_infinite": 10,
    "remove_outliers": 20,
    "fill_missing": 30,
    "deduplicate": 40,
    "drop_constant": 50,
    "handle_datetime": 60,
    "handle_skewness": 70,
    "categorical_encode": 80,
    "onehot": 80,
    "onehot_encode": 80,
    "label": 80,
    "label_encode": 80,
    "text_clean": 90,
    "remove_stopwords": 100,
    "lemmatize": 110,
    "tfidf": 120,
    "standardize": 130,
}
LAST = 1000

# Other names of the encoding step and the strategy each stands for.
ENCODING_ALIASES = {
    "onehot": "onehot", "onehot_encode": "onehot", "label": "label", "label_encode": "label",
}
TEXT_OPERATIONS = ["text_clean", "remove_stopwords", "lemmatize", "tfidf"]


def make_plan(spark: SparkSession, steps: list[dict]) -> DataFrame:
    """A plan table from ``{column, operation, reason?, parameters?}`` records, in given order."""
    positions: dict[str, int] = {}
    counts: dict[str, int] = {}
    rows = []
    for s in steps:
        name = s["column"]
        position = positions.setdefault(name, len(positions))
        counts[name] = counts.get(name, -1) + 1
        parameters = {k: str(v) for k, v in (s.get("parameters") or {}).items()}
        rows.append((position, name, counts[name], s["operation"], s.get("reason") or "", parameters))
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def _step(when: Column, operation: str, reasons: dict[str, str], *values: Column) -> Column:
    reason = F.format_string(reasons[operation], *values) if values else F.lit(reasons[operation])
    return F.when(when, F.struct(F.lit(operation).alias("operation"), reason.alias("reason")))


def _as_plan(profiled: DataFrame, steps: list[Column], nothing: str) -> DataFrame:
    found = F.array_compact(F.array(*steps))
    skip = F.array(F.struct(F.lit("skip").alias("operation"), F.lit(nothing).alias("reason")))
    listed = profiled.select("position", "column", found.alias("found")).select(
        "position", "column",
        F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(skip)).alias("step", "s"),
    )
    return listed.select(
        "position", "column", "step", "s.operation", "s.reason",
        F.lit(None).cast("map<string,string>").alias("parameters"),
    )


def suggest(profiled: DataFrame) -> DataFrame:
    """The full rules: missing values, outliers, scaling; text cleaning or encoding."""
    nulls, non_null = F.col("nulls"), F.col("non_null")
    low, high, mean = F.col("min"), F.col("max"), F.col("mean")
    distinct = F.col("unique_count")
    width = high - low
    spread = F.try_divide(width, mean) * 100
    text = (F.col("dtype") == "string") & low.isNull()
    share = F.try_divide(nulls * 100.0, nulls + non_null)
    moderate = (width > MODERATE_RANGE) & (width <= WIDE_RANGE)
    return _as_plan(profiled, [
        _step(nulls > 0, "fill_missing", REASONS, nulls, share),
        _step((mean > 0) & (spread > OUTLIER_RANGE_TO_MEAN), "remove_outliers", REASONS, spread, low, high),
        _step(width > WIDE_RANGE, "normalize_range", REASONS, width),
        _step(moderate, "standardize", REASONS, width),
        _step(text & (distinct > FEW_VALUES), "text_clean", REASONS, distinct),
        _step(text & (distinct <= FEW_VALUES), "categorical_encode", REASONS, distinct),
    ], REASONS["skip"])


def suggest_basic(profiled: DataFrame) -> DataFrame:
    """The short rules: missing values, wide ranges, text with many values."""
    nulls, width = F.col("nulls"), F.col("max") - F.col("min")
    many = (F.col("dtype") == "string") & (F.col("unique_count") > FEW_VALUES)
    return _as_plan(profiled, [
        _step(nulls > 0, "fill_missing", BASIC_REASONS, nulls),
        _step(width > WIDE_RANGE, "normalize_range", BASIC_REASONS),
        _step(many, "text_clean", BASIC_REASONS),
    ], BASIC_REASONS["skip"])


def check_plan(
    plan: DataFrame, df: DataFrame, profiled: DataFrame | None = None, approx: bool = False
) -> DataFrame:
    """Turn text steps on short categorical columns into skips, saying so in the reason.

    ``profiled`` saves counting distinct values again.
    """
    asked = plan.where(F.col("operation").isin(TEXT_OPERATIONS)).select("column").distinct()
    names = [r[0] for r in asked.collect() if r[0] in string_columns(df)]  # columns of one table
    distinct = None
    if profiled is not None:
        distinct = dict(profiled.select("column", "unique_count").collect())
    short = short_categorical_columns(df, names, approx, distinct) if names else []
    forced = F.col("column").isin(short) & F.col("operation").isin(TEXT_OPERATIONS)
    why = F.format_string(FORCED_SKIP, "operation")
    return plan.select(
        "position", "column", "step",
        F.when(forced, "skip").otherwise(F.col("operation")).alias("operation"),
        F.when(forced, why).otherwise(F.col("reason")).alias("reason"),
        F.when(forced, F.create_map().cast("map<string,string>"))
        .otherwise(F.col("parameters")).alias("parameters"),
    )


def resolve_plan(plan: DataFrame) -> DataFrame:
    """Replace alias names by the real step and add each step's default parameters."""
    operation = F.col("operation")
    given = F.coalesce("parameters", F.create_map().cast("map<string,string>"))
    alias = operation.isin(list(ENCODING_ALIASES))
    aliases = F.create_map(*[F.lit(x) for pair in ENCODING_ALIASES.items() for x in pair])
    # a method that names a strategy, then the alias, then a given strategy
    strategy = F.coalesce(
        F.try_element_at(aliases, F.try_element_at(given, F.lit("method"))),
        F.when(alias, F.try_element_at(aliases, operation)),
        F.try_element_at(given, F.lit("strategy")),
        F.lit("onehot"),
    )

    def forced(**values: str | Column) -> Column:
        pairs = [F.lit(v) if isinstance(v, str) else v for kv in values.items() for v in kv]
        return F.create_map(*pairs)

    def merged(defaults: Column | None, always: Column | None) -> Column:
        """Given parameters over defaults, fixed ones over both."""
        out = given
        if defaults is not None:
            out = F.map_concat(_without(defaults, out), out)
        if always is not None:
            out = F.map_concat(_without(out, always), always)
        return out

    encode = alias | (operation == "categorical_encode")
    parameters = (
        F.when(operation == "remove_outliers",
               merged(forced(outlier_strategy="median"), forced(method="remove_outliers")))
        .when(operation == "standardize", merged(None, forced(method="standard")))
        .when(operation == "normalize_range", merged(None, forced(method="minmax")))
        .when(encode, merged(forced(keep_original="False"),
                             forced(method="categorical_encode", strategy=strategy)))
        .otherwise(given)
    )
    return plan.select(
        "position", "column", "step",
        F.when(alias, "categorical_encode").otherwise(operation).alias("operation"),
        "reason", parameters.alias("parameters"),
    )


def _without(a: Column, b: Column) -> Column:
    """Entries of map ``a`` whose key is not in map ``b``."""
    return F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))


def order_plan(plan: DataFrame) -> DataFrame:
    """Sort steps by column, then by the fixed step order, then as given; adds ``rank``."""
    ranks = F.create_map(*[F.lit(x) for pair in STEP_ORDER.items() for x in pair])
    rank = F.coalesce(F.try_element_at(ranks, F.col("operation")), F.lit(LAST))
    return plan.withColumn("rank", rank).orderBy("position", "rank", "step")
