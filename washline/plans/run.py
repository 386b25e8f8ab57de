"""Running a plan, and the whole way from a file to a cleaned table with its reports."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, role, string_columns
from ..operators import charts, profile as profiles, quality
from ..operators.checkpoints import cut_lineage
from ..operators.fit import scalars
from ..operators.typing import binary_columns, long_text_columns
from ..sources.tables import detect_format, read_table, write_table
from .steps import ROW_STEPS, STEPS, Cleaner, Fitted
from .suggest import LAST, STEP_ORDER, TEXT_OPERATIONS, check_plan, order_plan, resolve_plan, suggest

LOG_SCHEMA = "seq int, column string, operation string, reason string, status string, detail string"
SCALING = {"standardize", "normalize_range"}
RUN_TOGETHER = 1000


@dataclass
class Ran:
    """The cleaned table, the log of every step, and the fitted steps."""

    df: DataFrame
    log: DataFrame
    cleaner: Cleaner


@dataclass
class CleanResult:
    """A whole run. Charts describe the original, the report the cleaned table; both, and the
    comparison, are computed when asked for."""

    df: DataFrame
    original: DataFrame
    profile: DataFrame
    plan: DataFrame
    log: DataFrame
    cleaner: Cleaner

    def charts(self) -> dict[str, DataFrame]:
        return chart_tables(self.original)

    def report(self) -> dict[str, DataFrame]:
        return report_tables(self.df, self.plan, self.log, self.profile)

    def comparison(self) -> DataFrame:
        return quality.compare(self.original, self.df)


@dataclass
class _Planned:
    seq: int
    column: str
    operation: str
    reason: str
    parameters: dict[str, str]
    rank: int


def run_plan(
    df: DataFrame,
    plan: DataFrame,
    on_error: str = "raise",
    length_guard: bool = False,
    lemmas: DataFrame | None = None,
    checkpoint: bool = False,
    approx: bool = False,
) -> Ran:
    """Apply a plan's steps in order.

    Steps of different columns are independent, so between two row-removing steps all columns'
    steps of one kind are fitted together in one scan. ``checkpoint`` writes the table to the
    checkpoint folder after row-removing and text steps, so that later fits do not repeat them.
    ``approx`` takes quantiles from a sketch, in one pass. ``on_error="skip"`` records a step that fails
    while it is fitted and goes on; one that fails only when rows are worked out ends the run, as does a
    written output. ``length_guard`` undoes a step that
    leaves a text above 1000 characters.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be 'raise' or 'skip'")
    steps = _planned(plan)
    log: list[tuple] = []
    cleaner = Cleaner()
    long_texts: list[str] | None = None  # tested once, before the first text step
    waves = _waves(steps)
    for i, wave in enumerate(waves):
        operation, parameters = wave[0].operation, {**wave[0].parameters, "approx": approx}
        if operation == "lemmatize":
            parameters["lemmas"] = lemmas
        if operation in TEXT_OPERATIONS:
            if long_texts is None:
                names = {s.column for s in steps if s.operation in TEXT_OPERATIONS}
                long_texts = long_text_columns(df, [n for n in df.columns if n in names])
            parameters["long_texts"] = long_texts
        able, guarded = _guard(df, wave)
        log += [(s.seq, s.column, s.operation, s.reason, "skipped", why) for s, why in guarded]
        if not able:
            continue
        try:
            fitted = _fit(df, operation, [s.column for s in able], parameters)
            after = fitted.apply(df)
            if length_guard:
                able, undone = _undo_run_together(df, after, able)
                log += [(s.seq, s.column, s.operation, s.reason, "skipped", why) for s, why in undone]
                if undone and able:
                    fitted = _fit(df, operation, [s.column for s in able], parameters)
                    after = fitted.apply(df)
        except Exception as error:  # every step may fail in its own way on unknown data
            if on_error == "raise":
                raise
            log += [(s.seq, s.column, s.operation, s.reason, "failed", str(error)[:200]) for s in able]
            continue
        if not able:
            continue
        heavy = operation in ROW_STEPS or operation in TEXT_OPERATIONS
        df = cut_lineage(after) if checkpoint and heavy and i + 1 < len(waves) else after
        cleaner.steps.append(fitted)
        log += [(s.seq, s.column, s.operation, s.reason, "applied", "") for s in able]
    table = df.sparkSession.createDataFrame(sorted(log), LOG_SCHEMA)
    return Ran(df, table, cleaner)


def _planned(plan: DataFrame) -> list[_Planned]:
    """The plan's rows on the driver: a few per column of the table."""
    rows = order_plan(resolve_plan(plan)).collect()
    return [
        _Planned(i, r["column"], r["operation"], r["reason"] or "", r["parameters"] or {},
                 STEP_ORDER.get(r["operation"], LAST))
        for i, r in enumerate(rows)
    ]


def _waves(steps: list[_Planned]) -> list[list[_Planned]]:
    """Groups of steps that share one fit, in an order with the same result as one by one."""
    waves: list[list[_Planned]] = []
    segment: list[_Planned] = []

    def close() -> None:
        ordered = sorted(segment, key=lambda s: (s.rank, s.operation, sorted(s.parameters.items()), s.seq))
        for _, same in groupby(ordered, key=lambda s: (s.operation, sorted(s.parameters.items()))):
            waves.append(list(same))
        segment.clear()

    for s in steps:
        if s.operation in ROW_STEPS:
            close()
            waves.append([s])
        else:
            segment.append(s)
    close()
    return waves


def _guard(df: DataFrame, wave: list[_Planned]) -> tuple[list[_Planned], list[tuple[_Planned, str]]]:
    """Which steps may run: the column is there, and is not an encoded or binary one where that
    would spoil it."""
    operation = wave[0].operation
    able, guarded = [], []
    for s in wave:
        if operation == "skip":
            guarded.append((s, "skip"))
        elif operation not in STEPS:
            guarded.append((s, "unknown operation"))
        elif s.column not in df.columns and operation not in ROW_STEPS:
            guarded.append((s, "no such column"))
        elif operation in SCALING | {"handle_skewness"} and role(df, s.column):
            guarded.append((s, "encoded column"))
        else:
            able.append(s)
    if operation == "handle_skewness" and able:
        binary = set(binary_columns(df, [s.column for s in able]))
        guarded += [(s, "binary column") for s in able if s.column in binary]
        able = [s for s in able if s.column not in binary]
    return able, guarded


def _fit(df: DataFrame, operation: str, names: list[str], parameters: dict[str, Any]) -> Fitted:
    return Fitted(operation, STEPS[operation].fit(df, names, parameters))


def _undo_run_together(df: DataFrame, after: DataFrame, able: list[_Planned]):
    checked = [s for s in able if s.column in string_columns(after)]
    longest = scalars(after, {s.column: F.max(F.length(col(s.column))) for s in checked})
    bad = {n for n, length in longest.items() if (length or 0) > RUN_TOGETHER}
    undone = [(s, "values ran together") for s in able if s.column in bad]
    return [s for s in able if s.column not in bad], undone


def operation_summary(plan: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """``(column, operation, reason, status)``: what was applied and what was skipped.

    Reasons missing from the log come from the plan. Without a log the plan stands for it.
    """
    if log is None:
        skipped = F.col("operation") == "skip"
        return plan.select(
            "column", "operation", F.coalesce("reason", F.lit("")).alias("reason"),
            F.when(skipped, "skipped").otherwise("applied").alias("status"),
        )
    planned = resolve_plan(plan).where(F.col("reason") != "").groupBy("column", "operation").agg(
        F.min_by("reason", "step").alias("__reason")
    )
    filled = F.coalesce(F.when(F.col("reason") != "", F.col("reason")), "__reason", F.lit(""))
    return log.join(F.broadcast(planned), ["column", "operation"], "left").select(
        "column", "operation", filled.alias("reason"), "status"
    )


def summary_totals(plan: DataFrame, log: DataFrame | None = None, snapshots: list[dict] | None = None) -> DataFrame:
    """One row: columns with suggestions, steps by outcome, and the snapshots taken."""
    counted = operation_summary(plan, log).agg(
        F.count_if(F.col("status") == "applied").alias("applied"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    suggestions = plan.agg(F.count_distinct("column")).first()[0]
    steps = [s["step"] for s in snapshots or []]
    return counted.select(
        F.lit(suggestions).alias("total_suggestions"), "*", F.lit(len(steps)).alias("total_snapshots"),
        F.array(*[F.lit(s) for s in steps]).cast("array<string>").alias("snapshot_steps"),
    )


def clean(
    spark: SparkSession,
    path: str,
    plan: DataFrame | None = None,
    output: str | None = None,
    on_error: str = "raise",
    lemmas: DataFrame | None = None,
    length_guard: bool = False,
    format: str | None = None,
    checkpoint: bool = False,
    approx: bool = False,
    read: dict | None = None,
) -> CleanResult:
    """From a file to a cleaned table: read, profile, plan, run, describe, compare, save. ``read`` holds
    options of ``read_table``: ``schema``, ``json_lines``, ``sampling_ratio``, ``multiline``."""
    format = format or detect_format(path)
    return clean_table(
        read_table(spark, path, format, **(read or {})), plan, output, format, on_error, lemmas, length_guard,
        checkpoint, approx,
    )


def clean_table(
    df: DataFrame,
    plan: DataFrame | None = None,
    output: str | None = None,
    format: str = "parquet",
    on_error: str = "raise",
    lemmas: DataFrame | None = None,
    length_guard: bool = False,
    checkpoint: bool = False,
    approx: bool = False,
) -> CleanResult:
    """The same for a table. ``checkpoint`` and ``approx`` as in ``run_plan``; ``approx`` also estimates
    the distinct counts of the profile."""
    profiled = profiles.profile(df, approx=approx)
    if plan is None:
        plan = suggest(profiled)
    plan = check_plan(plan, df, profiled)
    ran = run_plan(df, plan, on_error, length_guard, lemmas, checkpoint, approx)
    if output:
        write_table(ran.df, output, format)
    return CleanResult(ran.df, df, profiled, plan, ran.log, ran.cleaner)


def chart_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The chart gallery of a table."""
    numeric = profiles.numeric_columns(df)
    out = {"missing": charts.missing_counts(df), "missing_patterns": charts.missing_patterns(df)}
    if numeric:
        out["histogram"] = charts.histogram(df)
        out["box_plot"] = charts.box_plot(df)
    if len(numeric) > 1:
        out["correlations"] = charts.correlations(df)
    if string_columns(df):
        out["top_categories"] = charts.top_categories(charts.repair_run_together_loose(df))
    return out


def report_tables(df: DataFrame, plan: DataFrame, log: DataFrame, profiled: DataFrame) -> dict[str, DataFrame]:
    """The quality report of a cleaned table."""
    return {
        "metadata": profiles.metadata(df),
        "overview": profiles.overview(df),
        "column_analysis": profiles.column_analysis(df),
        "original_analysis": profiles.analysis_from_profile(profiled),
        "quality": quality.quality(df),
        "recommendations": quality.recommendations(df),
        "operations": operation_summary(plan, log),
        "totals": summary_totals(plan, log),
    }
