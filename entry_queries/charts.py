"""Chart data: V1 to V8."""

from __future__ import annotations

from statistics import NormalDist

from washline.operators import charts, numeric

from .common import big, derived, derived_sql, query, r, rounded, table, wide_numbers
from .expected import LOOSE_CATEGORIES, STRICT_CATEGORIES
from .numeric import reduced_sql
from .profiles import top_sql

LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def histogram_sql(source: str, names: list[str]) -> str:
    def one(n):
        return f"""
SELECT '{n}' AS "column", {big('bin')} AS bin, {r('lo + (bin - 1) * ((hi - lo) / 30)')} AS low,
{r('lo + bin * ((hi - lo) / 30)')} AS high, n FROM (
 SELECT lo, hi, CASE WHEN lo = hi THEN 1 ELSE least(floor(({n} - lo) / (hi - lo) * 30) + 1, 30) END AS bin, count(*) AS n
 FROM t, (SELECT CAST(min({n}) AS DOUBLE) AS lo, CAST(max({n}) AS DOUBLE) AS hi FROM t) WHERE {n} IS NOT NULL GROUP BY ALL)"""
    return f"WITH t AS ({source})" + "\nUNION ALL\n".join(one(n) for n in names)


@query("histogram_events", histogram_sql("SELECT value FROM events", ["value"]))
def histogram_events(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "events"), "value"))


@query("histogram_lineitem", histogram_sql("SELECT * FROM lineitem", LINEITEM))
def histogram_lineitem(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "lineitem"), LINEITEM))


@query("histogram_infinite_events", f"""
WITH t AS ({derived_sql('infinite_events')}),
v AS (SELECT value, CASE WHEN isfinite(value) THEN value END AS f FROM t WHERE value IS NOT NULL AND NOT isnan(value)),
b AS (SELECT min(f) AS lo, max(f) AS hi FROM v),
p AS (SELECT lo, hi, value, CASE WHEN f IS NULL THEN CASE WHEN value < 0 THEN 0 ELSE 31 END
  ELSE least(floor((f - lo) / (hi - lo) * 30) + 1, 30) END AS bin FROM v, b)
SELECT 'value' AS "column", {big('bin')} AS bin,
CASE WHEN bin IN (0, 31) THEN any_value(value) ELSE {r('any_value(lo) + (bin - 1) * ((any_value(hi) - any_value(lo)) / 30)')} END AS low,
CASE WHEN bin IN (0, 31) THEN any_value(value) ELSE {r('any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30)')} END AS high,
count(*) AS n FROM p GROUP BY bin""")
def histogram_infinite_events(spark, sf):
    """Infinities in bins of their own; NaN is missing."""
    return rounded(charts.histogram(derived(spark, sf, "infinite_events"), "value"))


def box_sql(source: str, names: list[str]) -> str:
    def one(n):
        inside = f"{n} >= q1 - 1.5 * (q3 - q1) AND {n} <= q3 + 1.5 * (q3 - q1)"
        return f"""
SELECT '{n}' AS "column", {r('q1')} AS q1, {r('q2')} AS median, {r('q3')} AS q3,
{r(f'min({n}) FILTER (WHERE {inside})')} AS whisker_low, {r(f'max({n}) FILTER (WHERE {inside})')} AS whisker_high,
count({n}) - count(*) FILTER (WHERE {inside}) AS outliers
FROM t, (SELECT quantile_cont({n}, 0.25) AS q1, quantile_cont({n}, 0.5) AS q2, quantile_cont({n}, 0.75) AS q3 FROM t)
GROUP BY q1, q2, q3"""
    return f"WITH t AS ({source})" + "\nUNION ALL\n".join(one(n) for n in names)


@query("box_plot_lineitem", box_sql(derived_sql("dirty_lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))
def box_plot_lineitem(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(charts.box_plot(derived(spark, sf, "dirty_lineitem"), names))


@query("box_plot_events", box_sql("SELECT value FROM events", ["value"]))
def box_plot_events(spark, sf):
    return rounded(charts.box_plot(table(spark, sf, "events"), "value"))


@query("top_categories_orders", top_sql(
    derived_sql("dirty_orders"), ["o_orderstatus", "o_orderpriority"], 20, missing="<NULL>"))
def top_categories_orders(spark, sf):
    return rounded(charts.top_categories(derived(spark, sf, "dirty_orders")))


def correlation_sql(source: str, names: list[str]) -> str:
    parts = []
    for a in names:
        for b in names:
            value = f"CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE coalesce(corr({a}, {b}), 0) END"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(value)} AS corr FROM t")
    return f"WITH t AS ({source}) " + " UNION ALL ".join(parts)


@query("correlations_lineitem", correlation_sql(
    derived_sql("dirty_lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))
def correlations_lineitem(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(charts.correlations(derived(spark, sf, "dirty_lineitem"), names))


@query("correlations_constant_orders", correlation_sql(
    derived_sql("constant_orders"), ["o_orderkey", "k", "o_totalprice"]))
def correlations_constant_orders(spark, sf):
    return rounded(charts.correlations(derived(spark, sf, "constant_orders"), ["o_orderkey", "k", "o_totalprice"]))


WIDE = {k: f"CAST({v} AS DOUBLE)" for k, v in wide_numbers(59).items()}
_PAIRS = ", ".join(
    f"{{'a': '{a}', 'b': '{b}', 'c': corr({a}, {b})}}" for a in WIDE for b in WIDE)


@query("correlations_wide", f"""
WITH t AS (SELECT {', '.join(f'{v} AS {k}' for k, v in WIDE.items())} FROM lineitem),
p AS (SELECT unnest([{_PAIRS}]) AS p FROM t)
SELECT p.a AS col_a, p.b AS col_b, {r('CASE WHEN isnan(p.c) THEN 0 ELSE coalesce(p.c, 0) END')} AS corr FROM p""")
def correlations_wide(spark, sf):
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rounded(charts.correlations(lineitem.selectExpr(*[f"{v} AS {k}" for k, v in WIDE.items()])))


ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"]


@query("missing_patterns_orders", "SELECT " + " || ".join(
    f"CASE WHEN {n} IS NULL THEN '1' ELSE '0' END" for n in ORDER_COLUMNS
) + f" AS pattern, count(*) AS n FROM ({derived_sql('dirty_orders')}) GROUP BY 1")
def missing_patterns_orders(spark, sf):
    return rounded(charts.missing_patterns(derived(spark, sf, "dirty_orders")))


@query("missing_counts_orders", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS missing FROM ({derived_sql('dirty_orders')})"
    for n in ORDER_COLUMNS))
def missing_counts_orders(spark, sf):
    return rounded(charts.missing_counts(derived(spark, sf, "dirty_orders")))


GRID = [i / 100 for i in range(1, 100)]


def qq_sql(source: str, name: str, label: str = "observed") -> str:
    normal = ", ".join(repr(NormalDist().inv_cdf(p)) for p in GRID)
    grid = ", ".join(repr(p) for p in GRID)
    return f"""
SELECT '{name}' AS "column", {r('p')} AS p, {r('z')} AS theoretical, {r('x')} AS {label} FROM (
 SELECT unnest([{grid}]::DOUBLE[]) AS p, unnest([{normal}]::DOUBLE[]) AS z,
 unnest(quantile_cont({name}, [{grid}]::DOUBLE[])) AS x FROM ({source}))"""


@query("normal_quantiles_events", qq_sql("SELECT value FROM events", "value"))
def normal_quantiles_events(spark, sf):
    return rounded(charts.normal_quantiles(table(spark, sf, "events"), "value"))


@query("normal_quantiles_lineitem", qq_sql("SELECT l_extendedprice FROM lineitem", "l_extendedprice"))
def normal_quantiles_lineitem(spark, sf):
    return rounded(charts.normal_quantiles(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("normal_quantiles_before_after", f"""
SELECT b."column", b.p, b.theoretical, b.before, a.after
FROM ({qq_sql('SELECT value FROM events', 'value', 'before')}) b
JOIN ({qq_sql(reduced_sql('SELECT value FROM events', ['value']), 'value', 'after')}) a ON a.p = b.p""")
def normal_quantiles_before_after(spark, sf):
    events = table(spark, sf, "events").select("value")
    after = numeric.handle_skewness(events)
    return rounded(charts.compare_normal_quantiles(events, after, "value"))


def repair_sql(column: str, words: list[str], any_case: bool) -> str:
    text = f"lower({column})" if any_case else column
    cases = " ".join(
        f"WHEN contains({text}, '{w.lower() if any_case else w}') THEN '{w}'" for w in words
    )
    return f"CASE WHEN {column} = '' THEN '' {cases} ELSE left({column}, 20) END"


@query("repair_run_together_documents",
       f"SELECT {big('doc_id')} AS doc_id, {repair_sql('text', STRICT_CATEGORIES, False)} AS text, lang, source, "
       f"{big('n_chars')} AS n_chars FROM documents")
def repair_run_together_documents(spark, sf):
    return rounded(charts.repair_run_together(table(spark, sf, "documents")))


@query("repair_run_together_loose_documents",
       f"SELECT {big('doc_id')} AS doc_id, {repair_sql('text', LOOSE_CATEGORIES, True)} AS text, lang, source, "
       f"{big('n_chars')} AS n_chars FROM documents")
def repair_run_together_loose_documents(spark, sf):
    return rounded(charts.repair_run_together_loose(table(spark, sf, "documents")))
