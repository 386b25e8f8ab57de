"""Numeric cleaning and scaling (N1 to N16) and dates (D1, D2)."""

from __future__ import annotations

from washline.operators import dates, impute, numeric, scale

from .common import big, derived, derived_sql, query, r, rounded, table

KEYS = f"{big('l_orderkey')} AS l_orderkey, {big('l_linenumber')} AS l_linenumber"
DIRTY = derived_sql("dirty_lineitem")
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def with_columns(source: str, keys: str, expressions: dict[str, str]) -> str:
    """Keys, and rounded expressions over columns and the one-row table ``s``."""
    return f"SELECT {keys}, " + ", ".join(f"{r(e)} AS {n}" for n, e in expressions.items()) + f" FROM {source}"


def stats(names, *functions) -> str:
    """A one-row table of ``<function>_<name>`` over t."""
    calls = {
        "avg": "avg({n})", "std": "stddev_samp({n})", "min": "CAST(min({n}) AS DOUBLE)", "max": "CAST(max({n}) AS DOUBLE)",
        "q1": "quantile_cont({n}, 0.25)", "q2": "quantile_cont({n}, 0.5)", "q3": "quantile_cont({n}, 0.75)",
        "skew": "skewness({n})",
    }
    return "(SELECT " + ", ".join(f"{calls[f].format(n=n)} AS {f}_{n}" for n in names for f in functions) + " FROM t) s"


def lineitem_keys(df):
    return df.select("l_orderkey", "l_linenumber", *NUMBERS)


@query("fix_infinite_events", f"""
SELECT {big('event_id')} AS event_id, CASE WHEN isinf(value) OR isnan(value) THEN NULL ELSE {r('value')} END AS value
FROM ({derived_sql('infinite_events')})""")
def fix_infinite_events(spark, sf):
    return rounded(numeric.fix_infinite(derived(spark, sf, "infinite_events")))


@query("impute_mean", f"WITH t AS ({DIRTY}) " + with_columns(
    f"t, {stats(NUMBERS, 'avg')}", KEYS, {n: f"coalesce({n}, avg_{n})" for n in NUMBERS}))
def impute_mean(spark, sf):
    return rounded(lineitem_keys(impute.impute(derived(spark, sf, "dirty_lineitem"), NUMBERS, "mean")))


@query("impute_median", f"WITH t AS ({DIRTY}) " + with_columns(
    f"t, {stats(NUMBERS, 'q2')}", KEYS, {n: f"coalesce({n}, q2_{n})" for n in NUMBERS}))
def impute_median(spark, sf):
    return rounded(lineitem_keys(impute.impute(derived(spark, sf, "dirty_lineitem"), NUMBERS, "median")))


@query("impute_median_bracketed", f"WITH t AS ({DIRTY}) " + with_columns(
    f"t, {stats(['l_extendedprice'], 'q2')}", KEYS, {"l_extendedprice": "coalesce(l_extendedprice, q2_l_extendedprice)"}))
def impute_median_bracketed(spark, sf):
    """The large-table way: ranks bracketed by sketches and counts."""
    from washline.operators.quantiles import quantiles
    dirty = derived(spark, sf, "dirty_lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    median = quantiles(dirty, {"l_extendedprice": [0.5]}, small=0, fetch=100)["l_extendedprice"][0.5]
    params = {"l_extendedprice": {"strategy": "median", "value": median}}
    return rounded(impute.apply_impute(dirty, params))


def mode_sql(n: str) -> str:
    return f"(SELECT {n} FROM t WHERE {n} IS NOT NULL GROUP BY {n} ORDER BY count(*) DESC, {n} LIMIT 1)"


@query("impute_mode", f"""
WITH t AS ({derived_sql('dirty_orders')})
SELECT {big('o_orderkey')} AS o_orderkey, coalesce(o_orderstatus, {mode_sql('o_orderstatus')}) AS o_orderstatus,
coalesce(o_orderpriority, {mode_sql('o_orderpriority')}) AS o_orderpriority,
{r(f"coalesce(o_totalprice, {mode_sql('o_totalprice')})")} AS o_totalprice, {big('o_custkey')} AS o_custkey FROM t""")
def impute_mode(spark, sf):
    return rounded(impute.impute(derived(spark, sf, "dirty_orders"), strategy="mode"))


@query("impute_auto", f"""
WITH t AS ({DIRTY}), s AS (SELECT * FROM {stats(['l_quantity', 'l_extendedprice'], 'avg', 'std', 'min', 'max', 'q2')})
SELECT {KEYS}, """ + ", ".join(
    r(f"coalesce({n}, CASE WHEN greatest(max_{n} - avg_{n}, avg_{n} - min_{n}) / std_{n} > 3 "
      f"THEN q2_{n} ELSE avg_{n} END)") + f" AS {n}" for n in ("l_quantity", "l_extendedprice")
) + f""", {r('l_discount')} AS l_discount, coalesce(l_returnflag, {mode_sql('l_returnflag')}) AS l_returnflag,
l_linestatus FROM t, s""")
def impute_auto(spark, sf):
    return rounded(impute.impute(derived(spark, sf, "dirty_lineitem")))


@query("impute_auto_with_outliers", f"""
WITH t AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value * value END AS value FROM events)
SELECT {big('event_id')} AS event_id, {r('''coalesce(value, CASE WHEN
 greatest(max_value - avg_value, avg_value - min_value) / std_value > 3 THEN q2_value ELSE avg_value END)''')} AS value
FROM t, {stats(['value'], 'avg', 'std', 'min', 'max', 'q2')}""")
def impute_auto_with_outliers(spark, sf):
    events = table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value * value END AS value")
    return rounded(impute.impute(events, "value"))


@query("impute_mean_on_text_falls_back", f"""
WITH t AS ({derived_sql('dirty_orders')})
SELECT {big('o_orderkey')} AS o_orderkey, coalesce(o_orderstatus, {mode_sql('o_orderstatus')}) AS o_orderstatus,
{r("coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM t))")} AS o_totalprice FROM t""")
def impute_mean_on_text_falls_back(spark, sf):
    orders = derived(spark, sf, "dirty_orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rounded(impute.impute(orders, strategy="mean"))


def fill_sql(which: str, partition: str, frame: str) -> str:
    over = f"OVER ({partition} ORDER BY event_id ROWS BETWEEN {frame})"
    return f"""
SELECT {big('event_id')} AS event_id, {big('user_id')} AS user_id,
{r(f'{which}(value IGNORE NULLS) {over}')} AS value, {which}(event_type IGNORE NULLS) {over} AS event_type
FROM ({derived_sql('gaps')})"""


_BEFORE, _AFTER = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"


@query("forward_fill", fill_sql("last_value", "", _BEFORE))
def forward_fill(spark, sf):
    gaps = derived(spark, sf, "gaps")
    return rounded(impute.ordered_fill(gaps, ["value", "event_type"], "event_id", buckets=16))


@query("backward_fill", fill_sql("first_value", "", _AFTER))
def backward_fill(spark, sf):
    gaps = derived(spark, sf, "gaps")
    return rounded(impute.ordered_fill(gaps, ["value", "event_type"], "event_id", forward=False, buckets=16))


@query("forward_fill_per_user", fill_sql("last_value", "PARTITION BY user_id", _BEFORE))
def forward_fill_per_user(spark, sf):
    gaps = derived(spark, sf, "gaps")
    return rounded(impute.ordered_fill(gaps, ["value", "event_type"], "event_id", "user_id", buckets=16))


@query("backward_fill_per_user", fill_sql("first_value", "PARTITION BY user_id", _AFTER))
def backward_fill_per_user(spark, sf):
    gaps = derived(spark, sf, "gaps")
    return rounded(impute.impute(
        gaps, ["value", "event_type"], "backward_fill", order_by="event_id", partition_by="user_id"))


def scaled_sql(centre: str, spread: str, *functions: str) -> str:
    return f"WITH t AS ({DIRTY}) " + with_columns(
        f"t, {stats(NUMBERS, *functions)}", KEYS,
        {n: f"({n} - {centre.format(n=n)}) / ({spread.format(n=n)})" for n in NUMBERS})


@query("normalize_minmax", scaled_sql("min_{n}", "max_{n} - min_{n}", "min", "max"))
def normalize_minmax(spark, sf):
    return rounded(lineitem_keys(scale.normalize(derived(spark, sf, "dirty_lineitem"), NUMBERS)))


@query("normalize_quantile_range", scaled_sql("q1_{n}", "q3_{n} - q1_{n}", "q1", "q3"))
def normalize_quantile_range(spark, sf):
    return rounded(lineitem_keys(scale.normalize(derived(spark, sf, "dirty_lineitem"), NUMBERS, "robust")))


@query("standardize_z_score", scaled_sql("avg_{n}", "std_{n}", "avg", "std"))
def standardize_z_score(spark, sf):
    return rounded(lineitem_keys(scale.standardize(derived(spark, sf, "dirty_lineitem"), NUMBERS)))


@query("standardize_robust", scaled_sql("q2_{n}", "q3_{n} - q1_{n}", "q1", "q2", "q3"))
def standardize_robust(spark, sf):
    return rounded(lineitem_keys(scale.standardize(derived(spark, sf, "dirty_lineitem"), NUMBERS, "robust")))


@query("standardize_zero_spread", f"""
WITH t AS ({derived_sql('constant_orders')})
SELECT {big('o_orderkey')} AS o_orderkey, 0.0::DOUBLE AS k, CAST(NULL AS DOUBLE) AS e,
{r('(o_totalprice - avg_o_totalprice) / std_o_totalprice')} AS o_totalprice
FROM t, {stats(['o_totalprice'], 'avg', 'std')}""")
def standardize_zero_spread(spark, sf):
    return rounded(scale.standardize(derived(spark, sf, "constant_orders"), ["k", "e", "o_totalprice"]))


def outlier_sql(instead: dict[str, str]) -> str:
    """``instead``: what replaces a value below and above the fences."""
    low, high = "q1_value - 1.5 * (q3_value - q1_value)", "q3_value + 1.5 * (q3_value - q1_value)"
    below, above = (e.format(low=low, high=high) for e in (instead["below"], instead["above"]))
    case = f"CASE WHEN value < {low} THEN {below} WHEN value > {high} THEN {above} ELSE value END"
    return f"""
WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT {big('event_id')} AS event_id, {r(case)} AS value FROM t, {stats(['value'], 'q1', 'q2', 'q3')}"""


def _events_with_gaps(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value")


@query("outliers_clip", outlier_sql({"below": "{low}", "above": "{high}"}))
def outliers_clip(spark, sf):
    return rounded(numeric.handle_outliers(_events_with_gaps(spark, sf), "value", "clip"))


@query("outliers_to_median", outlier_sql({"below": "q2_value", "above": "q2_value"}))
def outliers_to_median(spark, sf):
    return rounded(numeric.handle_outliers(_events_with_gaps(spark, sf), "value", "median"))


@query("outliers_to_missing", outlier_sql({"below": "NULL", "above": "NULL"}))
def outliers_to_missing(spark, sf):
    return rounded(numeric.handle_outliers(_events_with_gaps(spark, sf), "value", "nan"))


def reduced(n: str) -> str:
    return (f"CASE WHEN abs(skew_{n}) > 1 THEN CASE WHEN min_{n} <= 0 THEN ln(1 + {n} - min_{n} + 1) "
            f"ELSE ln(1 + {n}) END ELSE {n} END")


def reduced_sql(source: str, names: list[str]) -> str:
    """The named columns after the skew rule, unrounded."""
    columns = ", ".join(f"{reduced(n)} AS {n}" for n in names)
    return f"WITH t AS ({source}) SELECT {columns} FROM t, {stats(names, 'skew', 'min')}"


def skew_sql(source: str, keys: str, names: list[str]) -> str:
    return f"WITH t AS ({source}) " + with_columns(
        f"t, {stats(names, 'skew', 'min')}", keys, {n: reduced(n) for n in names})


@query("reduce_skewness_events", skew_sql(
    derived_sql("skewed_events"), f"{big('event_id')} AS event_id", ["value", "squared", "shifted"]))
def reduce_skewness_events(spark, sf):
    events = derived(spark, sf, "skewed_events").select("event_id", "value", "squared", "shifted")
    return rounded(numeric.handle_skewness(events, ["value", "squared", "shifted"]))


@query("reduce_skewness_leaves_even_columns", skew_sql(DIRTY, KEYS, NUMBERS))
def reduce_skewness_leaves_even_columns(spark, sf):
    return rounded(lineitem_keys(numeric.handle_skewness(derived(spark, sf, "dirty_lineitem"), NUMBERS)))


@query("skewness_on_new_rows", f"""
WITH t AS ({derived_sql('skewed_events')}), f AS (SELECT min(shifted) AS lo, min(squared) AS least FROM t WHERE event_id % 2 = 0 AND value > 20)
SELECT {big('event_id')} AS event_id, {r('ln(1 + (greatest(shifted, lo) - lo + 1))')} AS shifted,
{r('ln(1 + greatest(squared, least))')} AS squared FROM t, f""")
def skewness_on_new_rows(spark, sf):
    """Fitted on some rows, applied to all: values below the fitted minimum count as the minimum."""
    events = derived(spark, sf, "skewed_events").select("event_id", "value", "shifted", "squared")
    params = numeric.fit_skewness(events.where("event_id % 2 = 0 AND value > 20"), ["shifted", "squared"])
    return rounded(numeric.apply_skewness(events.drop("value"), params))


_AT = "try_strptime(o_orderdate, '%Y-%m-%d %H:%M:%S')"


@query("parse_dates", f"""
SELECT {big('o_orderkey')} AS o_orderkey, strftime({_AT}, '%Y-%m-%d %H:%M:%S') AS o_orderdate
FROM ({derived_sql('text_dates')})""")
def parse_dates(spark, sf):
    parsed = dates.parse_datetimes(derived(spark, sf, "text_dates"))
    return rounded(parsed.selectExpr(
        "o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS o_orderdate"))


def parts_sql(at: str) -> str:
    return (f"{big(f'year({at})')} AS o_orderdate_year, {big(f'month({at})')} AS o_orderdate_month, "
            f"{big(f'day({at})')} AS o_orderdate_day, {big(f'isodow({at}) - 1')} AS o_orderdate_weekday, "
            f"{big(f'hour({at})')} AS o_orderdate_hour")


@query("date_parts_from_text", f"SELECT {big('o_orderkey')} AS o_orderkey, {parts_sql(_AT)}, "
       f"isodow({_AT}) >= 6 AS o_orderdate_is_weekend, {big(f'quarter({_AT})')} AS o_orderdate_quarter "
       f"FROM ({derived_sql('text_dates')})")
def date_parts_from_text(spark, sf):
    return rounded(dates.handle_datetime(derived(spark, sf, "text_dates"), is_weekend=True, quarter=True))


@query("date_parts_from_timestamp", f"SELECT {big('o_orderkey')} AS o_orderkey, {parts_sql('o_orderdate')} FROM orders")
def date_parts_from_timestamp(spark, sf):
    return rounded(dates.handle_datetime(table(spark, sf, "orders").select("o_orderkey", "o_orderdate")))


@query("date_parts_beside_numbers", f"""
SELECT {big('o_orderkey')} AS o_orderkey, {r('o_totalprice')} AS update_time, {parts_sql(_AT)}
FROM ({derived_sql('text_dates')}) JOIN (SELECT o_orderkey, o_totalprice FROM orders) USING (o_orderkey)""")
def date_parts_beside_numbers(spark, sf):
    """A number called a time is left alone; the text is taken apart."""
    prices = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice AS update_time")
    return rounded(dates.handle_datetime(derived(spark, sf, "text_dates").join(prices, "o_orderkey")))
