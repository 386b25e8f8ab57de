"""Registry, derived inputs and SQL helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.functions.columns import col
from washline.operators.checkpoints import new_folder as scratch  # noqa: F401

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        assert name not in REGISTERED, name
        REGISTERED[name] = (run, sql)
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Derived inputs: the tables hold no missing values, infinities or broken dates, so dirt is made by
# expressions that mean the same in Spark and in the checking SQL.
INPUTS: dict[str, tuple[str, list[str]]] = {
    "dirty_lineitem": ("lineitem", [
        "l_orderkey", "l_linenumber",
        "CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
        "l_discount",
        "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
        "l_linestatus",
    ]),
    "skewed_events": ("events", [
        "event_id", "user_id", "event_type", "value", "value * value AS squared",
        "value - 100 AS shifted",
    ]),
    "gaps": ("events", [
        "event_id", "user_id",
        "CASE WHEN event_id % 7 <> 0 OR event_id < 25 THEN NULL ELSE value END AS value",
        "CASE WHEN event_id % 3 <> 0 THEN NULL ELSE event_type END AS event_type",
    ]),
    "infinite_events": ("events", [
        "event_id",
        "CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE)"
        " WHEN event_id % 101 = 0 THEN CAST('-Infinity' AS DOUBLE)"
        " WHEN event_id % 103 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value",
    ]),
    "dirty_orders": ("orders", [
        "o_orderkey",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "o_custkey",
    ]),
    "constant_orders": ("orders", [
        "o_orderkey", "1 AS k", "CAST(NULL AS DOUBLE) AS e", "o_totalprice",
    ]),
    "text_dates": ("orders", [
        "o_orderkey",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'soon' "
        "ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 19) END AS o_orderdate",
    ]),
    "odd_conversations": ("conversations", [
        "conv_id", "turn", "role",
        "CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS text",
    ]),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, expressions = INPUTS[name]
    return table(spark, sf_dir, source).selectExpr(*expressions)


def derived_sql(name: str) -> str:
    source, expressions = INPUTS[name]
    return f"SELECT {', '.join(expressions)} FROM {source}"


def wide_numbers(n: int) -> dict[str, str]:
    """Columns derived from lineitem, some of them with gaps, one of equal values."""
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
    out = {}
    for i in range(n):
        value = f"({base[i % 6]} * {i + 1} + {base[(i + 1) % 6]} * {(i % 7) - 3}) * 0.001"
        out[f"c{i:03d}"] = f"CASE WHEN (l_orderkey + {i}) % {5 + i % 9} = 0 THEN NULL ELSE {value} END" if i % 3 else value
    return out | {"flat": "7.0"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (without a negative zero) and integers as bigint, for comparison."""
    out = []
    for f in df.schema:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            r = F.round(c.cast("double"), digits)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    e = f"round(CAST({expression} AS DOUBLE), {digits})"
    return f"CASE WHEN {e} = 0 THEN 0.0::DOUBLE ELSE {e} END"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def fixed(expression: str, digits: int) -> str:
    """A number with fixed digits as text, halves rounded up."""
    return f"printf('%.{digits}f', round(CAST({expression} AS DECIMAL(28, 9)), {digits})::DOUBLE)"


# Whitespace as the text steps understand it, written for the checking engine.
SQL_SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def tokens_sql(expression: str) -> str:
    return f"list_filter(string_split_regex({expression}, '[{SQL_SPACE}]+'), lambda w: w <> '')"


def words_sql(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
