"""Categorical encoding: E1 to E7."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from washline.functions.columns import ROLE
from washline.operators import encode, numeric, rows

from .common import big, derived, derived_sql, query, r, rounded

ORDERS = derived_sql("dirty_orders")
STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
KEY = f"{big('o_orderkey')} AS o_orderkey"


def one_hot_sql(name: str, values: list[str]) -> str:
    hits = [f"CAST(coalesce({name} = '{v}', false) AS BIGINT) AS \"{name}_{v}\"" for v in values]
    return ", ".join([*hits, f"CAST({name} IS NULL AS BIGINT) AS {name}_nan"])


@query("one_hot_columns", f"SELECT {KEY}, {one_hot_sql('o_orderstatus', STATUSES)}, "
       f"{one_hot_sql('o_orderpriority', PRIORITIES)} FROM ({ORDERS})")
def one_hot_columns(spark, sf):
    orders = derived(spark, sf, "dirty_orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rounded(encode.encode(orders, keep_original=False))


RANKED = f"""ranked AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i
FROM t WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)"""


@query("one_hot_vector", f"""
WITH t AS ({ORDERS}), {RANKED}
SELECT {KEY}, array_to_string(list_transform(range(6), lambda k: CASE WHEN k = coalesce(i, 5) THEN '1.0' ELSE '0.0' END), '|') AS priority
FROM t LEFT JOIN ranked ON o_orderpriority = v""")
def one_hot_vector(spark, sf):
    orders = derived(spark, sf, "dirty_orders").select("o_orderkey", "o_orderpriority")
    out = encode.encode_vector(orders, "o_orderpriority", "priority")
    return rounded(out.select("o_orderkey", vector_to_array("priority").alias("priority")))


def label_sql(name: str) -> str:
    return (f"CASE WHEN {name} IS NULL THEN (SELECT count(DISTINCT {name}) FROM t) "
            f"ELSE dense_rank() OVER (ORDER BY {name} NULLS LAST) - 1 END")


@query("label_encode_keep", f"""
WITH t AS ({ORDERS})
SELECT {KEY}, o_orderpriority, {big(label_sql('o_orderpriority'))} AS o_orderpriority_encoded FROM t""")
def label_encode_keep(spark, sf):
    orders = derived(spark, sf, "dirty_orders").select("o_orderkey", "o_orderpriority")
    return rounded(encode.encode(orders, method="label"))


@query("label_encode_in_place", f"""
WITH t AS ({ORDERS}) SELECT {KEY}, {big(label_sql('o_orderstatus'))} AS o_orderstatus,
{big(label_sql('o_orderpriority'))} AS o_orderpriority FROM t""")
def label_encode_in_place(spark, sf):
    orders = derived(spark, sf, "dirty_orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rounded(encode.encode(orders, method="label", keep_original=False))


@query("label_encode_by_frequency", f"""
WITH t AS ({ORDERS}), {RANKED}
SELECT {KEY}, {big('coalesce(i, 5)')} AS o_orderpriority FROM t LEFT JOIN ranked ON o_orderpriority = v""")
def label_encode_by_frequency(spark, sf):
    orders = derived(spark, sf, "dirty_orders").select("o_orderkey", "o_orderpriority")
    return rounded(encode.encode(orders, method="label", keep_original=False, order="frequency"))


_TEXTS = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS text FROM documents)"


@query("label_encode_many_values", f"""
WITH t AS (SELECT * FROM {_TEXTS})
SELECT {big('doc_id')} AS doc_id, {big(label_sql('text'))} AS text FROM t""")
def label_encode_many_values(spark, sf):
    """Whole texts as categories, a third of them missing."""
    documents = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS text")
    return rounded(encode.encode(documents, "text", method="label", keep_original=False))


def fitted_codes_sql(source: str, half: str) -> str:
    """Codes fitted on half of the rows; unseen and missing values get the next one."""
    return f"""
WITH t AS ({source}), f AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
     FROM (SELECT DISTINCT v FROM t WHERE {half} AND v IS NOT NULL))
SELECT {{key}}, {big('coalesce(code, (SELECT count(*) FROM f))')} AS v FROM t LEFT JOIN f USING (v)"""


def fitted_codes(df, half: str):
    params = encode.fit_encode(df.where(half), "v", "label", keep_original=False)
    return rounded(encode.apply_encode(df, params))


@query("label_codes_on_new_rows", fitted_codes_sql(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN 'c' || o_custkey END AS v FROM orders", "o_orderkey % 2 = 0"
).format(key=KEY))
def label_codes_on_new_rows(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 17 <> 0 THEN concat('c', o_custkey) END AS v")
    return fitted_codes(orders, "o_orderkey % 2 = 0")


@query("label_codes_of_many_values", fitted_codes_sql(
    "SELECT l_orderkey, l_linenumber, l_orderkey || '/' || l_partkey || '/' || l_suppkey AS v FROM lineitem",
    "l_orderkey % 2 = 0"
).format(key=f"{big('l_orderkey')} AS l_orderkey, {big('l_linenumber')} AS l_linenumber"))
def label_codes_of_many_values(spark, sf):
    """More categories than a list may hold at sf0.01, through the same call."""
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_linenumber", "concat_ws('/', l_orderkey, l_partkey, l_suppkey) AS v")
    return fitted_codes(lineitem, "l_orderkey % 2 = 0")


@query("one_hot_vectors", f"""
WITH d AS ({ORDERS}), p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, v) - 1 AS i FROM d WHERE v IS NOT NULL GROUP BY 1),
s AS (SELECT o_orderstatus AS w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS k FROM d WHERE w IS NOT NULL GROUP BY 1)
SELECT {KEY}, array_to_string(list_transform(range(6), lambda x: CASE WHEN x = coalesce(i, 5) THEN '1.0' ELSE '0.0' END), '|') AS priority,
array_to_string(list_transform(range(4), lambda x: CASE WHEN x = coalesce(k, 3) THEN '1.0' ELSE '0.0' END), '|') AS status
FROM d LEFT JOIN p ON o_orderpriority = v LEFT JOIN s ON o_orderstatus = w""")
def one_hot_vectors(spark, sf):
    orders = derived(spark, sf, "dirty_orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    out = encode.encode_vector(orders, ["o_orderpriority", "o_orderstatus"], ["priority", "status"])
    return rounded(out.select("o_orderkey", *[vector_to_array(c).alias(c) for c in ("priority", "status")]))


@query("fill_numbers_with_zero", f"""
SELECT {KEY}, o_orderstatus, o_orderpriority, {r('coalesce(o_totalprice, 0)')} AS o_totalprice,
{big('o_custkey')} AS o_custkey FROM ({ORDERS})""")
def fill_numbers_with_zero(spark, sf):
    return rounded(numeric.fill_numeric_with_zero(derived(spark, sf, "dirty_orders")))


@query("drop_repeated_column_names", f"SELECT {KEY}, {r('o_totalprice')} AS o_totalprice FROM ({ORDERS})")
def drop_repeated_column_names(spark, sf):
    orders = derived(spark, sf, "dirty_orders").select("o_orderkey", "o_totalprice")
    return rounded(rows.drop_repeated_names(orders.select("*", (F.col("o_totalprice") * 2).alias("o_totalprice"))))


@query("encode_auto_strategy", f"""
WITH t AS (SELECT o_orderkey, o_orderstatus, 'c' || (o_custkey % 50) AS customer_group FROM ({ORDERS}))
SELECT {KEY}, {one_hot_sql('o_orderstatus', STATUSES)}, {big(label_sql('customer_group'))} AS customer_group FROM t""")
def encode_auto_strategy(spark, sf):
    orders = derived(spark, sf, "dirty_orders").selectExpr(
        "o_orderkey", "o_orderstatus", "concat('c', o_custkey % 50) AS customer_group")
    return rounded(encode.encode(orders, method="auto", keep_original=False))


@query("encoding_roles", f"""
WITH t AS ({ORDERS})
SELECT 'o_orderstatus_' || coalesce(o_orderstatus, 'nan') AS "column", 'onehot' AS role, count(*) AS rows FROM t GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', 'label', count(*) FROM t""")
def encoding_roles(spark, sf):
    orders = derived(spark, sf, "dirty_orders").select("o_orderstatus", "o_orderpriority")
    encoded = encode.encode(orders, "o_orderstatus", keep_original=False)
    encoded = encode.encode(encoded, "o_orderpriority", method="label", keep_original=False)
    rows_ = F.array(*[
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.metadata[ROLE]).alias("role"),
            (F.sum(f"`{f.name}`") if f.metadata[ROLE] == "onehot" else F.count(F.lit(1))).alias("rows"),
        ) for f in encoded.schema
    ])
    return rounded(encoded.agg(rows_.alias("r")).select(F.inline("r")))
