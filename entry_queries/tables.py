"""Sources and sinks: S1 to S9."""

from __future__ import annotations

from pyspark.sql import functions as F

from washline.operators import encode
from washline.sources import tables as io

from .common import big, derived, derived_sql, query, r, rounded, scratch, table


@query("csv_round_trip", f"SELECT {big('c_custkey')} AS c_custkey, c_name, "
       f"{big('c_nationkey')} AS c_nationkey, {r('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    path = scratch(spark) + "/customer.csv"
    io.write_table(table(spark, sf, "customer"), path)
    return rounded(io.read_table(spark, path))


@query("csv_round_trip_documents", f"SELECT {big('doc_id')} AS doc_id, md5(t) AS digest, t IS NULL AS missing, "
       f"lang, source, {big('n_chars')} AS n_chars FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN NULL "
       "WHEN doc_id % 10 = 1 THEN '' WHEN doc_id % 10 = 2 THEN ' \"' || text || '\", ' ELSE text END AS t FROM documents)")
def csv_round_trip_documents(spark, sf):
    """Texts with line breaks, quotes, spaces at their ends; some empty, some missing."""
    path = scratch(spark) + "/documents.csv"
    documents = table(spark, sf, "documents").withColumn("text", F.expr(
        "CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' "
        "WHEN doc_id % 10 = 2 THEN concat(' \"', text, '\", ') ELSE text END"))
    io.write_table(documents, path)
    back = io.read_table(spark, path)
    return rounded(back.select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("text").isNull().alias("missing"),
        "lang", "source", "n_chars"))


@query("csv_crlf_documents", f"SELECT {big('doc_id')} AS doc_id, md5(text || chr(13) || chr(10) || source) AS digest, "
       f"lang, {big('n_chars')} AS n_chars FROM documents")
def csv_crlf_documents(spark, sf):
    """Lines that end in carriage return and line feed, as well as such breaks inside quotes."""
    path = scratch(spark) + "/documents.csv"
    quoted = F.concat(F.lit('"'), F.replace(F.concat("text", F.lit("\r\n"), "source"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", "doc_id", quoted, "lang", F.concat("n_chars", F.lit("\r")))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within its file
    header = F.when(place == 0, F.lit("doc_id,text,lang,n_chars\r\n")).otherwise("")
    table(spark, sf, "documents").select(F.concat(header, line)).write.text(path)
    back = io.read_table(spark, path)
    return rounded(back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "lang", "n_chars"))


@query("json_round_trip", f"SELECT {big('o_orderkey')} AS o_orderkey, "
       f"{big('o_custkey')} AS o_custkey, o_orderstatus, o_orderpriority, "
       f"{r('o_totalprice')} AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate "
       f"FROM ({derived_sql('dirty_orders')}) JOIN (SELECT o_orderkey, o_orderdate FROM orders) USING (o_orderkey)")
def json_round_trip(spark, sf):
    path = scratch(spark) + "/orders.JSON"
    dates = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    io.write_table(derived(spark, sf, "dirty_orders").join(dates, "o_orderkey"), path)
    back = io.read_table(spark, path)
    return rounded(back.withColumn("o_orderdate", F.date_format(
        F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")))


_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_AMOUNTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("parquet_round_trip", f"SELECT {', '.join(f'{big(n)} AS {n}' for n in _LINEITEM)}, "
       f"{', '.join(f'{r(n)} AS {n}' for n in _AMOUNTS)}, l_returnflag, l_linestatus, "
       "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem")
def parquet_round_trip(spark, sf):
    path = scratch(spark) + "/lineitem.parquet"
    io.write_table(table(spark, sf, "lineitem"), path)
    back = io.read_table(spark, path)
    return rounded(back.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")))


@query("preview_first_orders", f"SELECT {big('o_orderkey')} AS o_orderkey, o_orderstatus, "
       f"{r('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000")
def preview_first_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rounded(io.preview(orders, order_by="o_orderkey"))


@query("snapshot_shape", "SELECT 'initial' AS step, count(*) AS rows, CAST(5 AS BIGINT) AS columns FROM orders")
def snapshot_shape(spark, sf):
    stored, shape = io.snapshot(derived(spark, sf, "dirty_orders"), scratch(spark), "initial")
    return stored.agg(
        F.lit(shape["step"]).alias("step"), F.count(F.lit(1)).alias("rows"),
        F.lit(shape["columns"]).cast("bigint").alias("columns"),
    )


# most frequent first, ties by value; the last slot is the missing one
_RANKED = """
SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i
FROM d WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
"""


@query("one_hot_vector_expanded", f"""
WITH d AS ({derived_sql('dirty_orders')}), ranked AS ({_RANKED})
SELECT {big('o_orderkey')} AS o_orderkey,
{', '.join(f"CASE WHEN coalesce(i, 5) = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS priority_{k}" for k in range(6))}
FROM d LEFT JOIN ranked ON o_orderpriority = v
""")
def one_hot_vector_expanded(spark, sf):
    orders = derived(spark, sf, "dirty_orders").select("o_orderkey", "o_orderpriority")
    vectors = encode.encode_vector(orders, "o_orderpriority", "priority").drop("o_orderpriority")
    return rounded(io.expand_vectors(vectors))
