"""Duplicate rows (R1 to R3) and constant columns (C1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from washline.operators import rows

from .common import big, derived, derived_sql, query, r, rounded, table


@query("deduplicate_whole_rows", "SELECT DISTINCT md5(text) AS text_md5, lang FROM documents")
def deduplicate_whole_rows(spark, sf):
    copies = table(spark, sf, "documents").select("text", "lang")
    return rows.deduplicate(copies).selectExpr("md5(text) AS text_md5", "lang")


@query("deduplicate_nested_times", """
SELECT DISTINCT user_id % 10 AS u, event_type, epoch_us(date_trunc('day', ts)) AS day,
    epoch_us(date_trunc('day', ts)) + event_id % 3 AS later, CAST(2 AS INTEGER) AS entries FROM events""")
def deduplicate_nested_times(spark, sf):
    """Instants a microsecond apart inside arrays and structs; maps with their entries in either order."""
    day = F.unix_micros(F.date_trunc("DAY", "ts"))
    a, b = [F.lit("a"), F.lit(1)], [F.lit("b"), F.lit(2)]
    nested = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("u"),
        F.struct("event_type", F.array(
            F.timestamp_micros(day), F.timestamp_micros(day + F.col("event_id") % 3)
        ).alias("times")).alias("what"),
        F.when(F.col("event_id") % 2 == 0, F.create_map(*a, *b)).otherwise(F.create_map(*b, *a)).alias("marks"),
    )
    return rows.deduplicate(nested).select(
        "u", "what.event_type", F.unix_micros(F.get("what.times", F.lit(0))).alias("day"),
        F.unix_micros(F.get("what.times", F.lit(1))).alias("later"), F.size("marks").alias("entries"),
    )


def kept_sql(source: str, columns: str, keys: str, order: str) -> str:
    return (
        f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn "
        f"FROM {source}) WHERE rn = 1"
    )


EVENT = f"{big('event_id')} AS event_id, {big('user_id')} AS user_id, event_type, {r('value')} AS value"


@query("deduplicate_keep_first", kept_sql("events", EVENT, "user_id, event_type", "ts, event_id"))
def deduplicate_keep_first(spark, sf):
    events = table(spark, sf, "events")
    kept = rows.deduplicate(events, ["user_id", "event_type"], "first", ["ts", "event_id"])
    return rounded(kept.select("event_id", "user_id", "event_type", "value"))


@query("deduplicate_keep_last", kept_sql("events", EVENT, "user_id, event_type", "ts DESC, event_id DESC"))
def deduplicate_keep_last(spark, sf):
    events = table(spark, sf, "events")
    kept = rows.deduplicate(events, ["user_id", "event_type"], "last", ["ts", "event_id"])
    return rounded(kept.select("event_id", "user_id", "event_type", "value"))


@query("deduplicate_keep_first_documents", kept_sql(
    "documents", f"{big('doc_id')} AS doc_id, lang, source, md5(text) AS text_md5", "text, lang", "doc_id"))
def deduplicate_keep_first_documents(spark, sf):
    kept = rows.deduplicate(table(spark, sf, "documents"), ["text", "lang"], "first", "doc_id")
    return rounded(kept.selectExpr("doc_id", "lang", "source", "md5(text) AS text_md5"))


@query("deduplicate_keep_none", f"""
SELECT {big('doc_id')} AS doc_id, lang, source, md5(text) AS text_md5 FROM documents
WHERE (text, lang) IN (SELECT (text, lang) FROM documents GROUP BY text, lang HAVING count(*) = 1)""")
def deduplicate_keep_none(spark, sf):
    kept = rows.deduplicate(table(spark, sf, "documents"), ["text", "lang"], keep=False)
    return rounded(kept.selectExpr("doc_id", "lang", "source", "md5(text) AS text_md5"))


@query("drop_constant_columns",
       f"SELECT {big('o_orderkey')} AS o_orderkey, {r('o_totalprice')} AS o_totalprice "
       f"FROM ({derived_sql('constant_orders')})")
def drop_constant_columns(spark, sf):
    return rounded(rows.drop_constant(derived(spark, sf, "constant_orders")))
