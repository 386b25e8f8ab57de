"""Column typing (T1 to T6), profiles and reports (P1 to P11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from washline.operators import impute, numeric, profile, quality, states, typing

from .common import (
    big, derived, derived_sql, fixed, query, r, rounded, scratch, table, tokens_sql, wide_numbers,
)
from .expected import NO_TEXT_PARTS
from .numeric import reduced_sql

DIRTY = [
    ("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
    ("l_extendedprice", "double"), ("l_discount", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"),
]
CUSTOMER = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
    ("c_acctbal", "double"), ("c_mktsegment", "string"),
]
DOCUMENTS = [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
    ("n_chars", "bigint"),
]
NUMERIC = ("bigint", "int", "double")
DIGITS = 5  # the mean of two-decimal values can sit on a tie at the sixth digit


def union(columns, one) -> str:
    return "\nUNION ALL\n".join(one(i, n, t) for i, (n, t) in enumerate(columns))


def key_sql(n: str) -> str:
    """Short values order by themselves, long texts by their digest."""
    return f"CASE WHEN length({n}) > 64 THEN '#' || sha256({n}) ELSE {n} END"


def profile_sql(source: str, columns) -> str:
    def one(i, n, t):
        number = t in NUMERIC
        stats = ", ".join(
            f"{r(f'{f}({n})', DIGITS) if number else 'CAST(NULL AS DOUBLE)'} AS {a}"
            for f, a in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_samp", "std"))
        )
        preview = "CAST(NULL AS VARCHAR)" if number else (
            f"(SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT DISTINCT {n} AS v, {key_sql(n)} AS k FROM t "
            f"WHERE {n} IS NOT NULL ORDER BY k LIMIT 50))"
        )
        distinct = "CAST(NULL AS BIGINT)" if number else f"count(DISTINCT {n})"
        return (
            f"SELECT {big(i)} AS position, '{n}' AS \"column\", '{t}' AS dtype, "
            f"'{'numerical' if number else 'categorical'}' AS kind, count({n}) AS non_null, "
            f"count(*) - count({n}) AS nulls, {stats}, {distinct} AS unique_count, "
            f"{preview} AS sample_unique FROM t"
        )
    return f"WITH t AS ({source}) {union(columns, one)}"


@query("profile_lineitem", profile_sql(derived_sql("dirty_lineitem"), DIRTY))
def profile_lineitem(spark, sf):
    return rounded(profile.profile(derived(spark, sf, "dirty_lineitem")), DIGITS)


@query("profile_from_merged_states", f"""
SELECT "column", dtype, non_null, nulls, min, max, mean, std, unique_count, sample_unique
FROM ({profile_sql(derived_sql("dirty_lineitem"), DIRTY)})""")
def profile_from_merged_states(spark, sf):
    """States of three parts, each written and read again, and what they add up to."""
    lineitem = derived(spark, sf, "dirty_lineitem")
    parts = []
    for i in range(3):
        path = f"{scratch(spark)}/part"
        states.profile_state(lineitem.where(F.col("l_orderkey") % 3 == i)).write.parquet(path)
        parts.append(spark.read.parquet(path))
    merged = states.profile_of_state(states.merge_states(parts))
    texts = F.col("kind") == "categorical"
    return rounded(merged.select(
        "column", "dtype", "non_null", "nulls", "min", "max", "mean", "std",
        F.when(texts, F.col("unique_count")).alias("unique_count"), "sample_unique",
    ), DIGITS)


@query("profile_documents", profile_sql("SELECT * FROM documents", DOCUMENTS))
def profile_documents(spark, sf):
    return rounded(profile.profile(table(spark, sf, "documents")), DIGITS)


@query("logical_types_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS \"column\", '{'numerical' if t in NUMERIC else 'categorical'}' AS kind, "
    f"count(*) AS rows FROM lineitem" for n, t in DIRTY))
def logical_types_lineitem(spark, sf):
    df = derived(spark, sf, "dirty_lineitem")
    kinds = typing.logical_types(df)
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(k).alias("kind")) for n, k in kinds.items()])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(rows), "rows")


@query("drop_identifier_columns",
       f"SELECT lang, source, {big('n_chars')} AS n_chars, md5(text) AS text_md5 FROM documents")
def drop_identifier_columns(spark, sf):
    return rounded(typing.drop_identifiers(table(spark, sf, "documents"))
                   .withColumn("text_md5", F.md5("text")).drop("text"))


def _allowed(name: str) -> str:
    return "false" if any(part in name.lower() for part in NO_TEXT_PARTS) else "true"


def text_test_sql(source: str, names: list[str]) -> str:
    def one(n):
        measures = (
            f"avg(CASE WHEN regexp_matches({n}, '^\\p{{Nd}}*\\.?\\p{{Nd}}*$') "
            f"AND regexp_matches({n}, '\\p{{Nd}}') THEN 1.0 WHEN {n} IS NOT NULL THEN 0.0 END) AS ds, "
            f"avg(length({n})) AS ml, avg(len({tokens_sql(n)})) AS mw, count(DISTINCT {n}) AS d, "
            f"count(DISTINCT {n}) / count(*) AS s"
        )
        return (
            f"SELECT '{n}' AS \"column\", {r('ds')} AS digit_share, {r('ml')} AS mean_length, "
            f"{r('mw')} AS mean_words, d AS \"distinct\", {r('s')} AS distinct_share, "
            f"({_allowed(n)} AND ds <= 0.8 AND ml > 15 AND mw > 3 AND s >= 0.05) AS is_text "
            f"FROM (SELECT {measures} FROM ({source}))"
        )
    return "\nUNION ALL\n".join(one(n) for n in names)


@query("long_text_documents", text_test_sql("SELECT * FROM documents", ["text", "lang", "source"]))
def long_text_documents(spark, sf):
    return rounded(typing.text_test(table(spark, sf, "documents")))


@query("long_text_customer", text_test_sql("SELECT * FROM customer", ["c_name", "c_mktsegment"]))
def long_text_customer(spark, sf):
    return rounded(typing.text_test(table(spark, sf, "customer")))


@query("datetime_columns_orders", """
SELECT min(o_orderdate)::VARCHAR AS first_date, max(o_orderdate)::VARCHAR AS last_date,
       count(DISTINCT o_orderdate) AS dates FROM orders""")
def datetime_columns_orders(spark, sf):
    orders = table(spark, sf, "orders")
    (found,) = typing.datetime_columns(orders)
    return orders.agg(
        F.min(found).cast("string").alias("first_date"), F.max(found).cast("string").alias("last_date"),
        F.count_distinct(found).alias("dates"),
    )


@query("short_categorical_columns", """
SELECT * FROM (
  SELECT 'o_orderpriority' AS "column", count(DISTINCT o_orderpriority) AS d FROM orders
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
) WHERE d < 20""")
def short_categorical_columns(spark, sf):
    orders = table(spark, sf, "orders")
    found = typing.short_categorical_columns(orders)
    rows = F.array(*[
        F.struct(F.lit(n).alias("column"), F.count_distinct(n).alias("d")) for n in found
    ])
    return orders.agg(rows.alias("rows")).select(F.inline("rows"))


@query("binary_columns_labels", """
SELECT 'doc_id' AS "column", bool_and(doc_id IN (0, 1)) AS is_binary FROM labels
UNION ALL SELECT 'quality', bool_and(quality IN (0, 1)) FROM labels
UNION ALL SELECT 'toxic', bool_and(toxic IN (0, 1)) FROM labels""")
def binary_columns_labels(spark, sf):
    labels = table(spark, sf, "labels")
    return profile.per_column(
        labels, labels.columns, lambda values, n: {"is_binary": typing.binary_test(values, n)}
    ).drop("position")


def samples_sql(columns: dict[str, str], key: str, source: str) -> str:
    """The values of the twenty smallest MD5 draws of each column."""
    return " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{n}' AS "column", row_number() OVER (ORDER BY md5('42|' || {key} || '|' || {text}), {text}) AS place,
 {text} AS value FROM {source} WHERE {n} IS NOT NULL) WHERE place <= 20""" for n, text in columns.items())


@query("column_samples_orders", samples_sql(
    {n: f"CAST({n} AS VARCHAR)" for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")},
    "CAST(o_orderkey AS VARCHAR)", f"({derived_sql('dirty_orders')})"))
def column_samples_orders(spark, sf):
    orders = derived(spark, sf, "dirty_orders")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return rounded(profile.column_samples(orders, names=names, key="o_orderkey"))


def overview_sql(source: str, columns) -> str:
    nulls = " + ".join(f"count(*) - count({n})" for n, _ in columns)
    k = len(columns)
    numbers = sum(t in NUMERIC for _, t in columns)
    strings = sum(t == "string" for _, t in columns)
    return f"""
WITH t AS ({source})
SELECT count(*) AS total_rows, {big(k)} AS total_columns, {big(nulls)} AS missing_values,
{r(f'100.0 * ({nulls}) / (count(*) * {k})')} AS missing_percentage,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows,
{big(numbers)} AS numeric_columns, {big(strings)} AS categorical_columns FROM t"""


@query("overview_lineitem", overview_sql(derived_sql("dirty_lineitem"), DIRTY))
def overview_lineitem(spark, sf):
    return rounded(profile.overview(derived(spark, sf, "dirty_lineitem")))


DOC_COPIES = [("text", "string"), ("lang", "string")]


@query("overview_document_copies", overview_sql("SELECT text, lang FROM documents", DOC_COPIES))
def overview_document_copies(spark, sf):
    return rounded(profile.overview(table(spark, sf, "documents").select("text", "lang")))


CHANGE = 1_729_980_000_000_000  # three hours before clocks in Berlin go back, in microseconds
MOMENTS = [("moment", "timestamp"), ("u", "bigint")]


@query("overview_daylight_saving", overview_sql(
    f"SELECT {CHANGE} + (event_id % 6) * 3600000000 AS moment, user_id % 50 AS u FROM events", MOMENTS))
def overview_daylight_saving(spark, sf):
    """Instants an hour apart, two of which read alike on a clock in Berlin."""
    berlin = spark.newSession()
    berlin.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    moment = F.timestamp_micros(F.lit(CHANGE) + (F.col("event_id") % 6) * F.lit(3_600_000_000))
    return rounded(profile.overview(
        table(berlin, sf, "events").select(moment.alias("moment"), (F.col("user_id") % 50).alias("u"))
    ))


def analysis_sql(source: str, columns) -> str:
    def one(i, n, t):
        number = t in NUMERIC
        def stat(e):
            return r(e, DIGITS) if number else "CAST(NULL AS DOUBLE)"
        return (
            f"SELECT {big(i)} AS position, '{n}' AS \"column\", '{t}' AS dtype, count({n}) AS non_null, "
            f"count(*) - count({n}) AS null_count, "
            f"{r(f'100.0 * (count(*) - count({n})) / count(*)', DIGITS)} AS null_percentage, "
            f"count(DISTINCT {n}) AS unique_count, "
            f"{r(f'100.0 * count(DISTINCT {n}) / count(*)', DIGITS)} AS unique_percentage, "
            f"{stat(f'avg({n})')} AS mean, {stat(f'quantile_cont({n}, 0.5)') if number else stat('')} AS median, "
            f"{stat(f'stddev_samp({n})')} AS std, {stat(f'min({n})')} AS min, {stat(f'max({n})')} AS max FROM t"
        )
    return f"WITH t AS ({source}) {union(columns, one)}"


@query("column_analysis_lineitem", analysis_sql(derived_sql("dirty_lineitem"), DIRTY))
def column_analysis_lineitem(spark, sf):
    return rounded(profile.column_analysis(derived(spark, sf, "dirty_lineitem")), DIGITS)


@query("column_analysis_customer", analysis_sql("SELECT * FROM customer", CUSTOMER))
def column_analysis_customer(spark, sf):
    return rounded(profile.column_analysis(table(spark, sf, "customer")), DIGITS)


def wide_columns() -> dict[str, str]:
    numbers = {k: f"CAST({v} AS DOUBLE)" for k, v in wide_numbers(60).items()}
    texts = {f"t{i:02d}": f"concat(l_returnflag, '-', (l_linenumber + {i}) % {i + 2})" for i in range(40)}
    return numbers | texts


def wide_analysis_sql() -> str:
    """One row of measures a column, over all rows at once."""
    cells = []
    for i, n in enumerate(wide_columns()):
        number = not n.startswith("t")
        measures = [f"avg({n})", f"quantile_cont({n}, 0.5)", f"stddev_samp({n})", f"min({n})", f"max({n})"]
        given = [f"CAST({m} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)" for m in measures]
        fields = ["'position': " + str(i), f"'column': '{n}'", f"'dtype': '{'double' if number else 'string'}'",
                  f"'non_null': count({n})", f"'null_count': count(*) - count({n})",
                  f"'unique_count': count(DISTINCT {n})", "'rows': count(*)"]
        fields += [f"'{k}': {m}" for k, m in zip(("mean", "median", "std", "min", "max"), given)]
        cells.append("{" + ", ".join(fields) + "}")
    return f"""
WITH t AS (SELECT {', '.join(f'{v} AS {k}' for k, v in wide_columns().items())} FROM lineitem),
p AS (SELECT unnest([{', '.join(cells)}]) AS p FROM t)
SELECT {big('p.position')} AS position, p."column" AS "column", p.dtype AS dtype, p.non_null AS non_null,
p.null_count AS null_count, {r('100.0 * p.null_count / p.rows', 7)} AS null_percentage, p.unique_count AS unique_count,
{r('100.0 * p.unique_count / p.rows', 7)} AS unique_percentage,
{', '.join(f'{r(f"p.{k}", 7)} AS {k}' for k in ("mean", "median", "std", "min", "max"))} FROM p"""


@query("column_analysis_wide", wide_analysis_sql())
def column_analysis_wide(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    return rounded(profile.column_analysis(lineitem.selectExpr(*[f"{v} AS {k}" for k, v in wide_columns().items()]))
                   .select("position", "column", "dtype", "non_null", "null_count", "null_percentage", "unique_count",
                           "unique_percentage", "mean", "median", "std", "min", "max"), 7)


def top_sql(source: str, names: list[str], k: int, missing: str | None = None) -> str:
    def one(n):
        where = "" if missing else f"WHERE {n} IS NOT NULL"
        value = f"coalesce({n}, '{missing}')" if missing else n
        return (
            f"SELECT * FROM (SELECT '{n}' AS \"column\", "
            f"row_number() OVER (ORDER BY count(*) DESC, {key_sql(n)} NULLS LAST) AS rank, "
            f"{value} AS value, count(*) AS n FROM ({source}) {where} GROUP BY {n}) WHERE rank <= {k}"
        )
    return "\nUNION ALL\n".join(one(n) for n in names)


@query("top_values_part", top_sql("SELECT * FROM part", ["p_name", "p_brand", "p_type"], 5))
def top_values_part(spark, sf):
    return rounded(profile.top_values(table(spark, sf, "part")))


@query("analysis_from_stored_profile", f"""
SELECT position, "column", dtype, non_null, nulls AS null_count, CAST(NULL AS DOUBLE) AS null_percentage,
coalesce(unique_count, 0) AS unique_count, CASE WHEN min IS NOT NULL THEN mean END AS mean,
CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS std, min, max,
CASE WHEN min IS NULL THEN array_to_string(string_split(sample_unique, '|')[1:5], '|') END AS top_values
FROM ({profile_sql(derived_sql("dirty_lineitem"), DIRTY)})""")
def analysis_from_stored_profile(spark, sf):
    stored = profile.profile(derived(spark, sf, "dirty_lineitem"))
    return rounded(profile.analysis_from_profile(stored), DIGITS)


@query("table_metadata", "\nUNION ALL\n".join(
    f"SELECT count(*) AS rows, {big(5)} AS columns, {big(i)} AS position, '{n}' AS \"column\", "
    f"'{t}' AS dtype FROM customer" for i, (n, t) in enumerate(CUSTOMER)))
def table_metadata(spark, sf):
    return rounded(profile.metadata(table(spark, sf, "customer")))


def quality_sql(source: str, columns) -> str:
    constants = ", ".join(
        f"CASE WHEN count(DISTINCT {n}) <= 1 THEN '{n}' END" for n, _ in columns
    )
    return f"""
WITH o AS ({overview_sql(source, columns)}),
c AS (SELECT list_filter([{constants}], lambda x: x IS NOT NULL) AS cols FROM ({source})),
f AS (SELECT missing_percentage AS m, 100.0 * duplicate_rows / total_rows AS d, cols FROM o, c),
s AS (SELECT *, 100 - CASE WHEN m > 10 THEN 20 WHEN m > 5 THEN 10 ELSE 0 END
 - CASE WHEN d > 5 THEN 15 WHEN d > 1 THEN 5 ELSE 0 END - CASE WHEN len(cols) > 0 THEN 10 ELSE 0 END AS q FROM f)
SELECT {big('greatest(q, 0)')} AS quality_score,
CASE WHEN q >= 90 THEN 'Excellent' WHEN q >= 70 THEN 'Good' WHEN q >= 50 THEN 'Fair' ELSE 'Poor' END AS assessment,
array_to_string(list_filter([
 CASE WHEN m > 10 THEN 'High missing values: ' || {fixed('m', 1)} || '%'
      WHEN m > 5 THEN 'Moderate missing values: ' || {fixed('m', 1)} || '%' END,
 CASE WHEN d > 5 THEN 'High duplicate rate: ' || {fixed('d', 1)} || '%'
      WHEN d > 1 THEN 'Moderate duplicate rate: ' || {fixed('d', 1)} || '%' END,
 CASE WHEN len(cols) > 0 THEN 'Constant columns found: [' ||
   array_to_string(list_transform(cols, lambda x: '''' || x || ''''), ', ') || ']' END
], lambda x: x IS NOT NULL), '|') AS issues FROM s"""


@query("quality_lineitem", quality_sql(derived_sql("dirty_lineitem"), DIRTY))
def quality_lineitem(spark, sf):
    return rounded(quality.quality(derived(spark, sf, "dirty_lineitem")))


@query("quality_constant_orders", quality_sql(derived_sql("constant_orders"), [
    ("o_orderkey", "bigint"), ("k", "int"), ("e", "double"), ("o_totalprice", "double")]))
def quality_constant_orders(spark, sf):
    return rounded(quality.quality(derived(spark, sf, "constant_orders")))


@query("quality_document_copies", quality_sql("SELECT text, lang FROM documents", DOC_COPIES))
def quality_document_copies(spark, sf):
    return rounded(quality.quality(table(spark, sf, "documents").select("text", "lang")))


def recommendations_sql(source: str, numbers: list[str], strings: list[str]) -> str:
    parts = [
        f"SELECT 'high_cardinality' AS rule, '{n}' AS \"column\", count(DISTINCT {n}) / count(*) AS measure "
        f"FROM t HAVING count(DISTINCT {n}) > count(*) * 0.5" for n in strings
    ] + [
        f"SELECT 'skewed', '{n}', skewness({n}) FROM t HAVING abs(skewness({n})) > 2" for n in numbers
    ] + [
        f"SELECT 'outliers', '{n}', count(*) FILTER (WHERE {n} < a - 1.5 * (b - a) OR {n} > b + 1.5 * (b - a)) AS k "
        f"FROM t, (SELECT quantile_cont({n}, 0.25) AS a, quantile_cont({n}, 0.75) AS b FROM t) "
        f"HAVING k > count(*) * 0.05" for n in numbers
    ]
    return f"""
WITH t AS ({source}), f AS ({' UNION ALL '.join(parts)})
SELECT rule, "column", {r('measure')} AS measure FROM f
UNION ALL SELECT 'good_condition', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM f)"""


@query("recommendations_events", recommendations_sql(
    derived_sql("skewed_events"), ["event_id", "user_id", "value", "squared", "shifted"], ["event_type"]))
def recommendations_events(spark, sf):
    return rounded(quality.recommendations(derived(spark, sf, "skewed_events")))


@query("recommendations_documents", recommendations_sql(
    "SELECT * FROM documents", ["doc_id", "n_chars"], ["text", "lang", "source"]))
def recommendations_documents(spark, sf):
    return rounded(quality.recommendations(table(spark, sf, "documents")))


@query("recommendations_orders", recommendations_sql(
    derived_sql("dirty_orders"), ["o_orderkey", "o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]))
def recommendations_orders(spark, sf):
    return rounded(quality.recommendations(derived(spark, sf, "dirty_orders")))


@query("recommendation_texts", f"""
WITH f AS ({recommendations_sql("SELECT *, 'u' || doc_id AS name FROM documents", ["doc_id", "n_chars"], ["text", "lang", "source", "name"])}),
high AS (SELECT 'high_cardinality' AS rule, CAST(NULL AS VARCHAR) AS "column",
 'Consider feature engineering for high-cardinality columns: [' || string_agg('''' || "column" || '''', ', ' ORDER BY "column") || ']' AS text
 FROM f WHERE rule = 'high_cardinality' HAVING count(*) > 0)
SELECT * FROM high UNION ALL
SELECT rule, "column", CASE rule
 WHEN 'skewed' THEN 'Column ''' || "column" || ''' is highly skewed (skewness: ' || printf('%.2f', measure) || '). Consider transformation.'
 WHEN 'outliers' THEN 'Column ''' || "column" || ''' has potential outliers (' || CAST(measure AS BIGINT) || ' rows). Consider investigation.'
 ELSE 'Dataset appears to be in good condition for analysis.' END FROM f WHERE rule <> 'high_cardinality'""")
def recommendation_texts(spark, sf):
    documents = table(spark, sf, "documents").withColumn("name", F.concat(F.lit("u"), F.col("doc_id")))
    return quality.recommendation_text(quality.recommendations(documents))


MEASURES = [
    ("count", "count({c})"), ("missing", "count(*) - count({c})"),
    ("missing_pct", "100.0 * (count(*) - count({c})) / count(*)"), ("mean", "avg({c})"),
    ("median", "quantile_cont({c}, 0.5)"), ("std", "stddev_samp({c})"), ("min", "min({c})"),
    ("max", "max({c})"), ("range", "max({c}) - min({c})"), ("skewness", "skewness({c})"),
    ("kurtosis", "kurtosis({c})"),
]


def compare_sql(before: str, after: str, names: list[str]) -> str:
    def side(source, n, label):
        return "SELECT " + ", ".join(f"{e.format(c=n)} AS {label}_{m}" for m, e in MEASURES) + f" FROM {source}"
    integers = ("count", "missing")
    columns = [
        f"{big(f'{s}_{m}') if m in integers else r(f'{s}_{m}', 5)} AS {s}_{m}"
        for s in ("before", "after") for m, _ in MEASURES
    ] + [
        f"{big(f'after_{m} - before_{m}') if m in integers else r(f'after_{m} - before_{m}', 5)} AS change_{m}"
        for m, _ in MEASURES if m not in ("missing", "missing_pct")
    ]
    parts = [
        f"SELECT '{n}' AS \"column\", {', '.join(columns)}, {big('before_missing - after_missing')} AS missing_reduced, "
        f"coalesce(abs(before_skewness), 0) - coalesce(abs(after_skewness), 0) > 0.01 AS skewness_improved, "
        f"before_std > 0 AND after_std > 0 AND before_std - after_std > 0.01 AS outliers_handled "
        f"FROM ({side('b', n, 'before')}), ({side('a', n, 'after')})" for n in names
    ]
    return f"WITH b AS ({before}), a AS ({after}) " + " UNION ALL ".join(parts)


_IMPUTED = f"""
SELECT l_orderkey, l_linenumber, coalesce(l_quantity, avg(l_quantity) OVER ()) AS l_quantity,
coalesce(l_extendedprice, avg(l_extendedprice) OVER ()) AS l_extendedprice, l_discount
FROM ({derived_sql("dirty_lineitem")})"""


@query("compare_before_after_imputation", compare_sql(
    derived_sql("dirty_lineitem"), _IMPUTED,
    ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]))
def compare_before_after_imputation(spark, sf):
    before = derived(spark, sf, "dirty_lineitem")
    after = impute.impute(before, ["l_quantity", "l_extendedprice"], "mean")
    return rounded(quality.compare(before, after), 5)


@query("compare_before_after_skew", compare_sql(
    derived_sql("skewed_events"),
    reduced_sql(derived_sql("skewed_events"), ["value", "squared", "shifted"]),
    ["value", "squared", "shifted"]))
def compare_before_after_skew(spark, sf):
    before = derived(spark, sf, "skewed_events").select("value", "squared", "shifted")
    return rounded(quality.compare(before, numeric.handle_skewness(before)), 5)




@query("top_values_documents", top_sql("SELECT * FROM documents", ["text", "lang", "source"], 5))
def top_values_documents(spark, sf):
    return rounded(profile.top_values(table(spark, sf, "documents")))
