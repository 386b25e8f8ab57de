"""Cleaning plans and whole runs: L1 to L9, P10, P11."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.operators import profile, quality
from washline.plans import run, suggest
from washline.sources import tables as io

from .common import big, derived, derived_sql, fixed, query, r, rounded, scratch, table
from .encoding import PRIORITIES, STATUSES, label_sql, one_hot_sql
from .expected import (
    BASIC_STOP_WORDS, ENCODING_ALIASES, ENGLISH_STOP_WORDS, LAST, STEP_ORDER, TEXT_OPERATIONS,
)
from .numeric import stats
from .profiles import CUSTOMER, DIRTY, NUMERIC, text_test_sql
from .text import special, stripped, without_words

ORDERS = [
    ("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string"),
    ("o_totalprice", "double"), ("o_custkey", "bigint"),
]
DOCUMENTS = [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
]


def facts_sql(source: str, columns) -> str:
    def one(i, n, t):
        number = t in NUMERIC
        values = ", ".join(
            f"CAST({f}({n}) AS DOUBLE) AS {a}" if number else f"CAST(NULL AS DOUBLE) AS {a}"
            for f, a in (("min", "lo"), ("max", "hi"), ("avg", "mean")))
        return (f"SELECT {i} AS position, '{n}' AS c, {str(t == 'string').lower()} AS is_text, count({n}) AS non_null, "
                f"count(*) - count({n}) AS nulls, {values}, "
                f"{'CAST(NULL AS BIGINT)' if number else f'count(DISTINCT {n})'} AS u FROM t")
    return f"WITH t AS ({source}) " + " UNION ALL ".join(one(i, n, t) for i, (n, t) in enumerate(columns))


def plan_sql(source: str, columns, rules: list[tuple[str, str, str]], nothing: str) -> str:
    parts = [
        f"SELECT position, c, {k} AS k, '{operation}' AS operation, {reason} AS reason FROM f WHERE {hit}"
        for k, (hit, operation, reason) in enumerate(rules)
    ]
    return f"""
WITH f AS ({facts_sql(source, columns)}), found AS ({' UNION ALL '.join(parts)}),
everything AS (SELECT * FROM found UNION ALL SELECT position, c, 0, 'skip', '{nothing}' FROM f
 WHERE c NOT IN (SELECT c FROM found))
SELECT {big('position')} AS position, c AS "column",
{big('row_number() OVER (PARTITION BY c ORDER BY k) - 1')} AS step, operation, reason FROM everything"""


_SHARE = fixed("100.0 * nulls / (nulls + non_null)", 1)
_SPREAD, _LOW, _HIGH = fixed("(hi - lo) / mean * 100", 1), fixed("lo", 2), fixed("hi", 2)
_RANGE = fixed("hi - lo", 2)
FULL_RULES = [
    ("nulls > 0", "fill_missing", f"nulls || ' missing values (' || {_SHARE} || '% of data)'"),
    ("mean > 0 AND (hi - lo) / mean * 100 > 200", "remove_outliers",
     f"'High coefficient of variation (' || {_SPREAD} || '%) suggests outliers in range [' || {_LOW} || ', ' || {_HIGH} || ']'"),
    ("hi - lo > 1000", "normalize_range",
     f"'Wide numeric range (' || {_RANGE} || ') requires scaling for ML algorithms'"),
    ("hi - lo > 100 AND hi - lo <= 1000", "standardize",
     f"'Moderate range (' || {_RANGE} || ') - standardization recommended for better ML performance'"),
    ("is_text AND u > 10", "text_clean",
     "printf('Text column with %d unique values needs cleaning and normalization', u)"),
    ("is_text AND u <= 10", "categorical_encode",
     "printf('Low cardinality categorical column (%d categories) - encoding recommended', u)"),
]
BASIC_RULES = [
    ("nulls > 0", "fill_missing", "printf('%d missing values', nulls)"),
    ("hi - lo > 1000", "normalize_range", "'Wide numeric range'"),
    ("is_text AND u > 10", "text_clean", "'High cardinality text'"),
]
CLEAN, NOTHING = "Column appears clean and ready for analysis", "No preprocessing required"


def full_plan(df: DataFrame) -> DataFrame:
    return suggest.suggest(profile.profile(df, preview=None))


def shown(plan: DataFrame) -> DataFrame:
    """Parameters as sorted key=value text."""
    entries = F.transform(
        F.sort_array(F.map_entries(F.coalesce("parameters", F.create_map().cast("map<string,string>")))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rounded(plan.withColumn("parameters", F.array_join(entries, ";")))


def full_sql(source: str, columns) -> str:
    return plan_sql(source, columns, FULL_RULES, CLEAN)


@query("suggest_plan_lineitem", full_sql(derived_sql("dirty_lineitem"), DIRTY))
def suggest_plan_lineitem(spark, sf):
    return rounded(full_plan(derived(spark, sf, "dirty_lineitem")).drop("parameters"))


@query("suggest_plan_customer", full_sql("SELECT * FROM customer", CUSTOMER))
def suggest_plan_customer(spark, sf):
    return rounded(full_plan(table(spark, sf, "customer")).drop("parameters"))


@query("suggest_plan_basic_lineitem", plan_sql(derived_sql("dirty_lineitem"), DIRTY, BASIC_RULES, NOTHING))
def suggest_plan_basic_lineitem(spark, sf):
    profiled = profile.profile(derived(spark, sf, "dirty_lineitem"), preview=None)
    return rounded(suggest.suggest_basic(profiled).drop("parameters"))


# text steps are put on every string column, so that the check has something to refuse
def text_plan(spark, sf) -> DataFrame:
    documents = table(spark, sf, "documents")
    steps = [
        {"column": c, "operation": o, "reason": "asked"}
        for c in ("text", "lang", "source") for o in TEXT_OPERATIONS
    ]
    return suggest.check_plan(suggest.make_plan(spark, steps), documents)


_STEPS = ", ".join(
    f"({p}, '{c}', {s}, '{o}')" for p, c in enumerate(("text", "lang", "source"))
    for s, o in enumerate(TEXT_OPERATIONS))


@query("check_plan_documents", f"""
WITH steps(position, c, step, operation) AS (VALUES {_STEPS}),
short AS (SELECT "column" AS c FROM ({text_test_sql('SELECT * FROM documents', ['text', 'lang', 'source'])})
          WHERE "distinct" < 20 AND NOT is_text)
SELECT {big('position')} AS position, c AS "column", {big('step')} AS step,
CASE WHEN c IN (FROM short) THEN 'skip' ELSE operation END AS operation,
CASE WHEN c IN (FROM short) THEN 'Short categorical column (was: ' || operation || ')' ELSE 'asked' END AS reason
FROM steps""")
def check_plan_documents(spark, sf):
    return rounded(text_plan(spark, sf).drop("parameters"))


_DEFAULTS = """CASE operation WHEN 'remove_outliers' THEN 'method=remove_outliers;outlier_strategy=median'
 WHEN 'standardize' THEN 'method=standard' WHEN 'normalize_range' THEN 'method=minmax'
 WHEN 'categorical_encode' THEN 'keep_original=False;method=categorical_encode;strategy=onehot' ELSE '' END"""


@query("resolve_plan_lineitem", f"""
SELECT position, "column", step, operation, reason, {_DEFAULTS} AS parameters
FROM ({full_sql(derived_sql("dirty_lineitem"), DIRTY)})""")
def resolve_plan_lineitem(spark, sf):
    return shown(suggest.resolve_plan(full_plan(derived(spark, sf, "dirty_lineitem"))))


_ALIAS = ", ".join(f"('{a}', '{s}')" for a, s in ENCODING_ALIASES.items())


@query("resolve_plan_aliases", f"""
WITH p AS ({full_sql("SELECT * FROM customer", CUSTOMER)}), a(operation, strategy) AS (VALUES {_ALIAS})
SELECT position, "column", step, 'categorical_encode' AS operation, a.operation || ': ' || reason AS reason,
'keep_original=False;method=categorical_encode;strategy=' || strategy AS parameters FROM p, a""")
def resolve_plan_aliases(spark, sf):
    plan = full_plan(table(spark, sf, "customer"))
    alias = F.explode(F.array(*[F.lit(a) for a in ENCODING_ALIASES]))
    named = plan.withColumn("alias", alias).select(
        "position", "column", "step", F.col("alias").alias("operation"),
        F.concat("alias", F.lit(": "), "reason").alias("reason"), "parameters")
    return shown(suggest.resolve_plan(named))


_RANKS = ", ".join(f"('{o}', {k})" for o, k in STEP_ORDER.items())


@query("order_plan_lineitem", f"""
WITH p AS ({full_sql(derived_sql("dirty_lineitem"), DIRTY)}), k(operation, rank) AS (VALUES {_RANKS})
SELECT position, "column", step, p.operation, reason, {big(f'coalesce(rank, {LAST})')} AS rank
FROM p LEFT JOIN k USING (operation)""")
def order_plan_lineitem(spark, sf):
    return rounded(suggest.order_plan(full_plan(derived(spark, sf, "dirty_lineitem"))).drop("parameters"))


# One fixed plan over the dirty orders, every step checked in SQL.
FIXED_STEPS = [
    {"column": "o_totalprice", "operation": "standardize", "reason": "scale"},
    {"column": "o_totalprice", "operation": "fill_missing", "reason": "gaps", "parameters": {"strategy": "mean"}},
    {"column": "o_orderstatus", "operation": "onehot", "reason": "few values"},
    {"column": "o_orderstatus", "operation": "standardize", "reason": "guarded"},
    {"column": "o_orderpriority", "operation": "fill_missing"},
    {"column": "o_orderpriority", "operation": "label", "reason": "codes"},
    {"column": "o_orderpriority", "operation": "normalize_range", "reason": "guarded"},
    {"column": "o_orderpriority", "operation": "polish", "reason": "unknown"},
    {"column": "o_custkey", "operation": "skip", "reason": "identifier"},
]
_FIXED = f"""
WITH d AS ({derived_sql('dirty_orders')}),
m AS (SELECT avg(o_totalprice) AS mean, (SELECT o_orderpriority FROM d WHERE o_orderpriority IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS common FROM d),
t AS (SELECT o_orderkey, o_orderstatus, coalesce(o_orderpriority, common) AS o_orderpriority,
      coalesce(o_totalprice, mean) AS o_totalprice, o_custkey FROM d, m)"""


def ran_orders(spark, sf) -> run.Ran:
    return run.run_plan(derived(spark, sf, "dirty_orders"), suggest.make_plan(spark, FIXED_STEPS))


@query("run_plan_orders", f"""{_FIXED}
SELECT {big('o_orderkey')} AS o_orderkey, {one_hot_sql('o_orderstatus', STATUSES)},
{big(label_sql('o_orderpriority'))} AS o_orderpriority,
{r('(o_totalprice - avg_o_totalprice) / std_o_totalprice')} AS o_totalprice, {big('o_custkey')} AS o_custkey
FROM t, {stats(['o_totalprice'], 'avg', 'std')}""")
def run_plan_orders(spark, sf):
    return rounded(ran_orders(spark, sf).df)


@query("run_plan_log_orders", """
SELECT column0 AS "column", column1 AS operation, column2 AS reason, column3 AS status, column4 AS detail, rows FROM (VALUES
 ('o_totalprice', 'fill_missing', 'gaps', 'applied', ''), ('o_totalprice', 'standardize', 'scale', 'applied', ''),
 ('o_orderstatus', 'categorical_encode', 'few values', 'applied', ''),
 ('o_orderstatus', 'standardize', 'guarded', 'skipped', 'no such column'),
 ('o_orderpriority', 'fill_missing', '', 'applied', ''), ('o_orderpriority', 'categorical_encode', 'codes', 'applied', ''),
 ('o_orderpriority', 'normalize_range', 'guarded', 'skipped', 'encoded column'),
 ('o_orderpriority', 'polish', 'unknown', 'skipped', 'unknown operation'),
 ('o_custkey', 'skip', 'identifier', 'skipped', 'skip')) l(column0, column1, column2, column3, column4),
 (SELECT count(*) AS rows FROM orders)""")
def run_plan_log_orders(spark, sf):
    ran = ran_orders(spark, sf)
    return ran.log.drop("seq").withColumn("rows", F.lit(ran.df.count()))


@query("guard_binary_labels", f"""
WITH t AS (SELECT * FROM labels)
SELECT {big('doc_id')} AS doc_id, {big('quality')} AS quality, {big('toxic')} AS toxic FROM t""")
def guard_binary_labels(spark, sf):
    """De-skewing is refused on 0/1 columns, and an even key needs none."""
    labels = table(spark, sf, "labels")
    plan = suggest.make_plan(spark, [{"column": c, "operation": "handle_skewness"} for c in labels.columns])
    return rounded(run.run_plan(labels, plan).df)


@query("guard_run_together_texts", f"""
WITH s AS (SELECT max(length({stripped(without_words(special("lower(text)"), BASIC_STOP_WORDS))})) > 1000 AS too_long FROM documents)
SELECT {big('doc_id')} AS doc_id, CASE WHEN too_long THEN text
 ELSE {stripped(without_words(special("lower(text)"), BASIC_STOP_WORDS))} END AS text FROM documents, s""")
def guard_run_together_texts(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    plan = suggest.make_plan(spark, [{"column": "text", "operation": "text_clean"}])
    return rounded(run.run_plan(documents, plan, length_guard=True).df)


@query("clean_documents_end_to_end", f"""
WITH d AS (SELECT doc_id, {stripped(without_words(special("lower(text)"), BASIC_STOP_WORDS))} AS x, lang FROM documents),
e AS (SELECT doc_id, {without_words('x', ENGLISH_STOP_WORDS)} AS text, lang FROM d)
SELECT {big('min(doc_id)')} AS doc_id, text, {', '.join(f"CAST(lang = '{v}' AS BIGINT) AS lang_{v}" for v in ('de', 'en', 'es', 'fr'))}
FROM e GROUP BY text, lang""")
def clean_documents_end_to_end(spark, sf):
    """Text steps, duplicates among the cleaned texts and an encoding, with the checkpoint and sketches."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang")
    plan = suggest.make_plan(spark, [
        {"column": "text", "operation": "text_clean"}, {"column": "text", "operation": "remove_stopwords"},
        {"column": "lang", "operation": "categorical_encode"},
    ])
    texts = run.clean_table(documents, plan.where("column = 'text'"), checkpoint=True, approx=True).df
    once = suggest.make_plan(spark, [{
        "column": "text", "operation": "deduplicate", "parameters": {"subset": "text,lang", "order_by": "doc_id"}}])
    cleaned = run.run_plan(texts, once, checkpoint=True).df
    return rounded(run.run_plan(cleaned, plan.where("column = 'lang'"), checkpoint=True).df)


_CLEANED = f"""
WITH d AS ({derived_sql('dirty_lineitem')}),
deduplicated AS (SELECT DISTINCT * FROM d),
f AS (SELECT median(l_quantity) AS qm, avg(l_quantity) AS qa, avg(l_extendedprice) AS pa FROM deduplicated),
t AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, qa) AS l_quantity, coalesce(l_extendedprice, pa) AS l_extendedprice,
      l_discount, l_returnflag, l_linestatus FROM deduplicated, f)"""


@query("run_plan_with_deduplication", f"""{_CLEANED}
SELECT {big('l_orderkey')} AS l_orderkey, {big('l_linenumber')} AS l_linenumber, {r('l_quantity')} AS l_quantity,
{r('(l_extendedprice - min_l_extendedprice) / (max_l_extendedprice - min_l_extendedprice)')} AS l_extendedprice,
{r('l_discount')} AS l_discount, l_returnflag, l_linestatus
FROM t, {stats(['l_extendedprice'], 'min', 'max')}""")
def run_plan_with_deduplication(spark, sf):
    plan = suggest.make_plan(spark, [
        {"column": "l_orderkey", "operation": "deduplicate"},
        {"column": "l_quantity", "operation": "fill_missing", "parameters": {"strategy": "mean"}},
        {"column": "l_extendedprice", "operation": "fill_missing", "parameters": {"strategy": "mean"}},
        {"column": "l_extendedprice", "operation": "normalize_range"},
    ])
    return rounded(run.run_plan(derived(spark, sf, "dirty_lineitem"), plan, checkpoint=True).df)


def _clean_whole(spark, sf) -> run.CleanResult:
    """From a written file, through a suggested plan, to a cleaned table."""
    path = scratch(spark) + "/orders.parquet"
    io.write_table(derived(spark, sf, "dirty_orders"), path)
    return run.clean(spark, path)


# what the rules suggest for the dirty orders: fill gaps, encode both categories, set outliers to
# the median where the range is wide for the mean, then scale by the width of the original range
def _tamed(n: str) -> str:
    return (f"CASE WHEN avg_{n} > 0 AND (max_{n} - min_{n}) / avg_{n} * 100 > 200 AND "
            f"({n} < q1_{n} - 1.5 * (q3_{n} - q1_{n}) OR {n} > q3_{n} + 1.5 * (q3_{n} - q1_{n})) THEN q2_{n} ELSE {n} END")


def _rescaled(n: str) -> str:
    return (f"CASE WHEN width_{n} > 1000 THEN ({n} - min_{n}) / (max_{n} - min_{n}) "
            f"WHEN width_{n} > 100 THEN ({n} - avg_{n}) / std_{n} ELSE {n} END")


def _hot(name: str, values) -> str:
    return ", ".join(f"CAST({name} = '{v}' AS BIGINT) AS \"{name}_{v}\"" for v in values)


_WIDE = ["o_orderkey", "o_totalprice", "o_custkey"]


@query("clean_orders_end_to_end", f"""
WITH t AS ({derived_sql('dirty_orders')}),
tame AS (SELECT o_orderstatus, o_orderpriority, {', '.join(f'{_tamed(n)} AS {n}, max_{n} - min_{n} AS width_{n}' for n in _WIDE)}
         FROM t, {stats(_WIDE, 'min', 'max', 'avg', 'q1', 'q2', 'q3')}),
z AS (SELECT greatest(max(o_totalprice) - avg(o_totalprice), avg(o_totalprice) - min(o_totalprice)) / stddev_samp(o_totalprice) AS far,
      avg(o_totalprice) AS a, quantile_cont(o_totalprice, 0.5) AS m FROM tame),
modes AS (SELECT (SELECT o_orderstatus FROM t WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS ms,
 (SELECT o_orderpriority FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mp),
whole AS (SELECT * REPLACE (coalesce(o_orderstatus, ms) AS o_orderstatus, coalesce(o_orderpriority, mp) AS o_orderpriority,
 coalesce(o_totalprice, CASE WHEN far > 3 THEN m ELSE a END) AS o_totalprice) FROM tame, z, modes)
SELECT {', '.join(f'{r(_rescaled(n))} AS {n}' for n in _WIDE)},
{_hot('o_orderstatus', STATUSES)}, {_hot('o_orderpriority', PRIORITIES)}
FROM whole, {stats(_WIDE, 'min', 'max', 'avg', 'std').replace('FROM t)', 'FROM whole)')}""")
def clean_orders_end_to_end(spark, sf):
    return rounded(_clean_whole(spark, sf).df)


@query("operation_summary_orders", """
SELECT column0 AS "column", column1 AS operation, column2 AS reason, column3 AS status, rows FROM (VALUES
 ('o_totalprice', 'fill_missing', 'gaps', 'applied'), ('o_totalprice', 'standardize', 'scale', 'applied'),
 ('o_orderstatus', 'categorical_encode', 'few values', 'applied'), ('o_orderstatus', 'standardize', 'guarded', 'skipped'),
 ('o_orderpriority', 'fill_missing', 'back-filled', 'applied'), ('o_orderpriority', 'categorical_encode', 'codes', 'applied'),
 ('o_orderpriority', 'normalize_range', 'guarded', 'skipped'), ('o_orderpriority', 'polish', 'unknown', 'skipped'),
 ('o_custkey', 'skip', 'identifier', 'skipped')) l(column0, column1, column2, column3),
 (SELECT count(*) AS rows FROM orders)""")
def operation_summary_orders(spark, sf):
    ran = ran_orders(spark, sf)
    reasoned = [{"reason": "back-filled", **s} for s in FIXED_STEPS]
    summary = run.operation_summary(suggest.make_plan(spark, reasoned), ran.log)
    return summary.withColumn("rows", F.lit(ran.df.count()))


@query("summary_totals_orders", f"""
WITH p AS ({full_sql(derived_sql('dirty_orders'), ORDERS)})
SELECT count(DISTINCT "column") AS total_suggestions, count(*) FILTER (WHERE operation <> 'skip') AS applied,
count(*) FILTER (WHERE operation = 'skip') AS skipped, CAST(0 AS BIGINT) AS failed, CAST(1 AS BIGINT) AS total_snapshots,
'initial' AS snapshot_steps FROM p""")
def summary_totals_orders(spark, sf):
    orders = derived(spark, sf, "dirty_orders")
    _, shape = io.snapshot(orders, scratch(spark), "initial")
    plan = full_plan(orders)
    ran = run.run_plan(orders, plan)
    return rounded(run.summary_totals(plan, ran.log, [shape]))


@query("comparable_columns_orders", """
SELECT 'o_custkey' AS "column", count(o_custkey) AS n FROM orders
UNION ALL SELECT 'o_orderkey', count(o_orderkey) FROM orders
UNION ALL SELECT 'o_totalprice', count(o_totalprice) FROM orders""")
def comparable_columns_orders(spark, sf):
    ran = ran_orders(spark, sf)
    names = quality.comparable_columns(derived(spark, sf, "dirty_orders"), ran.df)
    return profile.per_column(ran.df, names, lambda _, n: {"n": F.count(n)}).drop("position")
