"""Categorical encoding: one-hot columns, one-hot vectors and integer labels."""

from __future__ import annotations

from typing import Any

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    ROLE, col, distinct_key, field, present, scalar_columns, string_columns, targets,
)
from .checkpoints import stored
from .counts import count_of, slots, value_counts
from .fit import scalars
from .frequent import few_distinct
from .ranges import number_distinct

MAX_ONE_HOT = 1000
MAX_DRIVER_LABELS = 10_000  # beyond it the fitted codes are a written table and not a list
MAX_DRIVER_BYTES = 4 << 20
AUTO_ONE_HOT = 10
METHODS = ("onehot", "label", "auto")


class TooManyCategories(ValueError):
    """A column has more categories than the encoding may create."""


def categories(df: DataFrame, names: list[str]) -> dict[str, list[tuple[Any, int]]]:
    """Sorted ``(value, count)`` pairs of columns known to have few values, missing last."""
    found: dict[str, list[tuple[Any, int]]] = {n: [] for n in names}
    if names:
        place = slots(df, names)[1]
        for r in value_counts(df, names, with_missing=True).collect():  # what fit_encode admits
            found[r["column"]].append((r[f"v{place[r['column']]}"], r["n"]))
    return {
        n: sorted(found[n], key=lambda p: (p[0] is None, "" if p[0] is None else p[0])) for n in names
    }


def _listed(df: DataFrame, kinds: dict[str, str], distinct: dict[str, int | None], most: int) -> list[str]:
    """The columns whose values are fetched: one-hot ones of up to ``most`` values, and labels whose values
    are a short list, in bytes as well as in number."""
    texts = [n for n in kinds if n in string_columns(df)]
    longest = scalars(df, {n: F.max(F.octet_length(col(n))) for n in texts}) if texts else {}
    out = []
    for n, kind in kinds.items():
        if distinct[n] is None:
            continue
        size = distinct[n] * (longest.get(n) or 16)
        short = distinct[n] <= MAX_DRIVER_LABELS and size <= MAX_DRIVER_BYTES
        if distinct[n] <= most if kind == "onehot" else short:
            out.append(n)
    return out


def encode(
    df: DataFrame,
    column=None,
    method: str = "onehot",
    keep_original: bool = True,
    order: str = "sorted",
    max_categories: int = MAX_ONE_HOT,
) -> DataFrame:
    """Encode string columns, or any named columns; the new columns carry their role."""
    return apply_encode(df, fit_encode(df, column, method, keep_original, order, max_categories))


def fit_encode(
    df: DataFrame,
    column=None,
    method: str = "onehot",
    keep_original: bool = True,
    order: str = "sorted",
    max_categories: int = MAX_ONE_HOT,
) -> dict[str, dict[str, Any]]:
    """``auto`` takes one-hot up to ten distinct values, else labels.

    Labels are fitted codes from 0; missing values and values that the fit has not seen get the next
    code after the last. Up to 10,000 values of 4 MB in all are a list in the parameters, more are a
    written table ``(key, code)`` in the shared folder; both give the same codes.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    if order not in ("sorted", "frequency"):
        raise ValueError("order must be 'sorted' or 'frequency'")
    eligible = string_columns(df) if column is None else scalar_columns(df)
    names = targets(df, column, eligible)
    distinct = few_distinct(df, names, max(MAX_DRIVER_LABELS, max_categories))  # None for more
    few = {n for n in names if distinct[n] is not None and distinct[n] <= AUTO_ONE_HOT}
    kinds = {n: method if method != "auto" else "onehot" if n in few else "label" for n in names}
    found = categories(df, _listed(df, kinds, distinct, max_categories))
    params: dict[str, dict[str, Any]] = {}
    for n, kind in kinds.items():
        pairs = found.get(n)
        if kind == "onehot" and (pairs is None or method == "onehot" and len(pairs) > max_categories):
            raise TooManyCategories(f"{n!r} has more than {max_categories} categories")
        if pairs is not None and kind == "label" and order == "frequency":
            pairs = sorted(pairs, key=lambda p: (p[0] is None, -p[1], p[0] if p[0] is not None else ""))
        params[n] = {
            "method": kind, "keep_original": keep_original, "order": order,
            "categories": None if pairs is None else [v for v, _ in pairs],
        }
        if kind == "label" and pairs is None:
            params[n]["codes"] = _code_table(df, n, order)
    _name_columns(df, params)
    return params


def _name_columns(df: DataFrame, params: dict[str, dict[str, Any]]) -> None:
    """Names for one-hot columns. One that is taken, in capitals or not, by a column that stays or by an
    earlier category gets a number."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    fold = (lambda name: name) if exact else str.lower
    gone = {n for n, p in params.items() if p["method"] == "onehot" and not p["keep_original"]}
    taken = {fold(c) for c in df.columns if c not in gone}
    for n, p in params.items():
        if p["method"] != "onehot":
            continue
        p["names"] = []
        for v in p["categories"]:
            plain = name = f"{n}_nan" if v is None else f"{n}_{v}"
            number = 1
            while fold(name) in taken:
                number += 1
                name = f"{plain}_{number}"
            taken.add(fold(name))
            p["names"].append(name)


def apply_encode(df: DataFrame, params: dict[str, dict[str, Any]]) -> DataFrame:
    new: dict[str, list[Column]] = {}
    added: list[Column] = []
    original = df.columns
    for n, p in params.items():
        if n not in original:
            continue
        if p["method"] == "onehot":
            columns = _one_hot(df, n, p["categories"], p["names"])
        else:
            df = _join_labels(df, n, p)
            columns = [_label_column(n, p, col(f"__code_{n}"))]
        if p["keep_original"]:
            added.extend(columns)
        elif p["method"] == "label":
            new[n] = columns
        else:
            new[n] = []
            added.extend(columns)
    flat = [c for name in original for c in (new[name] if name in new else [col(name)])]
    return df.select(*flat, *added)


def _one_hot(df: DataFrame, name: str, values: list[Any], labels: list[str]) -> list[Column]:
    c = present(df, name)
    out = []
    for v, label in zip(values, labels):
        hit = c.isNull() if v is None else c.eqNullSafe(F.lit(v).cast(field(df, name).dataType))
        out.append(hit.cast("int").alias(label, metadata={ROLE: "onehot"}))
    return out


def _label_column(name: str, p: dict[str, Any], code: Column) -> Column:
    label = f"{name}_encoded" if p["keep_original"] else name
    return code.alias(label, metadata={ROLE: "label"})


def _join_labels(df: DataFrame, name: str, p: dict[str, Any]) -> DataFrame:
    """Fitted codes by a join on digests; what has none gets the number of codes. The table of a
    short list is broadcast, so the rows stay where they are; either join also runs on a stream."""
    code = f"__code_{name}"
    if p["categories"] is None:
        table, unseen = p["codes"]
        table = table.select(F.col("key").alias("__key"), F.col("code").alias(code))
    else:
        kind = field(df, name).dataType.simpleString()
        values = [v for v in p["categories"] if v is not None]  # a short list
        given = df.sparkSession.createDataFrame(
            [(v, i) for i, v in enumerate(values)], f"__value {kind}, `{code}` int"
        )
        table, unseen = F.broadcast(given.select(
            distinct_key(given, "__value").alias("__key"), col(code)
        )), len(values)
    joined = df.join(table, distinct_key(df, name) == F.col("__key"), "left").drop("__key")
    return joined.withColumn(code, F.coalesce(col(code), F.lit(unseen)))


def _code_table(df: DataFrame, name: str, order: str) -> tuple[DataFrame, int]:
    """``(key, code)`` of all present values, numbered in ordered buckets and written once, and their
    number."""
    value = f"__present_{name}"
    keyed = df.select(present(df, name).alias(value))
    counts = stored(count_of(keyed, value).where(F.col("value").isNotNull()))
    if order == "frequency":
        numbered = number_distinct(counts.withColumn("less", -F.col("n")), ["less", "value"])
    else:
        numbered = number_distinct(counts, ["value"])
    table = stored(numbered.select(
        distinct_key(numbered, "value").alias("key"), F.col("position").cast("int").alias("code")
    ))
    return table, counts.count()


def encoding_metadata(params: dict[str, dict[str, Any]]) -> list[dict[str, Any]]:
    """What an encoding did: method, new columns, and whether the source column is gone."""
    out = []
    for n, p in params.items():
        if p["method"] == "onehot":
            new = p["names"]
        else:
            new = [f"{n}_encoded" if p["keep_original"] else n]
        removed = p["method"] == "onehot" and not p["keep_original"]
        out.append({"column": n, "method": p["method"], "new_columns": new, "removed": removed})
    return out


def encode_vector(
    df: DataFrame, column: str | list[str] | None = None, output_col: str | list[str] | None = None
) -> DataFrame:
    """A one-hot vector for each named column, or each string column: most frequent category first, last
    slot for missing and unseen values. ``output_col`` names the vectors, ``{column}_onehot`` if not
    given. Vectors are sparse, and categories are the fitted codes of labels: a written table where they
    are many or long, so nothing but their number reaches the driver.
    """
    names = targets(df, column, string_columns(df) if column is None else scalar_columns(df))
    out = [output_col] if isinstance(output_col, str) else list(output_col or ())
    out = out or [f"{n}_onehot" for n in names]
    if len(out) != len(names):
        raise ValueError("output_col needs one name for each column")
    params = fit_encode(df, names, "label", order="frequency")
    coded = df
    for n in names:
        coded = _join_labels(coded, n, params[n])
    vectors = [_unit_vector(col(f"__code_{n}"), _codes(params[n]), o) for n, o in zip(names, out)]
    return coded.select(*[col(c) for c in df.columns], *vectors)


def _codes(p: dict[str, Any]) -> int:
    """How many values have a code of their own."""
    return p["codes"][1] if p["categories"] is None else sum(v is not None for v in p["categories"])


def _unit_vector(code: Column, last: int, name: str) -> Column:
    """The sparse vector with a one at ``code``, of ``last + 1`` places, made by Spark's JSON reader."""
    written = F.concat(
        F.lit(f'{{"v":{{"type":0,"size":{last + 1},"indices":['), code.cast("string"), F.lit('],"values":[1.0]}}')
    )
    shape = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(written, shape)["v"].alias(name, metadata={"ml_attr": {"num_attrs": last + 1}})
