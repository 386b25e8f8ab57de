"""TF-IDF: a vocabulary form with one column per term, and a hashing form with one vector."""

from __future__ import annotations

from typing import Any

from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.feature import Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from . import frequent
from .textcols import text_columns

# Fixed value: a term is two or more word characters.
TERM = r"[\p{L}\p{N}_]{2,}"


def terms(c: Column) -> Column:
    """Lower-case terms of a text; a missing text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))


def frequent_terms(df: DataFrame, column: str, k: int) -> DataFrame | None:
    """``(term)``: a short list that holds the ``k`` most used terms; None if summaries cannot tell them from
    the others, or the table is small."""
    if df.count() <= frequent.SMALL_ROWS:
        return None
    cells = df.select(F.explode(terms(col(column))).alias("key")).select(F.lit(column).alias("column"), "key")
    found = frequent.candidates(cells, k)[1]
    return None if found is None else found.select(F.col("key").alias("term"))


def term_totals(df: DataFrame, column: str, wanted: DataFrame | None = None) -> DataFrame:
    """``(term, total)``: occurrences over the whole column, of all terms or a short list of them."""
    exploded = df.select(F.explode(terms(col(column))).alias("term"))
    if wanted is not None:
        exploded = exploded.join(F.broadcast(wanted), "term", "left_semi")
    return exploded.groupBy("term").agg(F.count(F.lit(1)).alias("total"))


def document_counts(df: DataFrame, column: str, wanted: list[str] | None = None) -> DataFrame:
    """``(term, documents)``: rows that hold a term, for all terms or the wanted ones."""
    found = terms(col(column))
    distinct = F.array_distinct(found) if wanted is None else F.array_intersect(found, F.lit(wanted))
    exploded = df.select(F.explode(distinct).alias("term"))
    return exploded.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def fit_tfidf(df: DataFrame, column: str, max_features: int = 100) -> dict[str, Any]:
    """The most used terms in term order, with smoothed inverse document frequencies.

    Two scans: totals of every term, then document counts of the chosen terms only.
    """
    totals = term_totals(df, column, frequent_terms(df, column, max_features))
    top = totals.orderBy(F.desc("total"), "term").limit(max_features).collect()
    chosen = sorted(r["term"] for r in top)  # max_features rows
    if not chosen:
        return {"column": column, "terms": [], "idf": []}
    rows = df.count()
    idf = F.log((1 + F.lit(rows)) / (1 + F.col("documents"))) + 1
    weights = dict(document_counts(df, column, chosen).select("term", idf).collect())
    return {"column": column, "terms": chosen, "idf": [weights[t] for t in chosen]}


def apply_tfidf(df: DataFrame, params: dict[str, Any], keep_original: bool = False) -> DataFrame:
    """Row-local: count, weight and L2-normalise; one ``{column}_tfidf_{i}`` column per term."""
    column = params["column"]
    kept = [col(c) for c in df.columns if keep_original or c != column]
    if not params["terms"]:
        return df.select(*kept)
    # the array is a column of its own, so that it is made once and not once per term
    arrays = _vectors(df, params).withColumn("__weights", vector_to_array("__normal"))
    new = [
        F.get("__weights", F.lit(i)).alias(f"{column}_tfidf_{i}") for i in range(len(params["terms"]))
    ]
    return arrays.select(*kept, *new)


def _vectors(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    counter = CountVectorizerModel.from_vocabulary(
        params["terms"], inputCol="__terms", outputCol="__counts"
    )
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense(params["idf"]), inputCol="__counts", outputCol="__weighted"
    )
    norm = Normalizer(p=2.0, inputCol="__weighted", outputCol="__normal")
    counted = counter.transform(df.withColumn("__terms", terms(col(params["column"]))))
    return norm.transform(weigh.transform(counted))


def tfidf(df: DataFrame, column: str, max_features: int = 100, gate: bool = True) -> DataFrame:
    if not text_columns(df, column, gate):
        return df
    return apply_tfidf(df, fit_tfidf(df, column, max_features))


def tfidf_long(df: DataFrame, column: str, key: str, max_features: int = 100) -> DataFrame:
    """The same weights as ``(key, term, weight)`` rows, non-zero ones only."""
    params = fit_tfidf(df, column, max_features)
    names = F.array(*[F.lit(t) for t in params["terms"]])
    pairs = F.arrays_zip(names.alias("term"), vector_to_array("__normal").alias("weight"))
    return (
        _vectors(df, params)
        .select(col(key), F.inline(pairs).alias("term", "weight"))
        .where(F.col("weight") != 0)
    )


def tfidf_hashed(
    df: DataFrame, column: str, output_col: str = "tfidf_features", num_features: int = 1000
) -> DataFrame:
    """Hashed term counts times ln((n + 1) / (df + 1)), as a vector column; also of a table without rows."""
    texts = df.withColumn("__text", F.coalesce(col(column), F.lit("")))
    words = Tokenizer(inputCol="__text", outputCol="__words").transform(texts)
    counts = HashingTF(
        inputCol="__words", outputCol="__counts", numFeatures=num_features
    ).transform(words)
    if df.isEmpty():
        weighted = counts.withColumn(output_col, col("__counts"))
    else:
        weighted = IDF(inputCol="__counts", outputCol=output_col).fit(counts).transform(counts)
    return weighted.drop("__text", "__words", "__counts")
