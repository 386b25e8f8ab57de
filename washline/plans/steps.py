"""The steps a plan can name: how each is fitted on some columns and applied to a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as dataclass_field
from typing import Any

from pyspark.sql import DataFrame

from ..functions import text
from ..functions.columns import col, is_floating, replace_columns
from ..operators import dates, encode, impute, numeric, rows, scale, textcols, tfidf

ROW_STEPS = {"deduplicate"}


@dataclass
class Fitted:
    """One fitted step: its name and the small parameters its projection needs."""

    operation: str
    params: Any

    def apply(self, df: DataFrame) -> DataFrame:
        return STEPS[self.operation].apply(df, self.params)

    @property
    def row_wise(self) -> bool:
        """Whether the step looks at one row at a time, so that it also runs on a stream."""
        ordered = self.operation == "fill_missing" and "ordered" in self.params
        return self.operation not in ROW_STEPS and not ordered


@dataclass
class Step:
    fit: Callable[[DataFrame, list[str], dict[str, Any]], Any]
    apply: Callable[[DataFrame, Any], DataFrame]


@dataclass
class Cleaner:
    """Fitted steps in the order they ran; applies the same cleaning to other data."""

    steps: list[Fitted] = dataclass_field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.apply(df)
        return df


def _flag(value: Any) -> bool:
    return str(value).lower() == "true"


def _names(value: Any) -> list[str]:
    return [v.strip() for v in str(value).strip("[]").replace("'", "").split(",") if v.strip()]


def _fit_infinite(df, names, p):
    return [n for n in names if is_floating(df.schema[n].dataType)]


def _fit_outliers(df, names, p):
    return numeric.fit_outliers(df, names, p.get("outlier_strategy", "median"), _flag(p.get("approx")))


def _fit_missing(df, names, p):
    strategy = p.get("strategy", "auto")
    if strategy in ("forward_fill", "backward_fill"):
        return {"ordered": {
            "names": names, "order_by": _names(p.get("order_by", "")),
            "partition_by": _names(p.get("partition_by", "")), "forward": strategy == "forward_fill",
        }}
    return impute.fit_impute(df, names, strategy, _flag(p.get("approx")))


def _apply_missing(df, params):
    if "ordered" in params:
        return impute.ordered_fill(df, **params["ordered"])
    return impute.apply_impute(df, params)


def _fit_duplicates(df, names, p):
    keep = p.get("keep", "first")
    return {
        "subset": _names(p["subset"]) if p.get("subset") else None,
        "keep": False if str(keep).lower() == "false" else keep,
        "order_by": _names(p["order_by"]) if p.get("order_by") else None,
    }


def _fit_datetime(df, names, p):
    return {
        "column": names, "keep_original": _flag(p.get("keep_original", False)),
        "formats": [p["format"]] if p.get("format") else None,
    }


def _fit_encode(df, names, p):
    return encode.fit_encode(
        df, names, p.get("strategy", "onehot"), _flag(p.get("keep_original", False)),
        max_categories=int(p.get("max_categories", encode.MAX_ONE_HOT)),
    )


def _long_texts(df, names, p):
    """The columns holding long text; a run tests them once for all its text steps."""
    if "long_texts" in p:
        return [n for n in names if n in p["long_texts"]]
    return textcols.text_columns(df, names, gate=True)


def _fit_text(df, names, p):
    operations = _names(p["operations"]) if p.get("operations") else list(text.DEFAULT_OPERATIONS)
    return {"names": _long_texts(df, names, p), "operations": operations}


def _apply_text(df, params):
    return replace_columns(df, {n: text.clean(col(n), params["operations"]) for n in params["names"]})


def _fit_stop_words(df, names, p):
    return _long_texts(df, names, p)


def _fit_lemmas(df, names, p):
    if p.get("lemmas") is None:
        raise ValueError("the lemmatize step needs a (word, lemma) table: pass lemmas=")
    return {"names": _long_texts(df, names, p), "lemmas": p["lemmas"]}


def _apply_lemmas(df, params):
    for n in params["names"]:
        df = textcols.lemmatize(df, n, params["lemmas"], gate=False)
    return df


def _fit_tfidf(df, names, p):
    features = int(p.get("max_features", 100))
    return [tfidf.fit_tfidf(df, n, features) for n in _long_texts(df, names, p)]


def _apply_tfidf(df, params):
    for p in params:
        df = tfidf.apply_tfidf(df, p)
    return df


STEPS: dict[str, Step] = {
    "fix_infinite": Step(_fit_infinite, numeric.fix_infinite),
    "remove_outliers": Step(_fit_outliers, numeric.apply_outliers),
    "fill_missing": Step(_fit_missing, _apply_missing),
    "deduplicate": Step(_fit_duplicates, lambda df, p: rows.deduplicate(df, **p)),
    "drop_constant": Step(
        lambda df, names, p: rows.fit_constant(df, names), lambda df, names: df.drop(*names)
    ),
    "handle_datetime": Step(_fit_datetime, lambda df, p: dates.handle_datetime(df, **p)),
    "handle_skewness": Step(
        lambda df, names, p: numeric.fit_skewness(
            df, names, float(p.get("threshold", numeric.SKEW_THRESHOLD))),
        numeric.apply_skewness,
    ),
    "categorical_encode": Step(_fit_encode, encode.apply_encode),
    "text_clean": Step(_fit_text, _apply_text),
    "remove_stopwords": Step(
        _fit_stop_words, lambda df, names: textcols.remove_stop_words(df, names, gate=False)
    ),
    "lemmatize": Step(_fit_lemmas, _apply_lemmas),
    "tfidf": Step(_fit_tfidf, _apply_tfidf),
    "normalize_range": Step(
        lambda df, names, p: scale.fit_scale(df, names, "minmax"), scale.apply_scale
    ),
    "standardize": Step(
        lambda df, names, p: scale.fit_scale(df, names, "standard"), scale.apply_scale
    ),
}
