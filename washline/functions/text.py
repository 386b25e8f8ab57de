"""Text expressions: string in, string out, NULL stays NULL; all built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import BASIC_STOP_WORDS, SPACE_CLASS, SPACES

DEFAULT_OPERATIONS = ("lowercase", "remove_special_chars", "remove_stopwords", "strip_whitespace")
SPACE_RUN = f"(?U)[{SPACE_CLASS}]+"
WORD = f"(?U)[^{SPACE_CLASS}]+"


def tokens(c: Column) -> Column:
    """Whitespace tokens, none of them empty."""
    return F.filter(F.split(c, SPACE_RUN), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def lowercase(c: Column) -> Column:
    return F.lower(c)


def remove_special_chars(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)[^a-zA-Z0-9{SPACE_CLASS}]", "")


def remove_stop_words(c: Column, words: Sequence[str] = BASIC_STOP_WORDS) -> Column:
    return F.array_join(keep_words(tokens(c), words), " ")


def keep_words(words_array: Column, stop_words: Sequence[str]) -> Column:
    stop = [w.lower() for w in stop_words]
    return F.filter(words_array, lambda w: ~F.lower(w).isin(stop))


def strip_whitespace(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def remove_extra_spaces(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_RUN, " ")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}+", "")


OPERATIONS = {
    "lowercase": lowercase,
    "remove_special_chars": remove_special_chars,
    "remove_stopwords": remove_stop_words,
    "strip_whitespace": strip_whitespace,
    "remove_extra_spaces": remove_extra_spaces,
    "remove_numbers": remove_numbers,
}


def clean(c: Column, operations: Sequence[str] = DEFAULT_OPERATIONS) -> Column:
    for name in operations:
        if name not in OPERATIONS:
            raise ValueError(f"unknown text operation {name!r}")
        c = OPERATIONS[name](c)
    return c


def letters_only(c: Column, null_as: str | None = "") -> Column:
    """Lower case, keep a-z and spaces, collapse runs of spaces, strip."""
    kept = F.regexp_replace(F.lower(c), f"(?U)[^a-z{SPACE_CLASS}]", "")
    out = strip_whitespace(remove_extra_spaces(kept))
    return out if null_as is None else F.coalesce(out, F.lit(null_as))


def first_category(c: Column, text: Column, keywords: Sequence[str], any_case: bool) -> Column:
    """The first keyword ``text`` contains, in list order, else the first 20 characters of ``c``.

    ``text`` is ``c``, or its lower case when ``any_case``; a column of its own, so that it is
    computed once and not once per keyword.
    """
    out = F.when(c.isNull() | (c == ""), c)
    for word in keywords:
        out = out.when(F.contains(text, F.lit(word.lower() if any_case else word)), F.lit(word))
    return out.otherwise(F.left(c, F.lit(20)))
