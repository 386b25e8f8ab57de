"""Text steps on table columns, the lemma table and the long-text gate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.columns import col, replace_columns, string_columns, targets
from ..functions.words import NOUN_ENDINGS
from .checkpoints import stored
from .counts import count_of
from .joins import join_by_value
from .typing import long_text_columns

MAX_BROADCAST_LEMMAS = 1_000_000


def text_columns(df: DataFrame, column, gate: bool) -> list[str]:
    """The string columns a text step works on; with ``gate`` only those holding long text."""
    if gate:
        return long_text_columns(df, column)
    return targets(df, column, string_columns(df))


def clean_text(
    df: DataFrame,
    column=None,
    operations: Sequence[str] = text.DEFAULT_OPERATIONS,
    null_as: str | None = None,
    gate: bool = True,
) -> DataFrame:
    """Apply the named text operations in order, in place."""
    def cleaned(c: Column) -> Column:
        out = text.clean(c, operations)
        return out if null_as is None else F.coalesce(out, F.lit(null_as))

    return replace_columns(df, {n: cleaned(col(n)) for n in text_columns(df, column, gate)})


def clean_letters(df: DataFrame, column: str, null_as: str | None = "") -> DataFrame:
    """Lower-case letters and single spaces only."""
    return replace_columns(df, {column: text.letters_only(col(column), null_as)})


def remove_stop_words(
    df: DataFrame, column=None, words: Sequence[str] | None = None, gate: bool = True
) -> DataFrame:
    """Drop stop words (full English list unless given); other words keep their case."""
    stop = StopWordsRemover.loadDefaultStopWords("english") if words is None else words
    return replace_columns(df, {
        n: text.remove_stop_words(col(n), stop) for n in text_columns(df, column, gate)
    })


def filtered_words(
    df: DataFrame, column: str, output_col: str = "filtered_words",
    words: Sequence[str] | None = None,
) -> DataFrame:
    """Add the lower-case tokens that are not stop words as an array column."""
    stop = StopWordsRemover.loadDefaultStopWords("english") if words is None else words
    return df.withColumn(output_col, text.keep_words(text.tokens(F.lower(col(column))), stop))


def noun_lemmas(vocabulary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """A ``(word, lemma)`` table from a ``(word)`` vocabulary by the English noun endings.

    Every inflected form of a vocabulary word gets that word as a candidate; the shortest
    candidate wins, the word itself included when it is in the vocabulary. Exceptions win over
    the rules.
    """
    word = F.col("word")
    forms = [F.struct(word.alias("word"), word.alias("lemma"))]
    for ending, base in NOUN_ENDINGS:
        stem = F.left(word, F.length(word) - len(base))
        form = F.struct(F.concat(stem, F.lit(ending)).alias("word"), word.alias("lemma"))
        forms.append(F.when(F.endswith(word, F.lit(base)), form))
    table = (
        vocabulary.select(F.inline(F.array_compact(F.array(*forms))))
        .groupBy("word")
        .agg(F.min_by("lemma", F.struct(F.length("lemma"), F.col("lemma"))).alias("lemma"))
    )
    if exceptions is None:
        return table
    listed = exceptions.select("word", "lemma")
    return listed.unionByName(table.join(listed, "word", "left_anti"))


def lemmatize(
    df: DataFrame,
    column: str,
    lemmas: DataFrame,
    gate: bool = True,
    max_broadcast: int = MAX_BROADCAST_LEMMAS,
) -> DataFrame:
    """Replace each whitespace token by its lemma; tokens without one stay as they are. Of several
    lemmas of a word the smallest counts.

    A table of at most ``max_broadcast`` rows is broadcast and rows never move: tokens are cut and joined by
    Spark, and each distinct word of an Arrow batch is looked up once, as Spark's own map look-up is a
    linear search. A larger table is joined token by token.
    """
    if not text_columns(df, column, gate):
        return df
    table = _small_table(lemmas, max_broadcast)
    if table is None:
        return _joined_lemmas(df, text.tokens(col(column)), lemmas, column, as_text=True)
    look_up = _look_up(df.sparkSession, table)
    return replace_columns(df, {column: F.array_join(look_up(text.tokens(col(column))), " ")})


def _look_up(spark: SparkSession, table: dict[str, str]):
    """A function of token arrays whose only Python work is a look-up for each distinct word of a batch."""
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("array<string>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in batches:
            yield _replaced(tokens, shared.value)

    return look_up


def _changed_words():
    """A function of token arrays, and of the words that change in them and their lemmas. A word has one lemma
    everywhere, so a batch needs one table and one look-up for each distinct word."""
    @F.arrow_udf("array<string>")
    def change(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for tokens, words, lemmas in batches:
            table = dict(zip(words.flatten().to_pylist(), lemmas.flatten().to_pylist()))
            yield _replaced(tokens, table)

    return change


def _replaced(tokens: pa.Array, table: dict[str, str]) -> pa.Array:
    coded = tokens.flatten().dictionary_encode()
    lemmas = pa.array([table.get(w, w) for w in coded.dictionary.to_pylist()], pa.string())
    many = np.append(0, pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).cumsum())
    return pa.ListArray.from_arrays(pa.array(many, pa.int32()), lemmas.take(coded.indices), mask=tokens.is_null())


def lemmatize_words(
    df: DataFrame, tokens_col: str, lemmas: DataFrame, output_col: str = "lemmatized_words",
    max_broadcast: int = MAX_BROADCAST_LEMMAS,
) -> DataFrame:
    """Add the lemmas of a token array as an array column."""
    table = _small_table(lemmas, max_broadcast)
    if table is None:
        return _joined_lemmas(df, col(tokens_col), lemmas, output_col, as_text=False)
    return df.withColumn(output_col, _look_up(df.sparkSession, table)(col(tokens_col)))


def _changing(lemmas: DataFrame) -> DataFrame:
    """One lemma a word, without the words that stay as they are."""
    one = lemmas.where(F.col("word").isNotNull()).groupBy("word").agg(F.min("lemma").alias("lemma"))
    return one.where(F.col("word") != F.col("lemma"))


def _small_table(lemmas: DataFrame, limit: int) -> dict[str, str] | None:
    """The lemma table as a dict, or None above ``limit`` rows."""
    if limit <= 0:  # asked for the join
        return None
    rows = _changing(lemmas).limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return None
    return dict(zip(rows["word"].to_pylist(), rows["lemma"].to_pylist()))


def _joined_lemmas(
    df: DataFrame, tokens: Column, lemmas: DataFrame, output: str, as_text: bool
) -> DataFrame:
    """The look-up as a join. Rows get numbers in a written table, so that rows without a key, or with
    a repeated one, keep to themselves."""
    rows = stored(df.select("*", tokens.alias("__tokens"), F.monotonically_increasing_id().alias("__row")))
    # a row sends each of its words once, and gets back those that change
    words = rows.select("__row", F.explode(F.array_distinct("__tokens")).alias("__word")).where("__word IS NOT NULL")
    # both are read several times, and may come from a scan of all texts
    table = stored(_changing(lemmas).select(F.col("word").alias("value"), F.col("lemma").alias("__lemma")))
    counts = stored(count_of(words, "__word"))
    found = join_by_value(words, "__word", counts, table).where("__lemma IS NOT NULL")
    changed = found.groupBy("__row").agg(  # a group is one row's own words
        F.collect_list(F.struct("__word", "__lemma")).alias("__changed")
    )
    back = rows.join(changed, "__row", "left")
    done = _changed_words()(col("__tokens"), F.col("__changed.__word"), F.col("__changed.__lemma"))
    new = (F.array_join(done, " ") if as_text else done).alias(output)
    if output in df.columns:
        return back.select(*[new if c == output else col(c) for c in df.columns])
    return back.select(*[col(c) for c in df.columns], new)
