"""Text operators: X1 to X13."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from washline.functions import text
from washline.functions.columns import col
from washline.operators import textcols, tfidf

from .common import SQL_SPACE, big, derived, derived_sql, query, r, rounded, table, tokens_sql, words_sql
from .expected import BASIC_STOP_WORDS, ENGLISH_STOP_WORDS, NOUN_ENDINGS

DOC = f"{big('doc_id')} AS doc_id"
TURN = f"{big('conv_id')} AS conv_id, {big('turn')} AS turn"
CONVERSATIONS = derived_sql("odd_conversations")
ENGLISH = ENGLISH_STOP_WORDS


def without_words(expression: str, words: list[str]) -> str:
    kept = f"list_filter({tokens_sql(expression)}, lambda w: lower(w) NOT IN ({words_sql(words)}))"
    return f"array_to_string({kept}, ' ')"


def stripped(expression: str) -> str:
    return f"regexp_replace({expression}, '^[{SQL_SPACE}]+|[{SQL_SPACE}]+$', '', 'g')"


def special(expression: str) -> str:
    return f"regexp_replace({expression}, '[^a-zA-Z0-9{SQL_SPACE}]', '', 'g')"


def spaces(expression: str) -> str:
    return f"regexp_replace({expression}, '[{SQL_SPACE}]+', ' ', 'g')"


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def documents_sql(expression: str) -> str:
    return f"SELECT {DOC}, {expression} AS text FROM documents"


def by_operation(name: str, sql: str):
    @query(f"text_{name}", documents_sql(sql))
    def run(spark, sf):
        return rounded(textcols.clean_text(documents(spark, sf), "text", [name]))


by_operation("lowercase", "lower(text)")
by_operation("remove_special_chars", special("text"))
by_operation("remove_stopwords", without_words("text", BASIC_STOP_WORDS))
by_operation("strip_whitespace", stripped("text"))
by_operation("remove_extra_spaces", spaces("text"))
by_operation("remove_numbers", r"regexp_replace(text, '\p{Nd}+', '', 'g')")


@query("text_clean_default", documents_sql(
    stripped(without_words(special("lower(text)"), BASIC_STOP_WORDS))))
def text_clean_default(spark, sf):
    return rounded(textcols.clean_text(documents(spark, sf)))


@query("text_clean_missing_values", f"""
SELECT {TURN}, role, {stripped(without_words(special("lower(text)"), BASIC_STOP_WORDS))} AS text
FROM ({CONVERSATIONS})""")
def text_clean_missing_values(spark, sf):
    return rounded(textcols.clean_text(derived(spark, sf, "odd_conversations"), "text", gate=False))


@query("text_letters_only", f"""
SELECT {TURN}, role, coalesce({stripped(spaces(f"regexp_replace(lower(text), '[^a-z{SQL_SPACE}]', '', 'g')"))}, '') AS text
FROM ({CONVERSATIONS})""")
def text_letters_only(spark, sf):
    return rounded(textcols.clean_letters(derived(spark, sf, "odd_conversations"), "text"))


@query("remove_english_stop_words", documents_sql(without_words("text", ENGLISH)))
def remove_english_stop_words(spark, sf):
    return rounded(textcols.remove_stop_words(documents(spark, sf), "text"))


@query("tokens_without_stop_words", f"""
SELECT {TURN}, array_to_string(list_filter({tokens_sql('lower(text)')},
 lambda w: w NOT IN ({words_sql(ENGLISH)})), '|') AS filtered_words FROM ({CONVERSATIONS})""")
def tokens_without_stop_words(spark, sf):
    turns = derived(spark, sf, "odd_conversations").drop("role")
    return rounded(textcols.filtered_words(turns, "text").drop("text"))


# The vocabulary is every token of the documents; each token maps to the shortest of itself and its
# noun bases found in the vocabulary.
def _base(ending: str, base: str) -> str:
    stem = f"left(word, length(word) - {len(ending)}) || '{base}'"
    return f"SELECT word, {stem} AS lemma FROM v WHERE word LIKE '%{ending}'"


_LEMMAS = f"""
v AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM documents),
candidates AS (SELECT word, word AS lemma FROM v UNION ALL {' UNION ALL '.join(_base(e, b) for e, b in NOUN_ENDINGS)}),
lemmas AS (SELECT word, arg_min(lemma, (length(lemma), lemma)) AS lemma
           FROM candidates WHERE lemma IN (SELECT word FROM v) GROUP BY word)"""
_LEMMATIZED = f"""
WITH {_LEMMAS},
words AS (SELECT doc_id, unnest({tokens_sql('text')}) AS word, generate_subscripts({tokens_sql('text')}, 1) AS place FROM documents),
joined AS (SELECT doc_id, string_agg(coalesce(lemma, word), ' ' ORDER BY place) AS text
           FROM words LEFT JOIN lemmas USING (word) GROUP BY doc_id)
SELECT {big('d.doc_id')} AS doc_id, coalesce(j.text, '') AS text FROM documents d LEFT JOIN joined j USING (doc_id)"""


def lemma_table(spark, sf):
    """Lemmas of the words that occur; every other form would never be looked up."""
    words = documents(spark, sf).select(F.explode(text.tokens(col("text"))).alias("word")).distinct()
    return textcols.noun_lemmas(words).join(words, "word", "left_semi")


@query("lemmatize_documents", _LEMMATIZED)
def lemmatize_documents(spark, sf):
    return rounded(textcols.lemmatize(documents(spark, sf), "text", lemma_table(spark, sf)))


@query("lemmatize_documents_by_join", _LEMMATIZED)
def lemmatize_documents_by_join(spark, sf):
    """The way for a lemma table too large to broadcast."""
    lemmas = lemma_table(spark, sf)
    return rounded(textcols.lemmatize(documents(spark, sf), "text", lemmas, max_broadcast=0))


@query("lemmatize_conversations_by_join", f"""
WITH c AS (SELECT conv_id, turn, text FROM ({derived_sql('odd_conversations')})),
v AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM c),
words AS (SELECT conv_id, turn, unnest({tokens_sql('text')}) AS word, generate_subscripts({tokens_sql('text')}, 1) AS place FROM c),
joined AS (SELECT conv_id, turn, string_agg(CASE WHEN length(word) > 6 THEN left(word, 6) ELSE word END, ' ' ORDER BY place) AS text
           FROM words GROUP BY conv_id, turn)
SELECT {big('c.conv_id')} AS conv_id, CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text
FROM c LEFT JOIN joined j USING (conv_id, turn)""")
def lemmatize_conversations_by_join(spark, sf):
    """A table whose only key repeats; every word is listed twice, the longer form is no lemma."""
    turns = derived(spark, sf, "odd_conversations").select("conv_id", "text")
    words = turns.select(F.explode(text.tokens(col("text"))).alias("word"))
    lemmas = words.select("word", F.left("word", F.lit(6)).alias("lemma"))
    return rounded(textcols.lemmatize(turns, "text", lemmas, gate=False, max_broadcast=0))


@query("noun_lemma_table", f"WITH {_LEMMAS} SELECT word, lemma FROM lemmas WHERE word IN (SELECT word FROM v)")
def noun_lemma_table(spark, sf):
    return lemma_table(spark, sf)


_TFIDF = r"""
tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM tokens GROUP BY ALL),
top AS (SELECT term, sum(n) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 100),
ranked AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS i FROM top),
raw AS (SELECT doc_id, term, i, n * idf AS w FROM tf JOIN ranked USING (term)),
weighted AS (SELECT doc_id, term, i, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query("tfidf_rows", f"WITH {_TFIDF} SELECT {DOC}, term, {r('weight')} AS weight FROM weighted")
def tfidf_rows(spark, sf):
    return rounded(tfidf.tfidf_long(documents(spark, sf), "text", "doc_id"))


@query("tfidf_columns", f"""
WITH {_TFIDF}
SELECT {big('d.doc_id')} AS doc_id, {', '.join(
    f"{r(f'coalesce(max(CASE WHEN i = {k} THEN weight END), 0)')} AS text_tfidf_{k}" for k in range(100))}
FROM documents d LEFT JOIN weighted w ON w.doc_id = d.doc_id GROUP BY d.doc_id""")
def tfidf_columns(spark, sf):
    return rounded(tfidf.tfidf(documents(spark, sf), "text"))


@query("tfidf_term_counts", r"""
WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents)
SELECT term, count(*) AS total, count(DISTINCT doc_id) AS documents FROM tokens GROUP BY term""")
def tfidf_term_counts(spark, sf):
    df = documents(spark, sf)
    return rounded(tfidf.term_totals(df, "text").join(tfidf.document_counts(df, "text"), "term"))


# MurmurHash3 (32 bits, seed 42) of the UTF-8 bytes x, in hexadecimal digits.
def _rotated(x: str, n: int) -> str:
    return f"((({x}) << {n}) | (({x}) >> {32 - n})) & 4294967295"


def _times(x: str, factor: int) -> str:
    return f"(({x}) * {factor}::UBIGINT) % 4294967296::UBIGINT"


def _mixed(x: str) -> str:
    return _times(_rotated(_times(x, 0xCC9E2D51), 15), 0x1B873593)


def _byte(at: str) -> str:
    return f"CAST('0x' || substr(x, CAST(2 * ({at}) + 1 AS BIGINT), 2) AS UBIGINT)"


_WHOLE = " | ".join(f"({_byte(f'4 * i + {k}')} << {8 * k})" for k in range(4))
_TAIL = " | ".join(
    f"(CASE WHEN n % 4 > {k} THEN {_byte(f'n - n % 4 + {k}')} ELSE 0::UBIGINT END << {8 * k})" for k in range(3))
_HASHED = f"""
words AS (SELECT DISTINCT term, hex(encode(term)) AS x, CAST(octet_length(encode(term)) AS BIGINT) AS n FROM tokens),
parts AS (SELECT term, x, n, list_prepend(42::UBIGINT, list_transform(range(n // 4), lambda i: {_WHOLE})) AS blocks,
          {_TAIL} AS tail FROM words),
body AS (SELECT term, n, tail, list_reduce(blocks, lambda h, k:
          (({_rotated(f"xor(h, {_mixed('k')})", 13)}) * 5 + 3864292196) % 4294967296::UBIGINT) AS h FROM parts),
f0 AS (SELECT term, xor(CASE WHEN n % 4 > 0 THEN xor(h, {_mixed('tail')}) ELSE h END, n::UBIGINT) AS h FROM body),
f1 AS (SELECT term, {_times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM f0),
f2 AS (SELECT term, {_times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM f1),
f3 AS (SELECT term, CAST(xor(h, h >> 16) AS BIGINT) AS h FROM f2),
slots AS (SELECT term, (((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 1000) + 1000) % 1000 AS slot FROM f3)"""


@query("tfidf_hashed", fr"""
WITH tokens AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[ \t\n\v\f\r]+$', ''), '[ \t\n\v\f\r]')) AS term
  FROM documents), {_HASHED},
tf AS (SELECT doc_id, slot, count(*) AS n FROM tokens JOIN slots USING (term) GROUP BY ALL),
idf AS (SELECT slot, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY slot)
SELECT {DOC}, {big('slot')} AS slot, {r('n * idf')} AS weight FROM tf JOIN idf USING (slot) WHERE n * idf <> 0""")
def tfidf_hashed(spark, sf):
    vectors = tfidf.tfidf_hashed(documents(spark, sf), "text")
    weights = F.posexplode(vector_to_array("tfidf_features")).alias("slot", "weight")
    return rounded(vectors.select("doc_id", weights).where(F.col("weight") != 0))


@query("text_gate_leaves_categories",
       f"SELECT {DOC}, {without_words('text', ENGLISH)} AS text, lang, source, {big('n_chars')} AS n_chars FROM documents")
def text_gate_leaves_categories(spark, sf):
    return rounded(textcols.remove_stop_words(table(spark, sf, "documents")))
