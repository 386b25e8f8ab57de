"""Text steps, lemmas and TF-IDF on hand-made texts."""

import math
import re

import pytest
from pyspark.ml.feature import HashingTF, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from washline.functions import text
from entry_queries.expected import ENGLISH_STOP_WORDS
from washline.functions.words import BASIC_STOP_WORDS
from washline.operators import textcols, tfidf, typing

TEXTS = [
    None, "", "   ", "Café at the Zoo now", "tab\x0bstop\x1cThe  END ", "12 Apples and 3 Pears", "naïve THE the",
    "trailing newline\n",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")


def values(df, name="t"):
    return [r[0] for r in df.orderBy("k").select(name).collect()]


def drop_stop(t, words=BASIC_STOP_WORDS):
    return " ".join(w for w in t.split() if w.lower() not in words)


PYTHON = {
    "lowercase": str.lower,
    "remove_special_chars": lambda t: re.sub(r"[^a-zA-Z0-9\s]", "", t),
    "remove_stopwords": drop_stop,
    "strip_whitespace": str.strip,
    "remove_extra_spaces": lambda t: re.sub(r"\s+", " ", t),
    "remove_numbers": lambda t: re.sub(r"\d+", "", t),
}


@pytest.mark.parametrize("operation", sorted(PYTHON))
def test_operations_match_python(texts, operation):
    got = values(textcols.clean_text(texts, "t", [operation], gate=False))
    assert got == [None if t is None else PYTHON[operation](t) for t in TEXTS]


def test_default_chain_and_missing_text(texts):
    chain = values(textcols.clean_text(texts, "t", gate=False))
    want = [None if t is None else drop_stop(PYTHON["remove_special_chars"](t.lower())).strip() for t in TEXTS]
    assert chain == want
    assert values(textcols.clean_text(texts, "t", gate=False, null_as=""))[0] == ""


def test_unknown_operation(texts):
    with pytest.raises(ValueError, match="unknown"):
        textcols.clean_text(texts, "t", ["shout"], gate=False)


def test_letters_only(texts):
    def python(t):
        return re.sub(r"\s+", " ", re.sub(r"[^a-z\s]", "", t.lower())).strip()
    assert values(textcols.clean_letters(texts, "t")) == ["" if t is None else python(t) for t in TEXTS]


def test_english_list_is_the_built_in_one(spark):
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_filtered_words(texts):
    got = values(textcols.filtered_words(texts, "t"), "filtered_words")
    assert got[0] is None
    assert got[5] == ["12", "apples", "3", "pears"]


LEMMAS = {"Apples": "Apple", "Pears": "Pear"}


@pytest.mark.parametrize("limit", [10, 0])
def test_lemmatize(spark, texts, limit):
    table = spark.createDataFrame(list(LEMMAS.items()), "word string, lemma string")
    got = values(textcols.lemmatize(texts, "t", table, gate=False, max_broadcast=limit))
    assert got == [None if t is None else " ".join(LEMMAS.get(w, w) for w in t.split()) for t in TEXTS]


def test_lemmatize_words_in_an_array(spark, texts):
    table = spark.createDataFrame([("apples", "apple")], "word string, lemma string")
    tokens = textcols.filtered_words(texts, "t")
    got = values(textcols.lemmatize_words(tokens, "filtered_words", table), "lemmatized_words")
    assert got[0] is None and got[5] == ["12", "apple", "3", "pears"]


def test_noun_lemmas(spark):
    vocabulary = spark.createDataFrame(
        [(w,) for w in ("dog", "box", "leaf", "man", "city", "bus", "church", "quiz", "wish", "boxes")], "word string")
    exceptions = spark.createDataFrame([("geese", "goose")], "word string, lemma string")
    got = {r["word"]: r["lemma"] for r in textcols.noun_lemmas(vocabulary, exceptions).collect()}
    for word, lemma in {
        "dogs": "dog", "boxes": "box", "leaves": "leaf", "men": "man", "cities": "city", "buses": "bus",
        "churches": "church", "quizes": "quiz", "wishes": "wish", "geese": "goose", "dog": "dog",
    }.items():
        assert got[word] == lemma


DOCS = ["the cat sat", "the cat ate the rat", None, "A b", "dog dog dog cat"]


def test_tfidf_vocabulary_form(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "k int, t string")
    fitted = tfidf.fit_tfidf(df, "t", 3)
    assert fitted["terms"] == ["cat", "dog", "the"]
    out = tfidf.apply_tfidf(df, fitted).orderBy("k").collect()
    tokens = [re.findall(r"\w\w+", (t or "").lower()) for t in DOCS]
    for row, words in zip(out, tokens):
        raw = []
        for term in fitted["terms"]:
            documents = sum(term in ws for ws in tokens)
            raw.append(words.count(term) * (math.log((1 + len(DOCS)) / (1 + documents)) + 1))
        norm = math.sqrt(sum(w * w for w in raw)) or 1.0
        assert [row[f"t_tfidf_{i}"] for i in range(3)] == pytest.approx([w / norm for w in raw])


def test_tfidf_hashed_matches_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "k int, t string")
    got = tfidf.tfidf_hashed(df, "t", num_features=64).orderBy("k")
    assert got.columns == ["k", "t", "tfidf_features"]
    hashing = HashingTF(numFeatures=64)
    slots = [[hashing.indexOf(w) for w in re.split(r"\s", (t or "").lower())] for t in DOCS]
    for row, words in zip(got.select(vector_to_array("tfidf_features")).collect(), slots):
        want = [
            words.count(j) * math.log((len(DOCS) + 1) / (sum(j in ws for ws in slots) + 1)) for j in range(64)
        ]
        assert list(row[0]) == pytest.approx(want)


def test_gate(spark):
    long = [(f"This is a long review number {i} of the thing", "the cat", str(i)) for i in range(40)]
    df = spark.createDataFrame(long, "review string, status string, digits string")
    assert typing.long_text_columns(df) == ["review"]
    cleaned = textcols.remove_stop_words(df).first()
    assert cleaned["review"].startswith("long review") and cleaned["status"] == "the cat"
    assert not typing.name_allows_text("video_text")  # contains "id"


def test_tokens_of_missing(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(text.tokens(F.col("t"))).first()[0] is None
