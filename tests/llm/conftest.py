import pytest

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls everywhere, empty and blank texts, a long text, repeated rows and keys, and columns whose
    names the operators use themselves."""
    long = " ".join(f"word{i % 977} über" for i in range(60_000))
    passage = "the quick brown fox jumps over the lazy dog while the cat sleeps on the warm mat " * 4
    rows = [
        (1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 0),
        (4, passage + "one", "en", "a", 0), (4, passage + "one", "en", "a", 0),
        (5, passage + "two entirely different words follow here", "en", None, 0),
        (None, "A text without a key.", "en", "b", 0), (None, "A text without a key.", "en", "b", 0),
        (6, long, "de", "b", 0), (7, "漢字 😀 é́   it's we'll  x", "de", "b", 0),
        (8, "12 34 !!", "de", "b", 0),
    ]
    return spark.createDataFrame(
        [(*r, "x", 1, "y", 2) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, "
        "host string, row long, key string, n_lines int",
    )


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
