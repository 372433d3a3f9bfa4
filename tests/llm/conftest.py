import datetime

import pytest

SF01 = "/root/testdata/sf0.01"
SF001 = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and clashing extra columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, " \t\n\r ", "en", None, 5),
        (None, "no id here but some words", "en", "b", 25),
        (None, "no id here but some words", "en", "b", 25),
        (5, LONG, "en", "b", len(LONG)),
        (6, "é😀 ünïcode wörds İ ß ſ K", "de", "c", 24),
        (7, "x" * 30_000, "en", "c", 30_000),
        (8, "<|endoftext|> special <|endoftext|>", "en", None, 36),
    ]
    extra = [(*r, 0.5, 7, "f", datetime.date(2020, 1, 1), [1]) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score double, "
                                        "size int, fp string, rank date, n array<int>")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
