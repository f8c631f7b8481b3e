import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, word string"


@pytest.fixture(scope="session")
def sample(spark):
    """Real documents as (doc_id, text) pairs."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def odd(sample):
    """Rows with nulls, empty and very long texts, ties, repeated rows and spaces of all kinds."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(60))
    return [
        (900, None, None), (901, "", "a"), (902, " \t\n\x0b\f\r", "a"), (903, long, "a"), (904, long, "b"), (905, long + " end", "b"),
        (906, "One two THREE four", "a"), (906, "One two THREE four", "a"), (907, "one two three four", "c"), (908, "x y", "c"), (909, "x  y", None),
        (910, f"start {passage} end", "a"), (911, f"{passage} {passage}", "a"), (912, f"other {passage}\n{passage} more", "a"), (906, "same id, other text", "a"),
        (None, "no id here", "a"), (None, "no id here", "a"), (913, "été übung groß <|endoftext|> end ", "a"), (914, "a\x1cb c\x85d e", "a"),
    ]


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", "y") for d, t, s in rows], SCHEMA).repartition(3)

    return make
