import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, ties, repeated rows, a long text, and extra columns with clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    long = " ".join(word() for _ in range(30_000))
    text = " ".join(word() for _ in range(120))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, text, "en", "a"), (4, text, "en", "a"), (5, text + " x", "en", "b"), (6, long, "de", "b"), (7, "one two", "de", None), (None, text, "en", "a"), (9, "Σß İ é́   \x1c <|endoftext|> don't", "fr", "a"), (10, "😀" * 50 + " a\x00b", "fr", "c"), (12, "日本" * 30_000, "ja", None)]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("rep", "a", "b", "k", "h", "size", "shard", "slot", "before", "bucket", "index", "w", "t", "score", "start", "label", "spans")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
