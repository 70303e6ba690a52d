import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and blank texts, repeated rows, copies, a very long text, clashing extra columns."""
    import random

    r = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    long = " ".join(r.choice(words) for _ in range(40_000))
    base = " ".join(r.choice(words) for _ in range(120))
    rows = [
        (1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base, None, "b", 2), (3, base + " tail", "en", "a", 3), (4, None, "en", "a", None), (5, "", "en", None, 0), (6, "  \n\n ", "en", "a", 5),
        (None, "one two", None, None, None), (None, None, None, None, None), (7, long, "en", "b", 9), (8, "one two", "en", "b", 7), (9, "\x1c\x00é İ Σς ﬁ 中文 <|endoftext|> 😀", "de", "b", 3), (10, "x" * 3000, "en", "a", 3000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "key", "node", "size", "words", "taken", "epoch", "shard", "cell", "label", "score", "n", "band", "best", "short", "bytes", "row_key", "ranges", "length", "start"):
        from pyspark.sql import functions as F

        docs = docs.withColumn(c, F.lit("clash"))
    return docs.cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
