"""Rows that every operator must take: nulls, empty and very long texts, repeated rows, clashing column names."""

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll larch mesa notch oasis pond quay reef shoal tarn".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with the awkward cases, in columns that clash with those the operators add."""
    base = prose(1, 60)
    texts = [base, base, base + " tail", prose(2, 40), prose(2, 40).upper(), "", None, " \t\n ", "one two", "one two", "one\x0btwo", prose(3, 30000), "x" * 5000,
             "naïve café 日本 😀 <|endoftext|> end", "dup line\ndup line\n\ndup line", " ".join(["a b c d e f g h"] * 9)]
    rows = [(i, t, None if i % 5 == 4 else "en", None if i % 7 == 3 else f"s{i % 2}", 0) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id here at all", "de", "s0", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.selectExpr("*", "1 as score", "2 as kept", "'x' as shard", "0 as position", "5 as n", "'y' as row", "7 as block", "array(1) as grams", "3 as part", "1 as label")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
