"""Documents with every odd case: NULLs, empty and long texts, repeats, clashing column names."""

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("score", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("rid", T.StringType()),
    T.StructField("_id", T.StringType()), T.StructField("_text", T.StringType()),
    T.StructField("n_words", T.StringType()), T.StructField("_times", T.StringType()),
])

STORY = " ".join(f"word{i} tells{i % 7} a{i % 3} story{i % 11}" for i in range(60))


def rows():
    near = STORY.replace("word30", "other")
    texts = [
        (1, STORY, "a"), (2, STORY, "a"), (3, near, "b"), (3, near, "b"), (4, "", "a"), (5, None, "a"),
        (6, "one two three", "b"), (7, "one  two\nthree", None), (None, "no id here " * 4, "a"),
        (None, "no id here " * 4, "a"), (8, "long " * 30_000 + "end", "c"), (9, " \n\t\x0b ", "c"),
        (10, "ünïcödé wörter und mehr davon, 日本 語 text", "a"), (11, "same same same same", None),
        (12, "Released under the MIT License.\nplain line", "b"), (13, STORY[:400] + " changed end", "c"),
    ]
    return [(i, t, "en", s, None, *["x"] * 8) for i, t, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
