import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

# extra columns whose names the operators use inside
CLASH = ["key", "number", "size", "kind", "fp", "digest", "content", "place", "bucket", "turn", "n", "word", "row", "score", "label", "count"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASH]
)

LONG = "\n".join(f"the long text of line {i} goes on and on with words number {i * 7919 % 10007}" for i in range(4000))
MESSY = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the  quick brown\tfox jumps over the lazy dog", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \n\t ", "en", None),
    (6, LONG, "en", "a"),
    (7, "Ünïcödé 漢字 😀 password = abcdef123456", "de", "c"),
    (8, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (8, "the quick brown fox jumps over the lazy dog", "en", "a"),  # a repeated row
    (9, "one", "en", "b"),
    (9, "another text under the same identifier", "en", "b"),
    (None, "a text without identifier", "en", "a"),
    (10, "a text without identifier", None, None),
    (11, "word " * 500, "en", "c"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty, blank and very long texts, ties, repeated rows and clashing column names."""
    return spark.createDataFrame([Row(*r, *["x"] * len(CLASH)) for r in MESSY], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
