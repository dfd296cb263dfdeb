import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def row(i, text, source="a", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([r if len(r) == 5 else row(*r) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    long = " ".join(f"word{i % 977} of line." + ("\n" if i % 40 == 39 else "") for i in range(30_000))
    rows = [row(1, None), row(2, ""), row(3, " \t\n "), row(4, "One."), row(5, long), row(6, "Twice told tale, twice told."), row(6, "Twice told tale, twice told."), (None, "No id at all.", None, None, None), row(8, "No source here.", None), row(9, "Null language.", "b", None)]
    return frame(rows)
