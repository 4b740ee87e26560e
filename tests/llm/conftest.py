import pytest


@pytest.fixture(scope="session")
def table(spark):
    """A small table of documents with nulls, empties, ties, repeated rows and extra columns."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(rows, schema)

    return make
