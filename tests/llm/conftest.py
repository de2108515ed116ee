import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Make documents from (id, text) or (id, text, lang, source) rows."""

    def make(rows):
        full = [(*r, *((None, None)[len(r) - 2 :]), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))
