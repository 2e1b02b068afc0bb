import pytest

from earshot.llm.base import prepare


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts, or from (id, text) pairs."""
    prepare(spark)

    def make(items, schema="doc_id long, text string"):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(items)]
        return spark.createDataFrame(rows, schema)
    return make
