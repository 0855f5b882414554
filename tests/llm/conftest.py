import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Build a documents table from (doc_id, text) or longer rows."""
    def build(rows, schema=DOCS):
        width = len(schema.split(", "))
        full = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return spark.createDataFrame(full, schema)
    return build


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
