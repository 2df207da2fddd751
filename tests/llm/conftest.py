import duckdb
import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts (numbered from 0) or (doc_id, text) pairs, with columns whose names the operators use too."""

    def make(rows):
        rows = [(i, r) if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        full = [(i, t, "en", "src", len(t or ""), "x", 1) for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key int"
        )

    return make


@pytest.fixture(scope="session")
def duck():
    return duckdb.connect()
