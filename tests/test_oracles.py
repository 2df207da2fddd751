"""Every registered query against its SQL on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from geozone.plans.oracles import oracles
from geozone.plans.queries import REGISTRY

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    yield con
    con.close()


def canonical(table):
    """Columns by name, rows sorted; floats rounded to 12 significant digits."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]

    def cell(x):
        if isinstance(x, float) and not math.isnan(x):
            return x + 0.0
        return x

    rows = [tuple(cell(x) for x in row) for row in zip(*columns, strict=True)]
    return names, sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, duck, name):
    ours = REGISTRY[name](spark, DATA).toArrow()
    theirs = duck.sql(oracles()[name]).to_arrow_table()
    our_names, our_rows = canonical(ours)
    their_names, their_rows = canonical(theirs)
    assert our_names == their_names
    our_types = {f.name: str(f.type).replace("large_", "") for f in ours.schema}
    their_types = {f.name: str(f.type).replace("large_", "") for f in theirs.schema}
    assert our_types == their_types
    assert len(our_rows) == len(their_rows)
    assert our_rows == their_rows
    assert our_rows, "the comparison should not be empty"


def test_every_query_has_sql():
    assert set(REGISTRY) == set(oracles())
    assert set(REGISTRY) <= set(entry.queries()) and set(oracles()) <= set(entry.oracle_sql())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["scope", "window_start", "window_end"]
    assert df.count() > 0
