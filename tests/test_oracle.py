"""Every registered query against its SQL twin in DuckDB."""

import functools
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from haulscope.catalog import queries as catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    """The sweep shares one set of staged inputs; HAULSCOPE_SWEEP=fresh makes each query build its own."""
    with pytest.MonkeyPatch.context() as patch:
        if os.environ.get("HAULSCOPE_SWEEP") != "fresh":
            patch.setattr(catalog, "Run", functools.cache(catalog.Run))
        yield


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, DATA)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    for column, kind in df.dtypes:
        assert kind in TYPES and kinds[column] in (TYPES[kind], "STRING", "NUMBER"), (column, kind, kinds[column])
    assert rows_of(df.columns, df.collect()) == rows_of(names, expected)
