"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from rowferry.queries import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(row):
    return tuple("NULL" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in row)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in result.description}
    assert columns == sorted(described)
    assert {c: TYPES[t] for c, t in df.dtypes} == described
    at = [list(described).index(c) for c in columns]
    expected = sorted(_key(row[i] for i in at) for row in result.fetchall())
    assert sorted(_key(row[c] for c in columns) for row in df.collect()) == expected
