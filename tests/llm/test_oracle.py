"""Every llm query with SQL against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pytest

from rillwork.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        duck.execute(f"create view {path.stem} as select * from '{path}'")
    got = queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(oracle_sql()[name])
    assert sorted(want.columns) == names
    key = lambda row: [(v is not None, str(v)) for v in row]
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=key)
    assert rows == sorted(want.select(*[f'"{n}"' for n in names]).fetchall(), key=key)
    assert rows
