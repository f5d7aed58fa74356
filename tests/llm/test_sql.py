"""Queries of the corpus operators against their SQL twins in DuckDB."""

import duckdb
import pytest

from shutterloom.llm import registry

TABLES = ("documents", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = registry.queries()[name](spark, sf_dir)
    result = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(result.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
