"""Every catalog query against its SQL twin in DuckDB, and the driver contract."""

import decimal
import functools

import duckdb
import pytest

import __spark_entry__
from shutterloom.operators import learn
from shutterloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return None if v != v else round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf_dir, con, name):
    got = registry.queries()[name](spark, sf_dir)
    result = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_has_rows(spark, sf_dir, name, monkeypatch):
    """With a few trees a model: test_forests and test_tables hold the models themselves."""
    for job, options in (("train_personal", {"trees": 10}), ("uncertainty_ensemble", {"members": 5, "trees": 3}), ("validate", {"trees": 3})):
        monkeypatch.setattr(learn, job, functools.partial(getattr(learn, job), **options))
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
