"""Every registered query of the retail model against its DuckDB form."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from cadencia.plans.queries import REGISTRY
from cadencia.sources.fixtures import Retail

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda row: tuple((v is None, str(v)) for v in row)
    return [names[i] for i in order], sorted((tuple(plain(row[i]) for i in order) for row in rows), key=key)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, sf_dir, name):
    run, oracle = REGISTRY[name]
    df = run(Retail(spark, sf_dir))
    got = table(df.columns, df.collect())
    if oracle is None:
        assert got[1], name
        return
    rel = duck.execute(oracle)
    assert got == table([d[0] for d in rel.description], rel.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
