"""Every query that has SQL beside it gives the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tamis.plans import registry

NAMES = sorted(set(registry.QUERIES) & set(registry.SQL))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.6g}")
        return v if v is None or isinstance(v, (str, bool)) else float(f"{float(v):.6g}")

    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, data, duck, name):
    got = registry.QUERIES[name](spark, data)
    want = duck.execute(registry.SQL[name])
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


def test_contract(spark, data):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["snapshot_id", "entity_id", "change_kind"]
    assert registry.QUERIES["screen_batch"](spark, data).where("decision = 'ALERT' and score < 75").count() == 0
