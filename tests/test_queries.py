"""Every registered query of the library against its DuckDB equivalent on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import columns, grouping, linking, matching, registry, retrieving  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(names, found):
    return sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        assert got
        return
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert got == rows(want.columns, want.fetchall())
