"""Every registered query of the library against its SQL."""

import math

import duckdb
import pytest
from callproof.plans import registry

QUERIES, SQL = registry.load()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        out.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return out


def plain(v):
    return None if v is None else round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    if name not in SQL:
        assert got
        return
    relation = con.sql(SQL[name])
    assert sorted(relation.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"select {names} from ({SQL[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=str)
