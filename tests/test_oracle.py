"""Every query that has SQL gives what DuckDB gives on the same tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from corvane.plans.catalogue import ORACLE, QUERIES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(*cols).collect()]
    rel = duck.sql(ORACLE[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_every_query_runs(spark, sf_dir):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, sf_dir).count() > 0, name


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(ORACLE) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() == 1
