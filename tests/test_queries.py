"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from voxelflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*names).collect()]
    sql = registry.ORACLE_SQL.get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    rows = [tuple(map(plain, r)) for r in duck.sql(f"SELECT {quoted} FROM ({sql})").fetchall()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_entry(spark):
    assert entry.entry(spark).columns == ["roi_order", "roi_name", "shape", "mode", "n_voxels", "std", "min", "max", "mean", "median"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
