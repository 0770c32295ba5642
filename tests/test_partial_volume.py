"""Queries over a volume whose last slice ends early, and events without a value, against their SQL."""

import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import TABLES, plain
from voxelflow.plans import registry


@pytest.fixture(scope="module")
def odd_dir(sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        shutil.copy(f"{sf_dir}/{t}.parquet", folder)
    duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/embeddings.parquet' WHERE vec_id < 437) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value END AS value) FROM '{sf_dir}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def check(spark, odd_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, odd_dir)
    names = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*names).collect()]
    quoted = ", ".join(f'"{n}"' for n in names)
    want = [tuple(map(plain, r)) for r in duck.sql(f"SELECT {quoted} FROM ({registry.ORACLE_SQL[name]})").fetchall()]
    assert want and sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["stream_pyramid", "exported_codes", "intensity_texts", "resample_linear", "resample_nearest", "trilinear_samples", "nearest_samples", "brick_samples", "hover_layers"])
def test_query_on_odd_tables(spark, odd_dir, name):
    check(spark, odd_dir, name)
