"""Domain tables derived from the general-purpose test tables.

``embeddings`` becomes a float volume 64 x 25 x D, ``lineitem`` a sparse label
field, ``events`` track rows and an edit log, ``nation`` regions of interest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 64, 25
LABEL_DIMS = (7, 64, 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, z, y, x, value: one float channel."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "value"))
    return rows.select(
        F.lit(0).alias("t"),
        F.expr("cast(vec_id div 25 as int)").alias("z"),
        F.expr("cast(vec_id % 25 as int)").alias("y"),
        "x",
        F.col("value").cast("double").alias("value"),
    )


def depth(spark: SparkSession, sf_dir: str) -> int:
    """Slices of the float volume, from the parquet statistics of one column."""
    return table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] // HEIGHT + 1


def label_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, z, y, x, label: the largest label of each voxel."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.year("l_shipdate") - 1995).alias("t"),
        (F.col("l_linenumber") - 1).alias("z"),
        F.expr("cast(l_suppkey % 64 as int)").alias("y"),
        F.expr("cast(l_partkey % 64 as int)").alias("x"),
        (F.col("l_orderkey") % 50 + 1).alias("label"),
    )
    return rows.groupBy("t", "z", "y", "x").agg(F.max("label").alias("label"))


def track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed track rows in file order; breaks have no coordinates."""
    e = table(spark, sf_dir, "events").select("*", (F.col("event_type") == "error").alias("is_break"))
    hours = F.expr("cast(floor((unix_micros(cast(ts as timestamp)) - 1704067200000000) / 3600000000D) as double)")
    point = lambda c: F.when(~F.col("is_break"), c)
    return e.select(
        F.col("event_id").alias("row_idx"),
        F.col("user_id").alias("source_track_id"),
        "is_break",
        point(hours).alias("time"),
        point((F.col("event_id") % 97).cast("double")).alias("x"),
        point((F.col("event_id") % 89).cast("double")).alias("y"),
        point((F.col("event_id") % 31).cast("double")).alias("z"),
        point(F.col("value")).alias("amplitude"),
    )


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi_order, roi_name, shape, mode and integer corners inside 64 x 25 x 20."""
    k = F.col("n_nationkey")
    start = lambda m, n: (k * m % n).cast("double")
    return table(spark, sf_dir, "nation").select(
        k.alias("roi_order"),
        F.col("n_name").alias("roi_name"),
        F.element_at(F.array(*map(F.lit, ("line", "rectangle", "ellipse"))), k % 3 + 1).alias("shape"),
        F.when(k % 2 == 0, "2d").otherwise("3d").alias("mode"),
        start(7, 64).alias("sx"),
        start(5, 25).alias("sy"),
        start(3, 20).alias("sz"),
        ((k * 7 % 64 + k % 13) % 64).cast("double").alias("ex"),
        ((k * 5 % 25 + k % 7) % 25).cast("double").alias("ey"),
        F.when(k % 2 == 0, start(3, 20)).otherwise((k * 3 % 20 + k % 5) % 20).cast("double").alias("ez"),
    )


#: The same tables in DuckDB SQL, as common table expressions.
SQL = {
    "vox": """vox AS (SELECT 0::INT AS t, (vec_id // 25)::INT AS z, (vec_id % 25)::INT AS y, (i - 1)::INT AS x, embedding[i]::DOUBLE AS value
        FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))""",
    "lab": """lab AS (SELECT (year(l_shipdate) - 1995)::INT AS t, (l_linenumber - 1)::INT AS z, (l_suppkey % 64)::INT AS y, (l_partkey % 64)::INT AS x,
        max(l_orderkey % 50 + 1)::BIGINT AS label FROM lineitem GROUP BY 1, 2, 3, 4)""",
    "trk": """trk AS (SELECT event_id AS row_idx, user_id AS source_track_id, event_type = 'error' AS is_break,
        CASE WHEN event_type <> 'error' THEN floor((epoch_us(ts) - 1704067200000000) / 3600000000.0)::DOUBLE END AS time,
        CASE WHEN event_type <> 'error' THEN (event_id % 97)::DOUBLE END AS x, CASE WHEN event_type <> 'error' THEN (event_id % 89)::DOUBLE END AS y,
        CASE WHEN event_type <> 'error' THEN (event_id % 31)::DOUBLE END AS z, CASE WHEN event_type <> 'error' THEN value END AS amplitude FROM events)""",
    "roi": """roi AS (SELECT n_nationkey AS roi_order, n_name AS roi_name, ['line', 'rectangle', 'ellipse'][n_nationkey % 3 + 1] AS shape,
        CASE WHEN n_nationkey % 2 = 0 THEN '2d' ELSE '3d' END AS mode,
        (n_nationkey * 7 % 64)::DOUBLE AS sx, (n_nationkey * 5 % 25)::DOUBLE AS sy, (n_nationkey * 3 % 20)::DOUBLE AS sz,
        ((n_nationkey * 7 % 64 + n_nationkey % 13) % 64)::DOUBLE AS ex, ((n_nationkey * 5 % 25 + n_nationkey % 7) % 25)::DOUBLE AS ey,
        CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey * 3 % 20)::DOUBLE ELSE ((n_nationkey * 3 % 20 + n_nationkey % 5) % 20)::DOUBLE END AS ez FROM nation)""",
}
SQL["cod"] = """par AS (SELECT min(value) AS lo, CASE WHEN max(value) = min(value) THEN min(value) + 1 ELSE max(value) END AS hi FROM vox WHERE t = 0 AND NOT isnan(value)),
    cod AS (SELECT t, z, y, x, floor(greatest(0.0, least(1.0, (value - lo) / (hi - lo))) * 255 + 0.5)::INT AS code FROM vox, par)"""


def with_tables(*names: str) -> str:
    return "WITH " + ",\n    ".join(SQL[n] for n in names)
