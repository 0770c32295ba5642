"""Streams over the test tables, run to their end; their SQL is the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intensity
from ..plans.registry import query, rounded
from ..sources import adapters
from . import layer_sink, operators, pyramid, run, statistics


def _events(spark, d):
    return run.events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_label_counts", "SELECT event_id % 50 + 1 AS label, count(*) AS n_rows, min(event_id % 7) AS first_t, max(event_id % 7) AS last_t, sum(event_id % 64)::BIGINT AS sum_x FROM events GROUP BY 1")
def stream_label_counts(spark, d):
    e = F.col("event_id")
    rows = _events(spark, d).select((e % 50 + 1).alias("label"), (e % 7).alias("t"), (e % 64).alias("x"))
    return run.drained(operators.label_counts(rows), "complete", "label-counts")


@query("stream_tumbling", "SELECT date_trunc('day', ts)::VARCHAR AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = run.drained(operators.tumbling(_events(spark, d)), "complete", "tumbling")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", "SELECT (date_trunc('day', ts) - to_days(k::INT))::VARCHAR AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def stream_sliding(spark, d):
    out = run.drained(operators.sliding(_events(spark, d)), "complete", "sliding")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query(
    "stream_sessions",
    """WITH l AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, d):
    out = run.drained(operators.sessions(_events(spark, d)), "complete", "sessions")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


@query(
    "stream_slice_pairs",
    """WITH s AS (SELECT event_id AS z, (event_id * 31 % 251)::INT AS best FROM events) SELECT (z // 2)::INT AS pair, max(best) AS best FROM s GROUP BY z // 2 HAVING count(*) = 2""",
)
def stream_slice_pairs(spark, d):
    e = F.col("event_id")
    return run.drained(operators.slice_pairs(_events(spark, d).select(e.cast("int").alias("z"), (e * 31 % 251).cast("int").alias("best"))), "append", "slice-pairs")


@query("stream_statistics", "SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_statistics(spark, d):
    return statistics.drained(_events(spark, d), "event_type", "value").withColumn("total", F.round("total", 4))


@query("stream_pyramid", f"{adapters.with_tables('vox', 'cod')} SELECT s::INT AS scale, t, (z >> s)::INT AS z, (y >> s)::INT AS y, (x >> s)::INT AS x, max(code) AS code FROM cod, (SELECT unnest(range(4))::INT AS s) GROUP BY ALL")
def stream_pyramid(spark, d):
    """The volume's slices as a stream of files; whole stacks leave no state."""
    folder = run.shared_folder(spark, "slices")
    depth = adapters.depth(spark, d)
    pyramid.tiles(intensity.normalize(adapters.voxels(spark, d)), 16, depth).write.mode("overwrite").parquet(f"{folder}/slices.parquet")
    slices = run.table_stream(spark, folder, "slices", spark.read.parquet(f"{folder}/slices.parquet").schema)
    return pyramid.voxels(run.drained(pyramid.pyramid(slices, 4, 16, depth), "append", "pyramid"), 16)


@query("stream_layer", f"{adapters.with_tables('vox', 'cod')} SELECT t, (z // 8)::INT AS gz, (y // 8)::INT AS gy, (x // 16)::INT AS gx, min(code) AS vmin, max(code) AS vmax, count(*) AS n_voxels FROM cod GROUP BY ALL")
def stream_layer(spark, d):
    """The volume's slices as a stream of files that becomes a layer; its brick statistics."""
    folder = run.shared_folder(spark, "arrivals")
    intensity.normalize(adapters.voxels(spark, d)).write.mode("overwrite").parquet(f"{folder}/slices.parquet")
    slices = run.table_stream(spark, folder, "slices", layer_sink.VOXELS)
    layer = layer_sink.LayerSink(spark, f"{folder}/layer", (8, 8, 16)).drain(slices, f"{folder}/state")
    return layer.table("bricks").select("t", "gz", "gy", "gx", "vmin", "vmax", "n_voxels")
