"""Queries that measure regions of interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions
from ..sources.adapters import HEIGHT, WIDTH, depth, rois, table, voxels, with_tables
from .registry import query, rounded

ROI = with_tables("vox", "roi")
DEPTH = "(SELECT max(vec_id) // 25 + 1 FROM embeddings)"
PICK = """box AS (SELECT *, least(sx, ex) AS ax, greatest(sx, ex) AS bx, least(sy, ey) AS ay, greatest(sy, ey) AS by_, CASE WHEN mode = '2d' THEN sz ELSE least(sz, ez) END AS az, CASE WHEN mode = '2d' THEN sz ELSE greatest(sz, ez) END AS bz FROM roi WHERE shape <> 'line'),
    raw AS (SELECT roi_order, shape, mode, z, y, x, value, x - (sx + ex) / 2 AS dx, abs(ex - sx) / 2 AS rx, y - (sy + ey) / 2 AS dy, abs(ey - sy) / 2 AS ry, CASE WHEN mode = '2d' THEN 0 ELSE z - (sz + ez) / 2 END AS dz, CASE WHEN mode = '2d' THEN 0 ELSE abs(ez - sz) / 2 END AS rz
        FROM box JOIN vox ON x BETWEEN ax AND bx AND y BETWEEN ay AND by_ AND z BETWEEN az AND bz),
    pick AS (SELECT roi_order, z, y, x, value FROM raw WHERE shape = 'rectangle' OR
        (CASE WHEN rx > 1e-9 THEN dx * dx / (rx * rx) ELSE 0 END + CASE WHEN ry > 1e-9 THEN dy * dy / (ry * ry) ELSE 0 END + CASE WHEN rz > 1e-9 THEN dz * dz / (rz * rz) ELSE 0 END <= 1 + 1e-9))"""
LINE = f"""ln AS (SELECT *, CASE WHEN mode = '3d' THEN ez - sz ELSE 0 END AS dz, greatest(1, ceil(sqrt((ex - sx) ^ 2 + (ey - sy) ^ 2 + CASE WHEN mode = '3d' THEN (ez - sz) ^ 2 ELSE 0 END)))::BIGINT AS steps FROM roi WHERE shape = 'line'),
    lp AS (SELECT roi_order, step, sz + dz * (step / steps) AS pz, sy + (ey - sy) * (step / steps) AS py, sx + (ex - sx) * (step / steps) AS px FROM (SELECT *, unnest(range(steps + 1)) AS step FROM ln)),
    n AS (SELECT roi_order, step, least(floor(pz) + k // 4, {DEPTH} - 1)::INT AS z, least(floor(py) + k // 2 % 2, 24)::INT AS y, least(floor(px) + k % 2, 63)::INT AS x,
        (CASE WHEN k // 4 = 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END) * (CASE WHEN k // 2 % 2 = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN k % 2 = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w
        FROM lp, (SELECT unnest(range(8)) AS k)),
    prof AS (SELECT roi_order, step, sum(w * value) AS value FROM n JOIN vox USING (z, y, x) GROUP BY roi_order, step)"""
MEASURE = f"""{ROI}, {PICK}, {LINE}, every AS (SELECT roi_order, value FROM pick UNION ALL SELECT roi_order, value FROM prof),
    mea AS (SELECT roi_order, roi_name, shape, mode, n_voxels, std, "min", "max", mean, median FROM roi LEFT JOIN (SELECT roi_order, count(*) AS n_voxels, stddev_pop(value) AS std, min(value) AS "min", max(value) AS "max", avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM every GROUP BY roi_order) USING (roi_order))"""


def dims(spark, d):
    return depth(spark, d), HEIGHT, WIDTH


def measured(spark, d):
    return regions.measure(voxels(spark, d), rois(spark, d), dims(spark, d))


@query("roi_voxels", f"{ROI}, {PICK} SELECT roi_order, z, y, x FROM pick")
def roi_voxels(spark, d):
    return regions.region_voxels(rois(spark, d), dims(spark, d))


@query("roi_line_profile", f"{ROI}, {LINE} SELECT roi_order, step, round(value, 6) AS value FROM prof")
def roi_line_profile(spark, d):
    return rounded(regions.line_profile(voxels(spark, d), rois(spark, d), dims(spark, d)), "value")


@query("roi_measurements", f"""{MEASURE} SELECT roi_order, roi_name, shape, mode, n_voxels, round(std, 6) AS std, round("min", 6) AS "min", round("max", 6) AS "max", round(mean, 6) AS mean, round(median, 6) AS median FROM mea""")
def roi_measurements(spark, d):
    return rounded(measured(spark, d), "std", "min", "max", "mean", "median")


@query("roi_table_text", f"""{MEASURE} SELECT roi_order, coalesce(n_voxels::VARCHAR, 'N/A') AS n_voxels, CASE WHEN n_voxels IS NULL THEN 'N/A' ELSE printf('%.2f', "min") END AS "min", CASE WHEN n_voxels IS NULL THEN 'N/A' ELSE printf('%.2f', "max") END AS "max" FROM mea""")
def roi_table_text(spark, d):
    return measured(spark, d).select("roi_order", F.coalesce(F.col("n_voxels").cast("string"), F.lit("N/A")).alias("n_voxels"), *(regions.formatted(F.col(c), 2).alias(c) for c in ("min", "max")))


@query("roi_channel_snapshot", f"{ROI} SELECT roi_order, roi_name, r_regionkey AS channel_id, r_name AS channel_name FROM roi, region")
def roi_channel_snapshot(spark, d):
    c = table(spark, d, "region").select(F.col("r_regionkey").alias("channel_id"), F.col("r_name").alias("channel_name"))
    return regions.snapshot(rois(spark, d), c)


@query("roi_validity", f"{ROI} SELECT roi_order, (mode <> '2d' OR sz = ez) AND sx BETWEEN 0 AND 49 AND ex BETWEEN 0 AND 49 AND sy BETWEEN 0 AND 24 AND ey BETWEEN 0 AND 24 AND sz BETWEEN 0 AND 19 AND ez BETWEEN 0 AND 19 AS is_valid FROM roi")
def roi_validity(spark, d):
    return regions.valid(rois(spark, d), (20, 25, 50)).select("roi_order", "is_valid")
