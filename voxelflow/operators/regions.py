"""Measurements in regions of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import value_statistics
from .sampling import trilinear

EPSILON = 1e-9
METRICS = ("n_voxels", "std", "min", "max", "mean", "median")


def valid(rois: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """``rois`` with is_valid: corners inside the volume, and one z for a flat region."""
    inside = (F.col("mode") != "2d") | (F.col("sz") == F.col("ez"))
    for c, d in zip("zyx", dims, strict=True):
        for p in "se":
            inside = inside & F.col(f"{p}{c}").between(0, max(0, d - 1))
    return rois.withColumn("is_valid", F.coalesce(inside, F.lit(False)))


def region_voxels(rois: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """roi_order, z, y, x of each voxel in a rectangle, box, ellipse or ellipsoid.

    Voxel keys are generated from the bounding boxes, which bound their number,
    and meet the volume by an equi-join: no range join.
    """
    some = rois.where("shape <> 'line'")
    flat = F.col("mode") == "2d"
    for c, d in zip("zyx", dims, strict=True):
        low, high = F.least(f"s{c}", f"e{c}"), F.greatest(f"s{c}", f"e{c}")
        if c == "z":
            only = F.greatest(F.lit(0.0), F.least(F.lit(float(d - 1)), F.col("sz")))
            low, high = F.when(flat, only).otherwise(low), F.when(flat, only).otherwise(high)
        first, last = F.greatest(F.lit(0), F.ceil(low - EPSILON)), F.least(F.lit(d - 1), F.floor(high + EPSILON))
        keys = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        some = some.withColumn(c, F.explode(keys))
    total, exact = F.lit(0.0), F.lit(True)
    for c in "zyx":
        delta, radius = F.col(c) - (F.col(f"s{c}") + F.col(f"e{c}")) / 2, F.abs(F.col(f"e{c}") - F.col(f"s{c}")) / 2
        used = ~flat if c == "z" else F.lit(True)
        thin = radius <= EPSILON
        exact = exact & (~used | ~thin | (F.abs(delta) <= EPSILON))
        total = total + F.when(used & ~thin, delta * delta / (radius * radius)).otherwise(0.0)
    inside = (F.col("shape") == "rectangle") | (exact & (total <= 1 + EPSILON))
    return some.where(inside).select("roi_order", *(F.col(c).cast("int").alias(c) for c in "zyx"))


def line_points(rois: DataFrame) -> DataFrame:
    """Sample points of line regions, ends included: roi_order, step, pz, py, px."""
    lines = rois.where("shape = 'line'")
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    dz = F.when(F.col("mode") == "3d", F.col("ez") - F.col("sz")).otherwise(0.0)
    steps = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy + dz * dz)))
    out = lines.select("*", steps.alias("steps"), F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("step"))
    share = F.col("step") / F.col("steps")
    return out.select("roi_order", "step", (F.col("sz") + dz * share).alias("pz"), (F.col("sy") + dy * share).alias("py"), (F.col("sx") + dx * share).alias("px"))


def line_profile(voxels: DataFrame, rois: DataFrame, dims: tuple[int, int, int], t: int = 0) -> DataFrame:
    """roi_order, step and the interpolated value along each line."""
    points = line_points(rois).withColumn("point_id", F.shiftleft(F.col("roi_order").cast("long"), 32) + F.col("step")).withColumn("t", F.lit(t))
    return trilinear(voxels, points, dims).select(F.shiftright("point_id", 32).cast("int").alias("roi_order"), F.col("point_id").bitwiseAND((1 << 32) - 1).alias("step"), "value")


def measure(voxels: DataFrame, rois: DataFrame, dims: tuple[int, int, int], t: int = 0) -> DataFrame:
    """Count, population deviation, least, largest, mean and median of each region; all null where it is empty.

    Regions are a short list; their voxel keys are shuffled to the volume, or
    broadcast by the planner where they are few.  Medians are exact, and a region
    as large as the volume is many tasks.
    """
    picked = region_voxels(rois, dims).join(voxels.where(F.col("t") == t).select("z", "y", "x", "value"), ["z", "y", "x"]).select("roi_order", "value")
    values = picked.unionByName(line_profile(voxels.where(F.col("t") == t), rois, dims, t).select("roi_order", "value"))
    stats = value_statistics(values, "roi_order", "value").withColumnRenamed("n_values", "n_voxels")
    return rois.select("roi_order", "roi_name", "shape", "mode").join(stats, "roi_order", "left")


def snapshot(rois: DataFrame, channels: DataFrame) -> DataFrame:
    """Every region with every channel: the rows of a measurement table. Both are short lists."""
    return rois.select("roi_order", "roi_name").crossJoin(channels)


def formatted(value, decimals: int = 3):
    """A metric as text: N/A for null or what isn't finite."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, "N/A").otherwise(F.format_string(f"%.{decimals}f", value))
