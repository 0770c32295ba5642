"""Brick addressing, pyramids and zone maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def brick_of(size: tuple[int, int, int]) -> list[Column]:
    return [F.floor(F.col(c) / n).cast("int").alias(f"g{c}") for c, n in zip(AXES, size, strict=True)]


def local_offset(size: tuple[int, int, int]) -> Column:
    """Row-major place of a voxel inside its brick."""
    z, y, x = (F.pmod(F.col(c), F.lit(n)) for c, n in zip(AXES, size, strict=True))
    return (z * size[1] + y) * size[2] + x


def grid_shape(dims: tuple[int, int, int], size: tuple[int, int, int]) -> tuple[int, int, int]:
    return tuple(max(1, -(-d // s)) for d, s in zip(dims, size, strict=True))  # type: ignore[return-value]


def address(voxels: DataFrame, dims: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Voxels with brick coordinates, flat brick index, local offset, and the coordinates found back from them."""
    grid = grid_shape(dims, size)
    out = voxels.select("t", *AXES, *brick_of(size), local_offset(size).alias("offset"))
    back = [
        (F.col("gz") * size[0] + F.floor(F.col("offset") / (size[1] * size[2]))).cast("int").alias("back_z"),
        (F.col("gy") * size[1] + F.pmod(F.floor(F.col("offset") / size[2]), F.lit(size[1]))).cast("int").alias("back_y"),
        (F.col("gx") * size[2] + F.pmod(F.col("offset"), F.lit(size[2]))).cast("int").alias("back_x"),
    ]
    return out.select("*", ((F.col("gz") * grid[1] + F.col("gy")) * grid[2] + F.col("gx")).alias("brick"), *back)


def pyramid_geometry(dims: tuple[int, int, int]) -> list[tuple[int, tuple[int, int, int], tuple[int, int, int]]]:
    """(level, factors, dims): every axis halves, rounded up, until all are one; an axis that is one keeps its factor."""
    levels, factor = [(0, (1, 1, 1), dims)], (1, 1, 1)
    while max(dims) > 1:
        halved = tuple(max(1, -(-d // 2)) for d in dims)
        factor = tuple(f * 2 if h < d else f for f, h, d in zip(factor, halved, dims, strict=True))
        dims = halved
        levels.append((levels[-1][0] + 1, factor, dims))
    return levels


def pool_max(codes: DataFrame, times: int = 1) -> DataFrame:
    """The largest code of each cell of two by two by two, ``times`` over.

    Halving twice is flooring by four: a level comes from the base in one
    shuffle, with partial maxima on the map side.
    """
    half = lambda c: F.shiftright(F.col(c), times).alias(c)
    return codes.groupBy("t", half("z"), half("y"), half("x")).agg(F.max("code").alias("code"))


def pyramid(codes: DataFrame, levels: int) -> DataFrame:
    """All levels of the max pyramid with their number; each comes from the one below, so that rows shrink by eight."""
    out = level = codes.select(F.lit(0).alias("scale"), "t", "z", "y", "x", "code")
    for k in range(1, levels):
        level = pool_max(level).select(F.lit(k).alias("scale"), "t", "z", "y", "x", "code")
        out = out.unionByName(level)
    return out


def brick_stats(codes: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Least and largest code, number and share of positive voxels of each brick."""
    return codes.groupBy("t", *brick_of(size)).agg(
        F.min("code").alias("vmin"),
        F.max("code").alias("vmax"),
        F.count("*").alias("n_voxels"),
        F.count_if(F.col("code") > 0).alias("n_occupied"),
        (F.count_if(F.col("code") > 0) / F.count("*")).alias("occupancy"),
    )


def zone_map(stats: DataFrame, levels: int) -> DataFrame:
    """The hierarchy over bricks: occupied is 255 or 0; only occupied children count upwards, a node without any is all zero."""
    used = F.col("vmax") > 0
    level = stats.select(F.lit(0).alias("level"), "t", "gz", "gy", "gx", F.when(used, 255).otherwise(0).alias("occ"), F.when(used, F.col("vmin")).otherwise(0).alias("vmin"), F.when(used, F.col("vmax")).otherwise(0).alias("vmax"))
    out = level
    for k in range(1, levels):
        half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("gz", "gy", "gx")]
        some = F.col("occ") > 0
        level = level.groupBy("t", *half).agg(F.max("occ").alias("occ"), F.coalesce(F.min(F.when(some, F.col("vmin"))), F.lit(0)).alias("vmin"), F.coalesce(F.max(F.when(some, F.col("vmax"))), F.lit(0)).alias("vmax"))
        level = level.select(F.lit(k).alias("level"), "t", "gz", "gy", "gx", "occ", "vmin", "vmax")
        out = out.unionByName(level)
    return out


def subcell_grid(size: tuple[int, int, int], most: int = 4) -> tuple[int, int, int]:
    return tuple(max(1, min(most, s)) for s in size)  # type: ignore[return-value]


def subcells(codes: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Occupancy and range of up to four by four by four parts of each brick."""
    grid = subcell_grid(size)
    cell = [F.least(F.lit(g - 1), F.floor(F.pmod(F.col(c), F.lit(s)) * g / s)).cast("int").alias(f"s{c}") for c, s, g in zip(AXES, size, grid, strict=True)]
    return codes.groupBy("t", *brick_of(size), *cell).agg(F.when(F.max("code") > 0, 255).otherwise(0).alias("occ"), F.min("code").alias("vmin"), F.max("code").alias("vmax"))


def page_table(stats: DataFrame, dims: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """brick, slot: occupied bricks of each timepoint numbered densely, -1 for empty ones.

    The window has a row for each brick of one timepoint.
    """
    grid = grid_shape(dims, size)
    flat = (F.col("gz") * grid[1] + F.col("gy")) * grid[2] + F.col("gx")
    used = (F.col("n_occupied") > 0).cast("int")
    run = F.sum(used).over(Window.partitionBy("t").orderBy("brick"))
    return stats.select("t", flat.alias("brick"), "n_occupied").select("t", "brick", F.when(used == 1, run - 1).otherwise(-1).alias("slot"))


def bricks_above(stats: DataFrame, threshold: int) -> DataFrame:
    """Bricks that can hold a voxel over the threshold; the others are skipped before their voxels are read."""
    return stats.where((F.col("n_occupied") > 0) & (F.col("vmax") > threshold))


def voxels_above(codes: DataFrame, stats: DataFrame, size: tuple[int, int, int], threshold: int) -> DataFrame:
    """Voxels over a threshold, by a semi-join with the zone map."""
    there = codes.select("*", *brick_of(size))
    return there.join(bricks_above(stats, threshold).select("t", "gz", "gy", "gx"), ["t", "gz", "gy", "gx"], "left_semi").where(F.col("code") > threshold).select("t", "z", "y", "x", "code")
