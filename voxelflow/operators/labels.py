"""Sparse label fields: statistics, pyramids, brick directory, slices, lookups and edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from .bricks import AXES, brick_of, local_offset

EMPTY = 0
#: Fixed values of payload sizes: header bytes, and bytes for an offset, a label and a run.
HEADER, OFFSET_BYTES, LABEL_BYTES, RUN_BYTES = 16, 2, 4, 16


def lenient_label(value: Column) -> Column:
    """Zero for what is not finite or not positive, else rounded; over 65535 is an error."""
    rounded = half_up(value)
    bad = F.raise_error(F.concat(F.lit("label over 65535: "), rounded.cast("string"))).cast("long")
    return F.when(F.isnan(value) | (value <= 0) | (value == float("inf")), 0).when(rounded > 65535, bad).otherwise(rounded).cast("long")


def strict_label(value: Column) -> Column:
    """A whole number from 0 to 2^32 - 1; anything else is an error."""
    ok = ~F.isnan(value) & (value >= 0) & (value <= 0xFFFFFFFF) & (value == F.floor(value))
    return F.when(ok, value.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no 32-bit label: "), value.cast("string"))).cast("long"))


def label_stats(labels: DataFrame) -> DataFrame:
    """One row a label: voxels, bounds, centroid, first and last timepoint; sums combine on the map side."""
    n = F.count("*")
    return labels.where("label <> 0").groupBy("label").agg(
        n.alias("n_voxels"),
        *(f(c).alias(f"{name}_{c}") for c in AXES for name, f in (("min", F.min), ("max", F.max))),
        *((F.sum(F.col(c).cast("long")) / n).alias(f"centroid_{c}") for c in AXES),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
    )


def downsample_sparse(labels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """The label of most of a cell's voxels: absent voxels vote for empty, which loses ties; then the smaller label wins."""
    half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in AXES]
    votes = labels.where("label <> 0").groupBy("t", *half, "label").agg(F.count("*").alias("n"))
    valid = F.lit(1)
    for c, d in zip(AXES, dims, strict=True):
        valid = valid * F.least(F.lit(2), F.lit(d) - F.col(c) * 2)
    best = votes.groupBy("t", *AXES).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.max("n").alias("n"), F.sum("n").alias("filled"))
    return best.where(F.col("n") >= valid - F.col("filled")).select("t", *AXES, "label")


def downsample_dense(labels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """The dense rule: empty is a label like others, and the larger label wins ties."""
    half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in AXES]
    votes = labels.where("label <> 0").groupBy("t", *half, "label").agg(F.count("*").alias("n"))
    valid = F.lit(1)
    for c, d in zip(AXES, dims, strict=True):
        valid = valid * F.least(F.lit(2), F.lit(d) - F.col(c) * 2)
    best = votes.groupBy("t", *AXES).agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("n"), F.sum("n").alias("filled"))
    return best.where(F.col("n") >= valid - F.col("filled")).select("t", *AXES, "label")


def brick_directory(labels: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """One row a brick with foreground: local bounds, counts, label range and the smallest of four encodings.

    Runs are islands of one label along x.
    """
    capacity = size[0] * size[1] * size[2]
    inside = labels.where("label <> 0").select("t", *AXES, "label", *brick_of(size), local_offset(size).alias("offset"), *(F.pmod(F.col(c), F.lit(s)).alias(f"l{c}") for c, s in zip(AXES, size, strict=True)))
    row = Window.partitionBy("t", "gz", "gy", "gx", "lz", "ly").orderBy("lx")
    start = F.coalesce((F.lag("lx").over(row) != F.col("lx") - 1) | (F.lag("label").over(row) != F.col("label")), F.lit(True))
    n, runs = F.col("n_voxels"), F.col("n_runs")
    sizes = {
        "coord-list": HEADER + (OFFSET_BYTES + LABEL_BYTES) * n,
        "x-run": HEADER + RUN_BYTES * runs,
        "bitmask": HEADER + -(-capacity // 8) + LABEL_BYTES * n,
        "dense": F.lit(HEADER + LABEL_BYTES * capacity).cast("long"),
    }
    best = F.array_min(F.array(*(F.struct(s.alias("bytes"), F.lit(i).alias("place"), F.lit(name).alias("codec")) for i, (name, s) in enumerate(sizes.items()))))
    found = inside.withColumn("start", start).groupBy("t", "gz", "gy", "gx").agg(
        F.count("*").alias("n_voxels"),
        F.count_if("start").alias("n_runs"),
        F.min("label").alias("label_min"),
        F.max("label").alias("label_max"),
        *(f(f"l{c}").alias(f"{name}_{c}") for c in AXES for name, f in (("min", F.min), ("max", F.max))),
    )
    return found.withColumn("best", best).select("*", F.col("best.codec").alias("codec"), F.col("best.bytes").alias("n_bytes")).drop("best")


def occupancy(labels: DataFrame, size: tuple[int, int, int], levels: int) -> DataFrame:
    """Bricks with foreground, and their parents up to the given number of levels."""
    level = labels.where("label <> 0").select("t", *brick_of(size)).distinct()
    out = level.select(F.lit(0).alias("level"), "*")
    for k in range(1, levels):
        level = level.select("t", *(F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("gz", "gy", "gx"))).distinct()
        out = out.unionByName(level.select(F.lit(k).alias("level"), "*"))
    return out


def label_at(labels: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (t, z, y, x and more) with the label there; zero where there is none."""
    there = labels.select("t", *AXES, "label")
    return points.join(there, ["t", *AXES], "left").withColumn("label", F.coalesce("label", F.lit(EMPTY)))


def label_color(label: Column, seed: int) -> list[Column]:
    """Red, green and blue of a label: a byte hash gives the hue, at saturation 0.78 and value 1."""
    hash_ = F.lit(17).cast("long")
    for value in (label, F.lit(seed).cast("long")):
        for shift in (0, 8, 16, 24):
            hash_ = (hash_ * 131 + F.shiftright(value, shift).bitwiseAND(255)) % 65521
    sector = hash_ / F.lit(65521.0) * 6
    chroma = 0.78
    middle = chroma * (1 - F.abs(sector % 2 - 1))
    k = F.floor(sector)
    parts = [
        F.when(k.isin(0, 5), chroma).when(k.isin(1, 4), middle).otherwise(0.0),
        F.when(k.isin(1, 2), chroma).when(k.isin(0, 3), middle).otherwise(0.0),
        F.when(k.isin(3, 4), chroma).when(k.isin(2, 5), middle).otherwise(0.0),
    ]
    return [F.when(label == 0, 0).otherwise(half_up((p + 1 - chroma) * 255)).cast("int").alias(c) for p, c in zip(parts, ("red", "green", "blue"), strict=True)]


def slice_of(labels: DataFrame, axis: str, index: int, seed: int = 0) -> DataFrame:
    """A slice across one axis: its two other axes, the label and its colour. The filter reaches the scan."""
    rest = [c for c in AXES if c != axis]
    return labels.where((F.col(axis) == index) & (F.col("label") != 0)).select("t", F.col(rest[0]).alias("v"), F.col(rest[1]).alias("u"), "label", *label_color(F.col("label"), seed))


def bricks_on_slice(directory: DataFrame, axis: str, index: int, size: tuple[int, int, int]) -> DataFrame:
    """Directory rows whose foreground reaches the slice."""
    s = size[AXES.index(axis)]
    local = F.lit(index) - F.col(f"g{axis}") * s
    return directory.where((F.col(f"g{axis}") == index // s) & local.between(F.col(f"min_{axis}"), F.col(f"max_{axis}")))


def latest(base: DataFrame, edits: DataFrame) -> DataFrame:
    """The base with an append-only edit log (t, z, y, x, label, seq) applied: the last edit of a voxel holds; label 0 erases."""
    last = edits.groupBy("t", *AXES).agg(F.max_by("label", "seq").alias("edit"))
    both = base.join(last, ["t", *AXES], "full").select("t", *AXES, F.coalesce("edit", "label").alias("label"))
    return both.where("label <> 0")


def undone(edits: DataFrame, steps: int) -> DataFrame:
    """The edit log without its last strokes; ``stroke`` numbers them."""
    top = edits.agg(F.max("stroke").alias("top"))
    return edits.join(F.broadcast(top)).where(F.col("stroke") <= F.col("top") - steps).drop("top")


def applied(log: DataFrame, by: str) -> DataFrame:
    """The strokes that hold at the end of an ordered log of strokes, undos and redos: ``by``, stroke and their order, depth.

    ``log`` has ``by``, seq and op ('stroke', 'undo' or 'redo'; others do nothing).
    An undo takes back the last stroke that holds, a redo brings back the last one
    taken, and a stroke after an undo ends what could be redone; undo or redo with
    nothing to do does nothing.  A log has a row for each stroke of its document,
    not for each voxel, and is folded in one task; documents are many tasks.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        strokes, held = [], 0
        for seq, op in frame.sort_values("seq")[["seq", "op"]].itertuples(index=False):
            if op == "stroke":
                strokes[held:] = [seq]
                held += 1
            elif op == "undo":
                held = max(0, held - 1)
            elif op == "redo":
                held = min(len(strokes), held + 1)
        return pd.DataFrame({by: frame[by].iloc[:1].repeat(held).to_numpy(), "stroke": strokes[:held], "depth": range(1, held + 1)})

    kind = dict(log.dtypes)[by]
    return log.select(by, "seq", "op").groupBy(by).applyInPandas(fold, f"{by} {kind}, stroke long, depth long")


def without_label(labels: DataFrame, label: int) -> DataFrame:
    """The field after a label is deleted: higher labels move down by one."""
    moved = F.when(F.col("label") > label, F.col("label") - 1).otherwise(F.col("label"))
    return labels.where(F.col("label") != label).select("t", *AXES, moved.alias("label"))
