"""Max pyramids of image stacks whose slices arrive as a stream, in any order and any batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROW = "scale int, t int, z int, gy int, gx int, width int, pixels array<int>"
#: The pixel of a place without a voxel. Codes aren't negative.
ABSENT = -1


def widened(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.pad(image, [(0, height - image.shape[0]), (0, width - image.shape[1])], constant_values=ABSENT)


def pooled(image: np.ndarray) -> np.ndarray:
    """The largest code of each two by two; an odd end stands alone."""
    padded = widened(image, *(n + n % 2 for n in image.shape))
    return padded.reshape(padded.shape[0] // 2, 2, padded.shape[1] // 2, 2).max((1, 3))


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The larger code at each place of two slices, of which one may end before the other."""
    shape = np.maximum(a.shape, b.shape)
    return np.maximum(widened(a, *shape), widened(b, *shape))


@dataclass
class Cascade:
    """One tile of a stack: at most one slice of each scale and pair waits, for its partner."""

    scales: int
    depth: int | None
    waiting: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    made: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def alone(self, scale: int, z: int) -> bool:
        return self.depth is not None and z % 2 == 0 and z == -(-self.depth // 2**scale) - 1

    def arrive(self, scale: int, z: int, image: np.ndarray) -> None:
        """The slice is a row of its scale; with its partner it is a slice of the next."""
        while True:
            self.made.append((scale, z, image))
            if scale + 1 == self.scales:
                return
            partner = self.waiting.pop((scale, z ^ 1), None)
            if partner is None and not self.alone(scale, z):
                self.waiting[scale, z] = image
                return
            scale, z, image = scale + 1, z // 2, pooled(image if partner is None else merged(image, partner))

    def flush(self) -> None:
        """What still waits has no partner."""
        for scale in range(self.scales - 1):
            for at in sorted(k for k in self.waiting if k[0] == scale):
                image = self.waiting.pop(at)
                self.arrive(scale + 1, at[1] // 2, pooled(image))


def pyramid(slices: DataFrame, scales: int, tile: int, depth: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """``slices`` (t, z, gy, gx, width, pixels row by row) to ``scales`` levels of slices, as ``bricks.pyramid`` has them.

    Slices come as tiles of ``tile`` by ``tile`` pixels, less at the far ends, with
    their place in the grid of tiles; a slice may end before the others, and
    ``ABSENT`` is a pixel without a voxel.  ``tile`` is a multiple of two for each
    level but the base, so tiles have no pixel in common at any level and are
    separate states.  Each slice comes once.

    ``depth`` is the number of slices: then the last slice of an odd level goes on
    by itself and a whole stack leaves no state.  Without it, or where slices are
    lost, what waits goes on without a partner when a tile had no slice for
    ``idle_ms``; a partner that comes later begins anew.
    """
    if tile % (1 << (scales - 1)):
        raise ValueError(f"tiles of {tile} pixels can't be halved {scales - 1} times")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cascade = Cascade(scales, depth, pickle.loads(state.get[0]) if state.exists else {})
        t, gy, gx = map(int, key)

        def made() -> pd.DataFrame:
            rows, cascade.made = cascade.made, []
            return pd.DataFrame([(s, t, z, gy, gx, i.shape[1], i.ravel().tolist()) for s, z, i in rows], columns=["scale", "t", "z", "gy", "gx", "width", "pixels"])

        if state.hasTimedOut:
            cascade.flush()
            yield made()
        for frame in frames:
            for z, width, pixels in zip(frame["z"], frame["width"], frame["pixels"], strict=True):
                cascade.arrive(0, int(z), np.asarray(pixels, np.int32).reshape(-1, int(width)))
            yield made()
        if cascade.waiting:
            state.update((pickle.dumps(cascade.waiting),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()

    timer = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return slices.groupBy("t", "gy", "gx").applyInPandasWithState(step, ROW, "waiting binary", "append", timer)


def tiles(codes: DataFrame, tile: int, depth: int | None = None) -> DataFrame:
    """A table of voxels (t, z, y, x, code) as the rows that ``pyramid`` takes; a tile is whole.

    With ``depth`` a tile that one of so many slices has no voxel of is there too,
    without voxels, so that none waits for it.
    """
    grid = lambda c: F.floor(F.col(c) / tile).cast("int")
    at = [F.pmod(F.col(c), F.lit(tile)).cast("int") for c in ("y", "x")]
    cells = codes.select("t", "z", grid("y").alias("gy"), grid("x").alias("gx"), *(a.alias(c) for a, c in zip(at, "yx", strict=True)), F.col("code").cast("int").alias("code"))
    if depth is not None:
        places = cells.select("t", "gy", "gx").distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
        empty = places.select("t", "z", "gy", "gx", F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(ABSENT).alias("code"))
        cells = cells.unionByName(empty)
    sized = cells.groupBy("t", "z", "gy", "gx").agg(
        (F.max("x") + 1).alias("width"),
        (F.max("y") + 1).alias("height"),
        F.array_sort(F.collect_list(F.struct("y", "x", "code"))).alias("cells"),
    )
    place = lambda c: c["y"] * F.col("width") + c["x"]
    cell = lambda k: F.get("cells", k)
    last = lambda c, k: F.when(place(cell(k + 1)) == place(c), F.lit(False)).otherwise(True)
    once = sized.withColumn("cells", F.filter("cells", last))  # of repeated voxels the largest, which is the last
    behind = lambda k: F.when(k > 0, place(cell(k - 1))).otherwise(-1)
    filled = F.flatten(F.transform("cells", lambda c, k: F.concat(F.array_repeat(F.lit(ABSENT), place(c) - behind(k) - 1), F.array(c["code"]))))
    size = F.col("width") * F.col("height")
    rest = F.array_repeat(F.lit(ABSENT), size - 1 - place(F.element_at("cells", -1)))
    whole = F.transform("cells", lambda c: c["code"])
    return once.select("t", "z", "gy", "gx", "width", F.when(F.size("cells") == size, whole).otherwise(F.concat(filled, rest)).alias("pixels"))


def voxels(rows: DataFrame, tile: int) -> DataFrame:
    """The slices of ``pyramid`` as voxels: scale, t, z, y, x, code."""
    side = F.expr(f"shiftright({tile}, scale)")
    cells = rows.select("scale", "t", "z", "width", (F.col("gy") * side).alias("y0"), (F.col("gx") * side).alias("x0"), F.posexplode("pixels").alias("i", "code")).where(F.col("code") != ABSENT)
    return cells.select("scale", "t", "z", (F.col("y0") + F.floor(F.col("i") / F.col("width"))).cast("int").alias("y"), (F.col("x0") + F.col("i") % F.col("width")).cast("int").alias("x"), "code")
