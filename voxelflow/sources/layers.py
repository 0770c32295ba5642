"""A volume layer on disk with its statistics, and readers that skip bricks by them.

A layer is a folder of five tables: the voxels, in folders by timepoint, brick
slab and block of bricks; a row for each brick with its range and occupancy;
a row for each column of bricks with its number of rays; a histogram of each
timepoint; and the hierarchy over the bricks.  The source is read once, all
statistics come from what was stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bricks, intensity
from ..streaming.run import shared_folder

#: Bricks along y and x whose voxels share a folder.
BLOCK = 8
COLUMN = ("t", "gy", "gx")
BRICK = ("t", "gz", "gy", "gx")
#: What is stored; stated, as a layer without voxels has no files.
VOXELS = "z int, y int, x int, code int, gy int, gx int, t int, gz int, block string"


def _block():
    return F.concat_ws("-", F.floor(F.col("gy") / BLOCK).cast("string"), F.floor(F.col("gx") / BLOCK).cast("string"))


def write_layer(codes: DataFrame, path: str, size: tuple[int, int, int], top: int = 255, levels: int = 4) -> Layer:
    """``codes`` (t, z, y, x, code) as a layer of bricks of ``size`` voxels; an existing one is replaced."""
    placed = codes.select(*(F.col(c).cast("int") for c in ("t", "z", "y", "x", "code")))
    dealt = placed.select("*", *bricks.brick_of(size)).withColumn("block", _block())
    dealt.repartition("t", "gz", "block").sortWithinPartitions("t", "gz", "block", "gy", "gx", "z", "y", "x").write.mode("overwrite").partitionBy("t", "gz", "block").parquet(f"{path}/voxels")
    layer = Layer(codes.sparkSession, path)
    stored = layer.voxels()
    bricks.brick_stats(stored, size).write.mode("overwrite").parquet(f"{path}/bricks")
    rays = stored.groupBy(*COLUMN, "y", "x").agg(F.lit(1).alias("one"))
    rays.groupBy(*COLUMN).agg(F.count("*").alias("n_rays")).write.mode("overwrite").parquet(f"{path}/columns")
    intensity.histogram(stored, top, "t").write.mode("overwrite").parquet(f"{path}/histogram")
    bricks.zone_map(layer.table("bricks"), levels).write.mode("overwrite").parquet(f"{path}/hierarchy")
    return layer


class Layer:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        #: Bricks that the last projection has opened, by round.
        self.opened: list[int] = []

    def table(self, name: str) -> DataFrame:
        """voxels, bricks, columns, histogram or hierarchy."""
        return self.spark.read.parquet(f"{self.path}/{name}")

    def voxels(self) -> DataFrame:
        return self.spark.read.schema(VOXELS).parquet(f"{self.path}/voxels")

    def inside(self, some: DataFrame) -> DataFrame:
        """Voxels of some bricks; where the bricks are few, only the folders that hold them are read."""
        keys = some.select(*BRICK).withColumn("block", _block())
        return self.voxels().join(keys, ["t", "gz", "block", "gy", "gx"], "left_semi")

    def above(self, threshold: int) -> DataFrame:
        """t, z, y, x, code of voxels over a threshold, from the bricks that can hold any."""
        return self.inside(bricks.bricks_above(self.table("bricks"), threshold)).where(F.col("code") > threshold).select("t", "z", "y", "x", "code")

    def project_max(self) -> DataFrame:
        """t, y, x, code: the largest code of each ray along z, best bound first.

        Bricks of a column are opened from the largest ``vmax`` on, in rounds of one,
        two, four and so on.  After a round every brick whose ``vmax`` is no more than
        the least maximum of its column's rays so far is dropped: it can raise none of
        them.  The bound counts once all rays of the column have a voxel.
        """
        folder = shared_folder(self.spark, "projection")
        rank = F.row_number().over(Window.partitionBy(*COLUMN).orderBy(F.desc("vmax"), "gz")) - 1  # bricks of one column
        left = self.table("bricks").select(*BRICK, "vmax").withColumn("rank", rank)
        self.opened, done, best = [], 0, None
        while True:
            upto = 2 * done + 1
            left = self._kept(left, f"{folder}/left{done}")
            now = left.where(F.col("rank") < upto)
            if not (n := now.count()):
                break
            self.opened.append(n)
            found = self.inside(now).groupBy(*COLUMN, "y", "x").agg(F.max("code").alias("code"))
            if best is not None:
                found = best.unionByName(found).groupBy(*COLUMN, "y", "x").agg(F.max("code").alias("code"))
            best = self._kept(found, f"{folder}/best{done}")
            bounds = best.groupBy(*COLUMN).agg(F.min("code").alias("low"), F.count("*").alias("seen")).join(self.table("columns"), list(COLUMN)).where("seen = n_rays").select(*COLUMN, "low")
            left = left.where(F.col("rank") >= upto).join(bounds, list(COLUMN), "left").where("low is null or vmax > low")
            again = F.row_number().over(Window.partitionBy(*COLUMN).orderBy("rank")) - 1 + upto  # what was dropped leaves no gap
            left = left.select(*BRICK, "vmax", again.alias("rank"))
            done = upto
        return best.select("t", "y", "x", "code") if best is not None else self.voxels().select("t", "y", "x", "code").limit(0)

    def _kept(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
