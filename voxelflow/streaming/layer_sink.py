"""A volume layer whose slices arrive as a stream.

Each batch is written to a folder of its own, by its number, so a batch that runs
again replaces itself.  What has arrived becomes a layer with its statistics when
the stream has ended, or at any time before; a slice that arrived in several
batches is the one of the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import layers

VOXELS = "t int, z int, y int, x int, code int"


class LayerSink:
    def __init__(self, spark: SparkSession, path: str, size: tuple[int, int, int], top: int = 255, levels: int = 4):
        self.spark, self.path, self.size, self.top, self.levels = spark, path.rstrip("/"), size, top, levels
        self.arrived = f"{self.path}/arrived"

    def add(self, rows: DataFrame, batch: int) -> None:
        """Voxels (t, z, y, x, code) of whole slices; those without a place or a code are not stored."""
        kept = rows.select(*(F.col(n).cast("int") for n in ("t", "z", "y", "x", "code"))).dropna()
        kept.write.mode("overwrite").parquet(f"{self.arrived}/batch={batch}")

    def slices(self) -> DataFrame:
        """t, z, batch, n_voxels of what has arrived, older arrivals of a slice left out."""
        counted = self._rows().groupBy("t", "z", "batch").agg(F.count("*").alias("n"))
        return counted.groupBy("t", "z").agg(F.max("batch").alias("batch"), F.max_by("n", "batch").alias("n_voxels"))

    def layer(self) -> layers.Layer:
        """The layer of what has arrived; what was stored before is replaced."""
        newest = self.slices().select("t", "z", "batch")
        codes = self._rows().join(newest, ["t", "z", "batch"], "left_semi")
        return layers.write_layer(codes, f"{self.path}/layer", self.size, self.top, self.levels)

    def drain(self, stream: DataFrame, checkpoint: str) -> layers.Layer:
        """All that is there now; a later call with the same checkpoint goes on behind it."""
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.start().awaitTermination()
        return self.layer()

    def _rows(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.arrived)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{VOXELS}, batch long")
        return self.spark.read.schema(f"{VOXELS}, batch long").parquet(self.arrived)
