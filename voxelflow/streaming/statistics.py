"""Statistics of a stream that count each batch once, however often it is run again.

Each micro-batch writes its own partial statistics to a folder that bears its
number and replaces what an earlier attempt has left there.  A reader merges
the folders.  ``compact`` folds the folders up to a batch into one base, which
readers take as soon as it is whole; a base and the folders behind it never
count together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import run


class RunningStatistics:
    """n, lo, hi and total of ``value`` for each ``key``, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key", value: str = "value"):
        self.spark, self.path, self.key, self.value = spark, path, key, value

    def partial(self, rows: DataFrame) -> DataFrame:
        v = F.col(self.value).cast("double")
        return rows.groupBy(self.key).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(v).alias("total"))

    def add(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: what a batch has counted before is replaced; a batch that is in a base already is left out."""
        if batch > self._base():
            self.partial(rows).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")

    def _names(self) -> list[str]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        whole = lambda name: system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))
        return [x for x in found if whole(x)]

    def _base(self) -> int:
        return max((int(x.removeprefix("base-")) for x in self._names() if x.startswith("base-")), default=-1)

    def _parts(self) -> list[str]:
        base = self._base()
        batches = sorted((x for x in self._names() if x.startswith("batch-")), key=lambda x: int(x.removeprefix("batch-")))
        return [f"base-{base}"] * (base >= 0) + [x for x in batches if int(x.removeprefix("batch-")) > base]

    def read(self) -> DataFrame | None:
        """The statistics so far; None before the first batch."""
        if not (parts := self._parts()):
            return None
        every = self.spark.read.parquet(*(f"{self.path}/{x}" for x in parts))
        return every.groupBy(self.key).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"))

    def compact(self) -> None:
        """One base in place of all folders; these go only after it is whole."""
        parts = self._parts()
        batches = [int(x.removeprefix("batch-")) for x in parts if x.startswith("batch-")]
        if not batches:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base-{max(batches)}")
        for x in parts:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drained(stream: DataFrame, key: str, value: str, compact_every: int = 16) -> DataFrame:
    """All that is there now, in micro-batches."""
    spark = stream.sparkSession
    root = run.shared_folder(spark, "statistics")
    kept = RunningStatistics(spark, f"{root}/table", key, value)

    def batch(rows: DataFrame, number: int) -> None:
        kept.add(rows, number)
        if number % compact_every == compact_every - 1:
            kept.compact()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    found = kept.read()
    return found if found is not None else kept.partial(spark.createDataFrame([], stream.schema))
