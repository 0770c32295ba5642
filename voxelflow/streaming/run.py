"""Runs a stream over all that is there now and reads its result back as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``, or its checkpoint folder; it goes when the session's JVM ends.

    A session on one machine that has neither gets a local folder; on a cluster
    executors could not read each other's, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = root or "file://" + tempfile.gettempdir() + "/checkpoints"
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return table_stream(spark, sf_dir, "events", schema)


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:
    """A table, one file or a folder of them, as a stream of files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Append streams add files; complete ones replace the table with each batch."""
    spark = stream.sparkSession
    root = shared_folder(spark, name)
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", f"{root}/table")
    else:
        out = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/table"))
    query = out.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")
