"""Volumes, labels, tracks, regions and manifests in files, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = "layer_key string, channel_id string, kind string, volume_count int, width int, height int, depth int, data_type string, stored_type string, norm_min double, norm_max double"
MANIFEST = f"format string, generatedAt string, channels array<struct<id:string,name:string>>, layers array<struct<{LAYERS.replace(' ', ':').replace(',:', ',')}>>"
ROI = "id string, name string, shape string, mode string, color string, start struct<x:double,y:double,z:double>, `end` struct<x:double,y:double,z:double>"
CATALOG = "version int, examples array<struct<id:string,label:string,description:string,baseUrl:string,timepoints:long,sizeBytes:long>>"
#: Types that a source may have.
TYPES = ("uint8", "int8", "uint16", "int16", "uint32", "int32", "float32", "float64")
#: Rows a file may have; about 100 MB of codes.
FILE_ROWS = 20_000_000


def write_volume(codes: DataFrame, path: str) -> None:
    """layer_key, scale, t and voxels; readers of a scale or a timepoint open its folder alone.

    Rows are dealt by blocks of 128 x 512 x 512 voxels inside a timepoint, so that a large one is many tasks.
    """
    block = [F.floor(F.col(c) / n) for c, n in (("z", 128), ("y", 512), ("x", 512))]
    (codes.repartition("layer_key", "scale", "t", *block).sortWithinPartitions("layer_key", "scale", "t", "z", "y", "x").write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("layer_key", "scale", "t").parquet(path))


def read_volume(spark: SparkSession, path: str, layer_key: str, scale: int = 0, t: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path).where((F.col("layer_key") == layer_key) & (F.col("scale") == scale))
    return rows if t is None else rows.where(F.col("t") == t)


def write_tracks(points: DataFrame, path: str) -> None:
    """Positions as 32-bit floats, as the compiled form has them."""
    points.withColumns({c: F.col(c).cast("float") for c in ("time", "x", "y", "z", "amplitude")}).write.mode("overwrite").parquet(path)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tracks`` has stored, as doubles again."""
    rows = spark.read.parquet(path)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("time", "x", "y", "z", "amplitude")})


def write_mask(mask: DataFrame, path: str) -> None:
    """The background of a layer: layer_key, scale, z, y, x of the voxels that are masked."""
    mask.where("masked").select("layer_key", "scale", "z", "y", "x").write.mode("overwrite").partitionBy("layer_key", "scale").parquet(path)


def label_tables(labels: DataFrame, size: tuple[int, int, int], levels: int = 4) -> dict[str, DataFrame]:
    """What goes beside the voxels of a sparse label layer: its brick directory, its occupied bricks by level, and a row for each label."""
    from ..operators import labels as ops

    return {"directory": ops.brick_directory(labels, size), "occupancy": ops.occupancy(labels, size, levels), "labels": ops.label_stats(labels)}


def write_labels(labels: DataFrame, path: str, size: tuple[int, int, int], levels: int = 4) -> None:
    """A sparse label layer as four tables: its voxels, and what ``label_tables`` derives from what was stored."""
    kept = labels.where("label <> 0")
    kept.write.mode("overwrite").partitionBy("t").parquet(f"{path}/voxels")
    stored = labels.sparkSession.read.schema(kept.schema).parquet(f"{path}/voxels")
    for name, rows in label_tables(stored, size, levels).items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def write_rois(rois: DataFrame, path: str) -> None:
    """Regions, in order, as one JSON document; a region list is short and becomes one row."""
    columns = [c for c in rois.columns if c != "roi_order"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("roi_order", *columns))), lambda r: F.struct(*(r[c].alias(c) for c in columns)))
    rois.agg(listed.alias("rois")).coalesce(1).write.mode("overwrite").json(path)


def _checked(rows: DataFrame, what: str, problems) -> DataFrame:
    """``rows``, or an error that names every problem; a filter, which no plan prunes."""
    text = F.concat(F.lit(f"{what}: "), F.array_join(problems, "; "))
    return rows.where(F.when(F.size(problems) == 0, True).otherwise(F.raise_error(text).cast("boolean")))


def _problems(path, *rules):
    """The texts of the rules (field, what is expected, whether it holds) that one entry breaks, each with its path."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.concat(path, F.lit(f".{field}: expected {expected}"))) for field, expected, ok in rules)), lambda x: x.isNotNull())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a layer.

    A file that doesn't fit the schema, or breaks a rule, is an error that names
    the path of each violation: keys are there and differ, channels exist (where
    the manifest lists them), volume counts and sizes are positive, types are
    known, and ranges are not empty.
    """
    m = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    known = F.transform("channels", lambda c: c["id"])
    keys = F.transform("layers", lambda x: x["layer_key"])

    def layer(x, i):
        same = F.size(F.filter(keys, lambda k: k == x["layer_key"]))
        return _problems(
            F.concat(F.lit("manifest.layers["), i.cast("string"), F.lit("]")),
            ("layer_key", "a name that no other layer has", (x["layer_key"] != "") & (same == 1)),
            ("channel_id", "a channel of the manifest", F.when(known.isNotNull() & x["channel_id"].isNotNull(), F.array_contains(known, x["channel_id"])).otherwise(True)),
            *((n, "a positive number", F.when(x[n].isNull(), True).otherwise(x[n] > 0)) for n in ("volume_count", "width", "height", "depth")),
            ("data_type", "a known type", F.when(x["data_type"].isNull(), True).otherwise(x["data_type"].isin(*TYPES))),
            ("stored_type", "uint8, uint16 or uint32", F.when(x["stored_type"].isNull(), True).otherwise(x["stored_type"].isin("uint8", "uint16", "uint32"))),
            ("norm_max", "more than norm_min", F.when(x["norm_min"].isNull() | x["norm_max"].isNull(), True).otherwise(x["norm_max"] > x["norm_min"])),
        )

    there = F.when(F.col("layers").isNull(), F.array(F.lit("manifest.layers: expected a list")))
    problems = F.coalesce(there, F.flatten(F.transform("layers", layer)))
    return _checked(m, "manifest", problems).select("format", F.explode("layers").alias("l")).select("format", "l.*")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The experiments of a catalogue of version 1, texts trimmed and addresses without a closing slash; what breaks a rule is an error.

    A catalogue is a short list, which one person keeps by hand.
    """
    from ..plans import validation

    whole = spark.read.schema(CATALOG).option("multiLine", True).option("mode", "FAILFAST").json(path)
    known = F.when(F.col("version") == 1, F.col("examples")).otherwise(F.raise_error(F.concat(F.lit("catalogue of version "), F.coalesce(F.col("version").cast("string"), F.lit("none")))))
    rows = whole.select(F.explode(known).alias("e")).select("e.id", "e.label", "e.description", F.col("e.baseUrl").alias("base_url"), "e.timepoints", F.col("e.sizeBytes").alias("size_bytes"))
    broken = validation.catalog(rows).agg(F.sort_array(F.collect_list(F.concat_ws(" ", "rule", "key"))).alias("broken"))
    checked = rows.join(F.broadcast(broken))
    first = F.when(F.size("broken") == 0, F.trim("id")).otherwise(F.raise_error(F.concat(F.lit("catalogue: "), F.array_join("broken", ", "))).cast("string"))
    return checked.select(first.alias("id"), F.trim("label").alias("label"), F.trim("description").alias("description"), F.regexp_replace(F.trim("base_url"), "/+$", "").alias("base_url"), "timepoints", "size_bytes")


def write_manifest(layers: DataFrame, path: str) -> None:
    layers.agg(F.lit("voxelflow-1").alias("format"), F.collect_list(F.struct(*layers.columns)).alias("layers")).write.mode("overwrite").json(path)


def upserted(layers: DataFrame, changed: DataFrame) -> DataFrame:
    """A manifest's layers with changed ones replaced and new ones added."""
    kept = layers.join(changed.select("layer_key"), "layer_key", "left_anti")
    return kept.unionByName(changed)


def read_rois(spark: SparkSession, path: str, size: tuple[int, int, int] | None = None) -> DataFrame:
    """Regions of a JSON file, in order, the first of each id; missing names and colours get defaults.

    Broken JSON, a document without regions, a region without id, and, with
    ``size`` (width, height, depth), one that leaves the volume or has no corners
    are errors that name the path of each violation.
    """
    r = spark.read.schema(f"rois array<struct<{ROI.replace(' string', ':string').replace(' struct', ':struct')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)

    def region(x, i):
        rules = [("id", "a name", x["id"] != "")]
        if size is not None:
            rules += [(f"{corner}.{axis}", f"0 to {n - 1}", (x[corner][axis] >= 0) & (x[corner][axis] <= n - 1)) for corner in ("start", "end") for axis, n in zip("xyz", size, strict=True)]
        return _problems(F.concat(F.lit("rois["), i.cast("string"), F.lit("]")), *rules)

    there = F.when(F.col("rois").isNull(), F.array(F.lit("rois: expected a list")))
    checked = _checked(r, "regions", F.coalesce(there, F.flatten(F.transform("rois", region))))
    rows = checked.select(F.posexplode("rois").alias("roi_order", "r")).select("roi_order", "r.*")
    first = rows.groupBy("id").agg(F.min(F.struct("roi_order", *[c for c in rows.columns if c not in ("id", "roi_order")])).alias("r")).select("id", "r.*")
    return first.select("roi_order", "id", F.coalesce("name", "id").alias("name"), F.coalesce("shape", F.lit("rectangle")).alias("shape"), F.coalesce("mode", F.lit("2d")).alias("mode"), F.coalesce("color", F.lit("#3b82f6")).alias("color"), "start", "end")


def write_measurements(rows: DataFrame, path: str) -> None:
    """One CSV file with every cell quoted and quotes doubled, rows as they come.

    A row for each region and channel: a short table, which one task writes.
    """
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
