"""Rules of dataset manifests, layouts and payloads as constraint queries.

Each rule returns a row for each violation: rule and what breaks it.  A table
is valid where its rules return nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _broken(df: DataFrame, rule: str, key: Column, ok: Column) -> DataFrame:
    return df.where(~F.coalesce(ok, F.lit(False))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def unique(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return twice.select(F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("key"))


def references(df: DataFrame, rule: str, key: str, to: DataFrame, to_key: str) -> DataFrame:
    """Rows whose key is missing in another table."""
    there = to.select(F.col(to_key).alias("_k")).distinct()
    return df.join(there, df[key] == there["_k"], "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def shards(df: DataFrame) -> DataFrame:
    """key, shard and chunk arrays: shards hold whole chunks."""
    whole = F.forall(F.zip_with("shard", "chunk", lambda s, c: (c > 0) & (s % c == 0)), lambda ok: ok)
    return _broken(df, "shard-divides", F.col("key"), (F.size("shard") == F.size("chunk")) & whole)


def hierarchy(levels: DataFrame) -> DataFrame:
    """key, level, gz, gy, gx: levels count from zero, and each grid is half the one before, rounded up."""
    w = Window.partitionBy("key").orderBy("level")
    half = [F.col(g) == F.ceil(F.lag(g).over(w) / 2) for g in ("gz", "gy", "gx")]
    first = F.row_number().over(w) == 1
    ok = (F.col("level") == F.row_number().over(w) - 1) & (first | reduce(lambda a, b: a & b, half))
    return _broken(levels.withColumn("ok", ok), "hierarchy", F.concat_ws("/", "key", "level"), F.col("ok"))


def brick_sizes(df: DataFrame, most: int = 65536) -> DataFrame:
    """key, bz, by, bx: powers of two, and not too many voxels together."""
    power = reduce(lambda a, b: a & b, [(F.col(c) > 0) & (F.bit_count(c) == 1) for c in ("bz", "by", "bx")])
    return _broken(df, "brick-size", F.col("key"), power & (F.col("bz") * F.col("by") * F.col("bx") <= most))


def ranges(df: DataFrame, rule: str, key: str, low: str, high: str) -> DataFrame:
    return _broken(df, rule, F.col(key), F.col(low) <= F.col(high))


def one_per_group(df: DataFrame, rule: str, group: str, groups: DataFrame) -> DataFrame:
    """Every group has exactly one row."""
    n = groups.select(group).distinct().join(df.groupBy(group).agg(F.count("*").alias("n")), group, "left")
    return _broken(n, rule, F.col(group), F.col("n") == 1)


def equal_timepoints(layers: DataFrame) -> DataFrame:
    """All layers have the same positive number of timepoints."""
    n = layers.agg(F.countDistinct("timepoints").alias("n"), F.min("timepoints").alias("least"))
    return _broken(n, "timepoints", F.concat_ws("/", "n", "least"), (F.col("n") == 1) & (F.col("least") > 0))


def payload(voxels: DataFrame, capacity: int) -> DataFrame:
    """brick, offset, label: offsets inside the brick, once each, labels not empty."""
    bad = _broken(voxels, "payload-offset", F.concat_ws("/", "brick", "offset"), F.col("offset").between(0, capacity - 1))
    empty = _broken(voxels, "payload-label", F.concat_ws("/", "brick", "offset"), F.col("label") != 0)
    return bad.unionByName(empty).unionByName(unique(voxels, "payload-twice", "brick", "offset"))


def checksums(df: DataFrame) -> DataFrame:
    """key, body, crc: the stored CRC-32 fits the body."""
    return _broken(df, "checksum", F.col("key"), F.crc32(F.col("body").cast("binary")) == F.col("crc"))


def page_slots(pages: DataFrame) -> DataFrame:
    """brick, n_occupied, slot: occupied bricks have a slot, empty ones -1."""
    return _broken(pages, "page-slot", F.col("brick"), (F.col("n_occupied") > 0) == (F.col("slot") >= 0))


def payload_order(voxels: DataFrame) -> DataFrame:
    """brick, place, offset: offsets grow with their place in the brick's payload; rows of one place go by offset."""
    before = F.lag("offset").over(Window.partitionBy("brick").orderBy("place", "offset"))
    return _broken(voxels.withColumn("ok", before.isNull() | (before < F.col("offset"))), "payload-order", F.concat_ws("/", "brick", "place"), F.col("ok"))


def scale_descriptors(scales: DataFrame, layers: DataFrame) -> DataFrame:
    """Scales (key, level, factor, depth, height, width, channels, shape, chunk, subcells) against their layers (key, volumes and sizes).

    Level 0 has the layer's size; arrays have the shape [volumes, depth, height,
    width, channels]; factors are positive; a chunk's subcells are at most four
    along an axis, and a chunk of one voxel has none (null).
    """
    size = ("depth", "height", "width", "channels")
    s = scales.join(layers.select(F.col("key"), F.col("volumes"), *(F.col(c).alias(f"_{c}") for c in size)), "key", "left")
    name = F.concat_ws("/", "key", "level")
    base = (F.col("level") > 0) | reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in size])
    shape = F.col("shape") == F.array(*(F.col(c).cast("int") for c in ("volumes", *size)))
    factor = (F.size("factor") == 3) & F.forall("factor", lambda f: f > 0)
    grid = F.transform("chunk", lambda c: F.greatest(F.lit(1), F.least(F.lit(4), c)))
    single = F.forall("chunk", lambda c: c == 1)
    cells = F.when(single, F.col("subcells").isNull()).otherwise(F.col("subcells").isNull() | (F.col("subcells") == grid))
    rules = (("scale-base", base), ("scale-shape", shape), ("scale-factor", factor), ("subcell-grid", cells))
    return reduce(DataFrame.unionByName, [_broken(s, rule, name, ok) for rule, ok in rules])


def mask_descriptors(masks: DataFrame, levels: DataFrame) -> DataFrame:
    """Masks (key, mask_values) and their scales (key, level, gz, gy, gx): values are listed, each scale halves the one before, the last is one voxel."""
    values = _broken(masks, "mask-values", F.col("key"), F.size("mask_values") > 0)
    top = levels.groupBy("key").agg(F.max_by(F.greatest("gz", "gy", "gx"), "level").alias("side"))
    last = _broken(masks.select("key").join(top, "key", "left"), "mask-last", F.col("key"), F.col("side") == 1)
    halves = hierarchy(levels).withColumn("rule", F.lit("mask-levels"))
    return values.unionByName(last).unionByName(halves)


def catalog(entries: DataFrame) -> DataFrame:
    """Experiments (id, label, description, base_url, timepoints, size_bytes): texts not empty, whole addresses, counts, ids once."""
    name = F.coalesce("id", F.lit(""))
    text = reduce(lambda a, b: a & b, [F.length(F.trim(c)) > 0 for c in ("id", "label", "description", "base_url")])
    found = (("catalog-text", text), ("catalog-address", F.rlike("base_url", F.lit(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+"))), ("catalog-timepoints", F.col("timepoints") > 0), ("catalog-size", F.col("size_bytes").isNull() | (F.col("size_bytes") >= 0)))
    rows = reduce(DataFrame.unionByName, [_broken(entries, rule, name, ok) for rule, ok in found])
    return rows.unionByName(unique(entries.withColumn("id", F.trim("id")), "catalog-id", "id"))
