"""Normalization, masks, histograms and contrast windows of intensity volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up

BINS = 256
MIN_WINDOW = 1e-4
FULL_RANGE = {"uint8": (0.0, 255.0), "uint16": (0.0, 65535.0)}
SOURCE_TYPES = ("uint8", "int8", "uint16", "int16", "uint32", "int32", "float32", "float64")


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def value_range(voxels: DataFrame, *by: str) -> DataFrame:
    """lo and hi of each group over values that aren't NaN.

    A lower end that isn't finite becomes 0; an upper end that isn't finite, or
    is no more than the lower one, becomes lo + 1.
    """
    v = F.when(~F.isnan("value"), F.col("value"))
    out = voxels.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    out = out.withColumn("lo", F.coalesce(finite(F.col("lo")), F.lit(0.0)))
    above = finite(F.col("hi"))
    return out.withColumn("hi", F.when(above != F.col("lo"), above).otherwise(F.col("lo") + 1))


def volume_range(voxels: DataFrame) -> DataFrame:
    """One row: the range over all slices, each of which has a range by itself."""
    return value_range(voxels, "z").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def stored_type(source_type: Column, allow_16_bit: Column) -> Column:
    """Sixteen bits only where they are enabled and the source has more than one byte."""
    return F.when(allow_16_bit & ~source_type.isin("uint8", "int8"), "uint16").otherwise("uint8")


def normalization_range(source_type: Column, stored: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """The range that maps to the stored codes: the full one where types agree, else the scanned one."""
    low, high = F.coalesce(finite(lo), F.lit(0.0)), F.coalesce(finite(hi), F.coalesce(finite(lo), F.lit(0.0)) + 1)
    same = low == high
    min_ = F.when(same & (high > 0), 0.0).otherwise(low)
    max_ = F.when(same & (high <= 0) & (low < 0), 0.0).when(same & (high <= 0), 1.0).otherwise(high)
    for name, (a, b) in FULL_RANGE.items():
        fixed = (source_type == name) & (stored == name)
        min_, max_ = F.when(fixed, a).otherwise(min_), F.when(fixed, b).otherwise(max_)
    return min_, max_


def code_of(value: Column, lo: Column, hi: Column, top: int = 255) -> Column:
    """The stored code of a value; an empty range counts as one wide."""
    span = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / span)) * top).cast("int")


def value_of(code: Column, lo: Column, hi: Column, top: int = 255) -> Column:
    return lo + code / F.lit(float(top)) * (hi - lo)


def normalize(voxels: DataFrame, representative: DataFrame | None = None, top: int = 255) -> DataFrame:
    """t, z, y, x, code, by the range of the representative timepoint floor(T / 2).

    The range is one row; it is joined by broadcast.
    """
    span = volume_range(representative_timepoint(voxels) if representative is None else representative)
    return voxels.join(F.broadcast(span)).select("t", "z", "y", "x", code_of(F.col("value"), F.col("lo"), F.col("hi"), top).alias("code"))


def representative_timepoint(voxels: DataFrame) -> DataFrame:
    """The voxels of timepoint floor(T / 2), T the number of timepoints."""
    middle = voxels.agg(F.floor(F.countDistinct("t") / 2).cast("int").alias("middle"))
    return voxels.join(F.broadcast(middle), F.col("t") == F.col("middle"), "left_semi")


def luminance(values: Column) -> Column:
    """Scalar intensity of an array of channels: the first, the mean of two, or weighted red, green and blue."""
    e = lambda i: F.element_at(values, i)
    return F.when(F.size(values) == 1, e(1)).when(F.size(values) == 2, (e(1) + F.try_element_at(values, F.lit(2))) / 2).otherwise(
        F.lit(0.2126) * e(1) + F.lit(0.7152) * F.try_element_at(values, F.lit(2)) + F.lit(0.0722) * F.try_element_at(values, F.lit(3))
    )


def display_luminance(values: Column) -> Column:
    """As ``luminance``, but the largest of four channels or more."""
    return F.when(F.size(values) >= 4, F.array_max(values)).otherwise(luminance(values))


def windowed(value: Column, low: float, high: float, invert: bool = False) -> Column:
    out = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / max(high - low, 1e-5)))
    return 1 - out if invert else out


def tinted(shown: Column, color: Column, additive: bool = False, least_alpha: float = 0.05) -> list[Column]:
    """Red, green, blue (0 to 1) and alpha of a windowed intensity in a layer's colour (#rrggbb).

    The colour is the same at every intensity, which is the alpha alone, at least
    ``least_alpha``.  Additive: the colour times its alpha, opaque where there is any.
    """
    alpha = F.greatest(F.lit(least_alpha), F.least(F.lit(1.0), shown))
    rgb = [F.conv(F.substring(color, 2 + 2 * k, 2), 16, 10).cast("double") / 255 for k in range(3)]
    if additive:
        rgb, alpha = [c * alpha for c in rgb], F.when(alpha > 0, 1.0).otherwise(0.0)
    return [c.alias(n) for c, n in zip([*rgb, alpha], ("red", "green", "blue", "alpha"), strict=True)]


def blended(pixels: DataFrame, *by: str) -> DataFrame:
    """Additive layers (red, green, blue) of each pixel together: sums, at most 1."""
    return pixels.groupBy(*by).agg(*(F.least(F.lit(1.0), F.sum(c)).alias(c) for c in ("red", "green", "blue")))


def histogram(codes: DataFrame, top: int = 255, *by: str) -> DataFrame:
    """A dense row for each of 256 bins: bin, n."""
    counted = codes.groupBy(*by, half_up(F.col("code") * 255 / F.lit(float(top))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = codes.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    if by:
        bins = counted.select(*by).distinct().join(F.broadcast(bins))
    return bins.join(counted, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def sampled_histogram(codes: DataFrame, width: int, height: int, voxels: int, most: int = 250_000) -> DataFrame:
    """The histogram of every k-th voxel, k so that about ``most`` are read; a sampling operator."""
    stride = max(1, -(-voxels // most))
    index = (F.col("z") * height + F.col("y")) * width + F.col("x")
    return histogram(codes.where(F.pmod(index, F.lit(stride)) == 0))


def auto_window(hist: DataFrame, voxels: int, previous: int = 0) -> DataFrame:
    """window_min, window_max, next_threshold: the outermost bins above a threshold.

    Bin 0 and bins with over a tenth of the counted voxels are passed over.
    """
    following = 10_000 if previous < 10 else max(1, previous // 2)
    low_need = voxels / following
    high_need = low_need * 0.02 if previous < 10 else low_need
    valid = hist.where("bin >= 1")
    total = F.sum("n").over(Window.partitionBy())
    kept = valid.select("bin", "n", total.alias("total")).withColumn("c", F.when(F.col("n") > F.col("total") / 10, 0).otherwise(F.col("n")))
    ends = kept.agg(
        F.coalesce(F.min(F.when(F.col("c") > low_need, F.col("bin"))), F.lit(BINS - 1)).alias("lo"),
        F.coalesce(F.max(F.when(F.col("c") > high_need, F.col("bin"))), F.lit(1)).alias("hi"),
        F.max("total").alias("total"),
    )
    none = (F.col("total") == 0) | (F.col("hi") < F.col("lo"))
    return ends.select(*_widened(F.when(none, 0.0).otherwise(F.col("lo") / 255.0), F.when(none, 1.0).otherwise(F.col("hi") / 255.0)), F.lit(following).alias("next_threshold"))


def _widened(low: Column, high: Column) -> tuple[Column, Column]:
    """Bins differ by 1/255 or not at all, so only an empty window has to be widened."""
    narrow = high - low < MIN_WINDOW
    top = F.when(narrow, F.least(F.lit(1.0), low + MIN_WINDOW)).otherwise(high)
    return F.when(narrow & (top - low < MIN_WINDOW), F.greatest(F.lit(0.0), top - MIN_WINDOW)).otherwise(low).alias("window_min"), top.alias("window_max")


def quantile_window(hist: DataFrame, lower: float = 0.005, upper: float = 0.995) -> DataFrame:
    """The bins where the cumulative count, without bin 0, reaches two quantiles."""
    w = Window.orderBy("bin")  # 255 rows
    run = hist.where("bin >= 1").select("bin", F.sum("n").over(w).alias("cum"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ends = run.agg(F.min(F.when(F.col("cum") >= F.col("total") * lower, F.col("bin"))).alias("lo"), F.min(F.when(F.col("cum") >= F.col("total") * upper, F.col("bin"))).alias("hi"), F.max("total").alias("total"))
    return ends.where("total > 0").select(*_widened(F.col("lo") / 255.0, F.col("hi") / 255.0))


def mask_values(values: Column, source_type: str) -> Column:
    """Listed background values as the source type can hold them: float32 rounded, integers whole and in range, once each."""
    if source_type == "float32":
        return F.array_distinct(F.transform(values, lambda v: v.cast("float").cast("double")))
    if source_type == "float64":
        return F.array_distinct(values)
    bits, signed = int("".join(filter(str.isdigit, source_type))), not source_type.startswith("u")
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return F.array_distinct(F.filter(values, lambda v: (v == F.floor(v)) & (v >= low) & (v <= high)))


def background_mask(voxels: DataFrame, values: list[float]) -> DataFrame:
    """z, y, x, masked: whether all channels of a voxel equal one listed value, at the first timepoint."""
    first = voxels.where("t = 0").groupBy("z", "y", "x").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return first.select("z", "y", "x", ((F.col("a") == F.col("b")) & F.col("a").isin(values)).alias("masked"))


def apply_mask(codes: DataFrame, mask: DataFrame) -> DataFrame:
    """Codes, zero where the mask covers the voxel."""
    m = mask.where("masked").select("z", "y", "x", F.lit(True).alias("_m"))
    return codes.join(m, ["z", "y", "x"], "left").select("t", "z", "y", "x", F.when(F.col("_m"), 0).otherwise(F.col("code")).alias("code"))


def unmasked(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    return voxels.join(mask.where("masked"), ["z", "y", "x"], "left_anti")


def downsample_mask(mask: DataFrame) -> DataFrame:
    """A cell of two by two by two is masked if all its voxels are."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return mask.groupBy(half("z"), half("y"), half("x")).agg(F.every("masked").alias("masked"))


def visible_region(mask: DataFrame, width: int, height: int, depth: int) -> DataFrame:
    """Bounding box of what is not masked, and its faces as fractions of the volume."""
    v = mask.where("not masked").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n_visible"))
    some = F.col("n_visible") > 0
    out = [some.alias("has_visible"), "n_visible"]
    for c, size in (("x", width), ("y", height), ("z", depth)):
        out += [F.coalesce(f"min_{c}", F.lit(0)).alias(f"min_{c}"), F.coalesce(f"max_{c}", F.lit(0)).alias(f"max_{c}")]
        out += [F.when(some, F.col(f"min_{c}") / size).otherwise(1.0).alias(f"low_{c}"), F.when(some, (F.col(f"max_{c}") + 1) / size).otherwise(0.0).alias(f"high_{c}")]
    return v.select(*out)


def binary_like(voxels: DataFrame, *by: str) -> DataFrame:
    """Groups with exactly two distinct values, all finite."""
    v = F.col("value")
    return voxels.groupBy(*by).agg((F.count_if(finite(v).isNull()) == 0).alias("all_finite"), F.countDistinct(v).alias("n_values")).select(*by, (F.col("all_finite") & (F.col("n_values") == 2)).alias("is_binary"))
