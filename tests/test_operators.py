"""Hand-computed values of the image and track operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflow.functions import scales, text
from voxelflow.operators import bricks, intensity, labels, ranks, regions, sampling, tracks

ROI = "roi_order int, roi_name string, shape string, mode string, sx double, sy double, sz double, ex double, ey double, ez double"


def volume(spark, values, width, height=1):
    rows = [(0, i // (width * height), i // width % height, i % width, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "t int, z int, y int, x int, value double")


def test_rectangle_statistics(spark):
    rois = spark.createDataFrame([(1, "a", "rectangle", "2d", 1.0, 1.0, 0.0, 2.0, 2.0, 0.0), (2, "none", "rectangle", "2d", 1.2, 1.2, 0.0, 1.8, 1.8, 0.0)], ROI)
    got = {r.roi_order: r for r in regions.measure(volume(spark, range(16), 4, 4), rois, (1, 4, 4)).collect()}
    r = got[1]
    assert (r.n_voxels, r.min, r.max, r.mean, r.median) == (4, 5.0, 10.0, 7.5, 7.5)
    assert r.std == pytest.approx(math.sqrt(4.25))
    assert (got[2].n_voxels, got[2].mean) == (None, None)


def test_line_statistics(spark):
    rois = spark.createDataFrame([(1, "l", "line", "3d", 0.0, 0.0, 0.0, 2.0, 0.0, 0.0)], ROI)
    r = regions.measure(volume(spark, [0, 100, 200], 3), rois, (1, 1, 3)).first()
    assert (r.n_voxels, r.min, r.max, r.mean) == (3, 0.0, 200.0, 100.0)


@pytest.mark.parametrize(
    ("dims", "voxels", "want"),
    [
        ((2, 2, 2), [(0, 0, 0, 3), (0, 0, 1, 4)], []),
        ((1, 2, 2), [(0, 0, 0, 7), (0, 1, 1, 7)], [(0, 0, 0, 7)]),
        ((1, 2, 2), [(0, 0, 0, 7), (0, 0, 1, 5), (0, 1, 0, 7), (0, 1, 1, 5)], [(0, 0, 0, 5)]),
    ],
)
def test_label_pyramid_ties(spark, dims, voxels, want):
    df = spark.createDataFrame([(0, *v) for v in voxels], "t int, z int, y int, x int, label long")
    assert [tuple(r)[1:] for r in labels.downsample_sparse(df, dims).collect()] == want


@pytest.mark.parametrize(
    ("size", "voxels", "codec"),
    [
        ((4, 4, 4), [(21, 4294967295)], "coord-list"),
        ((1, 1, 32), [(o, 9) for o in range(4, 21)], "x-run"),
        ((4, 4, 4), [(7 * k, k + 1) for k in range(8)], "bitmask"),
        ((4, 4, 4), [(o, o + 1) for o in range(64)], "dense"),
    ],
)
def test_brick_encodings(spark, size, voxels, codec):
    rows = [(0, o // (size[1] * size[2]), o // size[2] % size[1], o % size[2], v) for o, v in voxels]
    df = spark.createDataFrame(rows, "t int, z int, y int, x int, label long")
    assert labels.brick_directory(df, size).first().codec == codec


def points_of(spark, rows):
    return spark.createDataFrame(rows, "source_track_id long, segment_index int, row_idx long, time double, x double, y double, z double, amplitude double")


def test_centroids_are_anchored(spark):
    times = [0.0, 0.0006, 0.0012, 0.0018, 1.0]
    got = tracks.centroids(points_of(spark, [(1, 0, i, t, float(i), 0.0, 0.0, 0.0) for i, t in enumerate(times)])).orderBy("group_time").collect()
    assert [(r.group_time, r.n_points, r.x) for r in got] == [(0.0, 2, 0.5), (0.0012, 2, 2.5), (1.0, 1, 4.0)]


def test_segments_and_parents(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 3), rng.random() < 0.3) for i in range(200)]
    df = spark.createDataFrame([(i, s, b, *([None] * 5 if b else [float(i), 1.0, 2.0, 3.0, 0.0])) for i, s, b in rows], "row_idx long, source_track_id long, is_break boolean, time double, x double, y double, z double, amplitude double")
    want, state = {}, {}
    for i, s, b in rows:
        segment, pending, any_point = state.get(s, (0, False, False))
        if b:
            state[s] = (segment, any_point, any_point)
        else:
            segment += pending
            want[i] = (s, segment)
            state[s] = (segment, False, True)
    got = {r.row_idx: (r.source_track_id, r.segment_index) for r in tracks.segmented(df).collect()}
    assert got == want
    by = {r.track_id: r for r in tracks.summary(tracks.segmented(df)).collect()}
    assert by["track-set-1:1"].parent_id is None and by["track-set-1:1-1"].parent_id == "track-set-1:1"
    assert by["track-set-1:1-2"].parent_id == "track-set-1:1-1"


def test_smoothing(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(40)]
    p = points_of(spark, [(1, 0, i, float(i), v, 0.0, 0.0, math.nan if i == 7 else 1.0) for i, v in enumerate(values)])
    got = [r.x for r in tracks.smoothed(p, 1.5, ("x",)).orderBy("point_idx").collect()]
    for i in range(40):
        near = [(math.exp(-((j - i) ** 2) / 4.5), values[j]) for j in range(max(0, i - 5), min(40, i + 6)) if j != 7]
        assert got[i] == pytest.approx(sum(w * v for w, v in near) / sum(w for w, _ in near))
    assert [r.x for r in tracks.smoothed(p, 0.0).orderBy("point_idx").collect()] == values


def test_rounding_goes_up(spark):
    df = volume(spark, [-2.5, 2.5, 0.5], 3)
    from voxelflow.functions.rounding import half_up

    assert [r[0] for r in df.select(half_up(F.col("value"))).collect()] == [-2, 3, 1]


def test_label_rules(spark):
    df = volume(spark, [-1.0, 0.4, 2.5, math.nan, math.inf], 5)
    assert [r[0] for r in df.select(labels.lenient_label(F.col("value"))).collect()] == [0, 0, 3, 0, 0]
    with pytest.raises(Exception, match="65535"):
        volume(spark, [70000], 1).select(labels.lenient_label(F.col("value"))).collect()
    for bad in (-1.0, 0.5, math.nan, 2.0**32):
        with pytest.raises(Exception, match="32-bit"):
            volume(spark, [bad], 1).select(labels.strict_label(F.col("value"))).collect()


def test_normalization_skips_nan(spark):
    got = {r.x: r.code for r in intensity.normalize(volume(spark, [0, 1, 2, math.nan], 4)).where("x < 3").collect()}
    assert got == {0: 0, 1: 128, 2: 255}
    flat = volume(spark, [5, 5, 5], 3)
    assert {r.code for r in intensity.normalize(flat).collect()} == {0}


def test_zone_map_counts_occupied_children_only(spark):
    codes = volume(spark, [9] * 4 + [0] * 4, 8).withColumnRenamed("value", "code").withColumn("code", F.col("code").cast("int"))
    rows = {(r.level, r.gx): (r.occ, r.vmin, r.vmax) for r in bricks.zone_map(bricks.brick_stats(codes, (1, 1, 2)), 3).collect()}
    assert rows[0, 0] == (255, 9, 9) and rows[0, 3] == (0, 0, 0)
    assert rows[1, 0] == (255, 9, 9) and rows[1, 1] == (0, 0, 0) and rows[2, 0] == (255, 9, 9)


def test_pyramid_geometry():
    levels = bricks.pyramid_geometry((1, 5, 8))
    assert [d for _, _, d in levels] == [(1, 5, 8), (1, 3, 4), (1, 2, 2), (1, 1, 1)]
    assert [f for _, f, _ in levels] == [(1, 1, 1), (1, 2, 2), (1, 4, 4), (1, 8, 8)]


def test_edits_and_deletion(spark):
    base = spark.createDataFrame([(0, 0, 0, 0, 3), (0, 0, 0, 1, 5)], "t int, z int, y int, x int, label long")
    edits = spark.createDataFrame([(0, 0, 0, 0, 9, 1, 0), (0, 0, 0, 0, 4, 2, 1), (0, 0, 0, 1, 0, 3, 2)], "t int, z int, y int, x int, label long, seq long, stroke long")
    assert [tuple(r)[3:] for r in labels.latest(base, edits).collect()] == [(0, 4)]
    assert sorted(tuple(r)[3:] for r in labels.latest(base, labels.undone(edits, 2)).collect()) == [(0, 9), (1, 5)]
    assert sorted(r.label for r in labels.without_label(base, 3).collect()) == [4]


def test_resampling_keeps_the_ends(spark):
    got = [r.value for r in sampling.resample(volume(spark, [0, 10], 2), (1, 1, 2), (1, 1, 5)).orderBy("x").collect()]
    assert got == [0.0, 2.5, 5.0, 7.5, 10.0]


def test_names(spark):
    df = spark.createDataFrame([("a:b:c", "scan10.tif", "#AbC", ' x/y: "z".zip')], "id string, file string, color string, name string")
    r = df.select(text.track_set_of(F.col("id")), text.natural_key(F.col("file")), text.hex_color(F.col("color")), text.file_base(F.col("name"))).first()
    assert (r[0], r[2], r[3]) == ("a", "#aabbcc", "x-y-_-z-")
    assert r[1] > df.select(text.natural_key(F.lit("Scan9.tif"))).first()[0]


def test_infinity_lends_nothing(spark):
    rows = [(1, 0, i, float(i), float("inf") if i == 2 else float(i), 0.0, 0.0, float("inf") if i == 4 else 1.0) for i in range(6)]
    points = spark.createDataFrame(rows, "source_track_id long, segment_index int, row_idx long, time double, x double, y double, z double, amplitude double")
    got = tracks.smoothed(points, 1.0).collect()
    assert all(math.isfinite(r.x) and math.isfinite(r.amplitude) for r in got)
    assert tracks.summary(points).first().amp_max == 1.0


def test_opaque_rays(spark):
    rows = [(0, z, 0, 0, 255 if z < 2 else 100) for z in range(3)]
    r = sampling.project_absorbed(spark.createDataFrame(rows, "t int, z int, y int, x int, code int"), 0.0, 5000.0).first()
    assert (r.color, r.alpha) == (1.0, 1.0)


def test_region_numbers_beyond_2147(spark):
    rois = spark.createDataFrame([(3000, "a", "line", "2d", 0.0, 0.0, 0.0, 3.0, 0.0, 0.0), (3001, "b", "line", "2d", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], ROI)
    got = {r.roi_order: (r.n_voxels, r.max) for r in regions.measure(volume(spark, range(4), 4), rois, (1, 1, 4)).collect()}
    assert got == {3000: (4, 3.0), 3001: (2, 1.0)}


def test_natural_order_of_long_numbers(spark):
    names = ["f9", "f10", "f9999999999999", "f20240101123045", "F010b", "f10a"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["f9", "f10", "f10a", "F010b", "f9999999999999", "f20240101123045"]


def test_running_totals_over_buckets(spark):
    rows = [(k, random.Random(k).randrange(9)) for k in range(200)] + [(None, 4)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(5)
    got = {r.k: (r.place, r.total) for r in tracks.before(df, F.floor(F.col("k") / 7), ("k",), place=F.lit(1).cast("long"), total=F.col("n")).collect()}
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    assert got == {k: (i, sum(n for _, n in ordered[:i])) for i, (k, _) in enumerate(ordered)}


def test_seeded_palette(spark):
    def share(state):
        times = lambda a, b: a * b & 0xFFFFFFFF
        t = times(state ^ state >> 15, state | 1)
        t ^= t + times(t ^ t >> 7, t | 61) & 0xFFFFFFFF
        return (t ^ t >> 14) / 2**32

    df = spark.createDataFrame([(s, k) for s in (0, 1, 2**32 - 1, 123456789) for k in range(1, 40)], "s long, k int")
    for r in df.select("s", "k", scales.seeded_share(F.col("s"), F.col("k")).alias("u")).collect():
        assert r.u == share(((r.s or scales.SEED_STEP) + r.k * scales.SEED_STEP) & 0xFFFFFFFF)


def test_sliders(spark):
    row = spark.createDataFrame([(0.25, 0.75)], "a double, b double")
    whole = scales.slider_places(F.lit(0.0), F.lit(1.0), 0.0, 1.0, 256)
    assert tuple(row.select(*whole.values()).first()) == (0, 255, 128, 128)
    same = scales.at_contrast(F.col("a"), F.col("b"), F.lit(256), 0.0, 1.0, 256)
    assert tuple(row.select(*same).first()) == (0.25, 0.75)
    assert tuple(row.select(*scales.at_contrast(F.col("a"), F.col("b"), F.lit(0), 0.0, 1.0, 256)).first()) == (0.25, 0.75)
    assert tuple(row.select(*scales.at_brightness(F.col("a"), F.col("b"), F.lit(64), 0.0, 1.0, 256)).first()) == (0.5, 1.0)


def anchored(times, epsilon=1e-3):
    found = []
    for t in sorted(set(times)):
        if not found or t - found[-1] > epsilon:
            found.append(t)
    return found


@pytest.mark.parametrize("step", [0.0004, 0.001, 0.0011, 0.5])
def test_centroid_anchors(spark, step):
    times = [k * step for k in range(200)] + [5.0, 5.0005, 5.001, 5.0015]
    rows = [(1, 0, k, t, 1.0, 2.0, 3.0, float(k)) for k, t in enumerate(times)]
    points = spark.createDataFrame(rows, "source_track_id long, segment_index int, row_idx long, time double, x double, y double, z double, amplitude double")
    got = tracks.centroids(points).orderBy("group_time").collect()
    assert [r.group_time for r in got] == anchored(times) and sum(r.n_points for r in got) == len(times)


def test_centroids_of_a_long_track(spark):
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("source_track_id"), F.lit(0).alias("segment_index"), F.col("id").alias("row_idx"), (F.col("id") * 0.0004).alias("time"), *(F.lit(1.0).alias(c) for c in ("x", "y", "z", "amplitude")))
    assert tracks.centroids(rows).count() == len(anchored([k * 0.0004 for k in range(200_000)]))


def test_ranges_without_end(spark):
    inf = float("inf")
    rows = [(0, 0, 0, x, v) for x, v in enumerate([0.0, 1.0, 2.0, 3.0, inf])]
    df = spark.createDataFrame(rows, "t int, z int, y int, x int, value double")
    assert [r.code for r in intensity.normalize(df).orderBy("x").collect()] == [0, 255, 255, 255, 255]
    assert tuple(intensity.value_range(df.withColumn("value", F.lit(float("nan")))).first()) == (0.0, 1.0)
    assert tuple(intensity.value_range(df.withColumn("value", -F.col("value"))).first()) == (0.0, 1.0)


@pytest.mark.parametrize("sigma", [0.4, 2.5, 30.0])
def test_smoothing_in_pieces(spark, sigma):
    """A long segment beside short ones, with gaps and nulls: pieces with copied ends give what whole segments give."""
    rng = random.Random(5)
    rows = [(1, 0, i, float(i // 3), rng.random(), rng.random(), 1.0, None if i % 50 == 3 else rng.random()) for i in range(700)]
    rows += [(s, g, 1000 * s + i, float(-i), rng.random(), 2.0, 3.0, math.inf if i == 1 else 1.0) for s in range(2, 9) for g in range(2) for i in range(s)]
    p = points_of(spark, rows).repartition(5)
    key = lambda r: (r.source_track_id, r.segment_index, r.point_idx)
    whole = sorted(tracks.smoothed(p, sigma).collect(), key=key)
    pieces = sorted(tracks.smoothed(p, sigma, piece=16).collect(), key=key)
    assert len(whole) == len(rows) and [tuple(r) for r in pieces] == [pytest.approx(tuple(r), rel=1e-9) for r in whole]


def test_a_long_segment_is_many_tasks(spark):
    p = spark.range(20_000).select(F.lit(1).cast("long").alias("source_track_id"), F.lit(0).alias("segment_index"), F.col("id").alias("row_idx"), *(F.col("id").cast("double").alias(c) for c in ("time", "x", "y", "z", "amplitude")))
    dealt = ranks.in_ranges(p, ("source_track_id", "segment_index", "time", "row_idx")).groupBy("_range").count().collect()
    assert len(dealt) > 200 and max(r["count"] for r in dealt) < 400
    got = tracks.smoothed(p, 2.0, ("x",), piece=1000).agg(F.count("*"), F.max(F.abs(F.col("x") - F.col("row_idx")))).first()
    assert got[0] == 20_000 and got[1] < 4  # only the ends are drawn inwards


def test_ranks_by_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, math.nan, -0.0, 0.0, 1.5, float(i)]), rng.choice(["a", None, "b"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, v double, s string").repartition(7)
    got = ranks.ranked(df, ("s", "v", "i")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 3001))
    assert [r.i for r in got] == [r.i for r in df.orderBy("s", "v", "i").collect()]
    assert ranks.ranked(df.limit(0), ("i",)).collect() == []
    assert [r.place for r in ranks.ranked(df.where("i = 5"), ("i",)).collect()] == [1]


def test_exact_medians(spark):
    """One group with nearly all rows, many copies of a value, groups of one and two rows, nulls and infinities."""
    rng = random.Random(7)
    rows = [(1, rng.choice([2.0, rng.gauss(0, 1)])) for _ in range(4001)] + [(2, 5.0), (3, 1.0), (3, 2.0), (4, None), (4, -1.0), (5, math.inf), (5, 1.0), (5, math.inf), (6, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    got = {r.g: r for r in ranks.value_statistics(df, "g", "v").collect()}
    want = {r.g: r for r in df.groupBy("g").agg(F.count("v").alias("n"), F.median("v").alias("median"), F.stddev_pop("v").alias("std"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")).where("n > 0").collect()}
    assert set(got) == set(want)
    for g, w in want.items():
        assert (got[g].n_values, got[g].median, got[g].min, got[g].max) == (w.n, w.median, w.min, w.max)
        if g != 5:
            assert (got[g].mean, got[g].std) == pytest.approx((w.mean, w.std))


def test_undo_and_redo(spark):
    ops = {
        "a": "stroke stroke undo redo",  # both hold
        "b": "undo redo stroke undo undo redo redo",  # nothing to take back, nothing to bring back
        "c": "stroke stroke undo stroke redo",  # the second stroke is cut off
        "d": "stroke stroke stroke undo undo redo other",
        "e": "stroke undo",
    }
    rows = [(k, i, op) for k, line in ops.items() for i, op in enumerate(line.split())] + [(None, 4, "stroke")]
    log = spark.createDataFrame(rows, "layer string, seq long, op string").repartition(3)
    got = sorted(map(tuple, labels.applied(log, "layer").collect()), key=str)
    assert got == sorted([("a", 0, 1), ("a", 1, 2), ("b", 2, 1), ("c", 0, 1), ("c", 3, 2), ("d", 0, 1), ("d", 1, 2), (None, 4, 1)], key=str)
    assert labels.applied(log.limit(0), "layer").collect() == []


def crossing(volume, ray, threshold, halvings):
    """The same by a loop over one ray."""
    _, origin, direction, n = ray

    def sample(k):
        at = np.array(origin) + k * np.array(direction)
        if (at < 0).any() or (at > np.array(volume.shape) - 1).any():
            return None
        low = np.floor(at).astype(int)
        total = 0.0
        for corner in np.ndindex(2, 2, 2):
            place = np.minimum(low + corner, np.array(volume.shape) - 1)
            weight = np.prod(np.where(corner, at - low, 1 - (at - low)))
            total += weight * volume[tuple(place)]
        return total

    taken = [(k, v) for k in range(n + 1) if (v := sample(k)) is not None]
    hit = next((k for k, v in taken if v > threshold), None)
    if hit is None:
        return None
    lo, hi = max(hit - 1, taken[0][0]), hit
    for _ in range(halvings):
        middle = (lo + hi) / 2
        lo, hi = (lo, middle) if sample(middle) > threshold else (middle, hi)
    return hi


@pytest.mark.parametrize("halvings", [0, 6])
def test_first_crossings(spark, halvings):
    rng = np.random.default_rng(3)
    volume = rng.integers(0, 100, (5, 7, 9)).astype(float)
    volume[:, 3, 4] = 0.0
    rays = [(k, tuple(int(rng.integers(0, 64 * (d - 1))) / 64 for d in volume.shape), tuple(int(v) / 64 for v in rng.integers(-90, 91, 3)), int(rng.integers(0, 12))) for k in range(40)]
    rays.append((40, (-3.0, 2.5, 2.5), (0.75, 0.0, 0.0), 20))  # enters on its way
    rays.append((41, (0.0, 6.0, 8.0), (1.0, 0.0, 0.0), 4))  # along an edge
    rays.append((42, (50.0, 0.0, 0.0), (1.0, 0.0, 0.0), 4))  # never inside
    table = [(i, 0, *o, *d, n) for i, o, d, n in rays] + [(43, 0, 0.0, 0.0, 0.0, None, 0.0, 0.0, 4), (44, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, -1)]
    ray_rows = spark.createDataFrame(table, "ray_id long, t int, oz double, oy double, ox double, dz double, dy double, dx double, n_steps int")
    cells = [(0, *map(int, i), float(v)) for i, v in np.ndenumerate(volume) if v != 0]  # zeros are not stored
    voxels = spark.createDataFrame(cells, "t int, z int, y int, x int, value double")
    got = {r.ray_id: r for r in sampling.first_crossing(voxels, ray_rows, volume.shape, 60.3, halvings).collect()}
    want = {r[0]: at for r in rays if (at := crossing(volume, r, 60.3, halvings)) is not None}
    assert 10 < len(want) < 42 and {k: r.step for k, r in got.items()} == want
    for k, r in got.items():
        assert r.value > 60.3 and (r.pz, r.py, r.px) == tuple(o + r.step * d for o, d in zip(rays[k][1], rays[k][2], strict=True))
    below = sampling.first_crossing(voxels.limit(0), ray_rows, volume.shape, -1.0, halvings)  # an empty volume is zero
    assert {r.step for r in below.where("ray_id < 40").collect()} == {0.0}
    odd = voxels.withColumn("value", F.lit(float("nan")))
    assert sampling.first_crossing(odd, ray_rows, volume.shape, 60.3, halvings).count() == 0


def test_tints(spark):
    rows = spark.createDataFrame([(0.0, "#FF8000"), (0.5, "#ff8000"), (2.0, "#000000")], "shown double, color string")
    plain = [tuple(r) for r in rows.select(*intensity.tinted(F.col("shown"), F.col("color"))).collect()]
    assert plain == [(1.0, 128 / 255, 0.0, 0.05), (1.0, 128 / 255, 0.0, 0.5), (0.0, 0.0, 0.0, 1.0)]
    added = rows.select(F.lit(1).alias("pixel"), *intensity.tinted(F.col("shown"), F.col("color"), additive=True, least_alpha=0.0))
    assert [tuple(r)[1:] for r in added.collect()] == [(0.0, 0.0, 0.0, 0.0), (0.5, 64 / 255, 0.0, 1.0), (0.0, 0.0, 0.0, 1.0)]
    assert tuple(intensity.blended(added.unionAll(added).unionAll(added), "pixel").first()) == (1, 1.0, 192 / 255, 0.0)
