"""Particle tracks: segmentation, compilation, smoothing, trails and lookups in time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intensity import finite
from .ranks import before, in_ranges

EPSILON = 1e-3
COORDINATES = ("x", "y", "z", "amplitude")


def sets(rows: DataFrame) -> tuple[str, ...]:
    """The column that tells sets of tracks apart, where there is one: equal track numbers of two sets are two tracks."""
    return ("track_set",) if "track_set" in rows.columns else ()


def track_key(rows: DataFrame) -> tuple[str, ...]:
    return (*sets(rows), "source_track_id")


def segment_key(rows: DataFrame) -> tuple[str, ...]:
    return (*track_key(rows), "segment_index")


def track_id(track_set: str | Column, source: Column, segment: Column) -> Column:
    base = F.concat(F.lit(track_set), F.lit(":"), source.cast("string"))
    return F.when(segment > 0, F.concat(base, F.lit("-"), segment.cast("string"))).otherwise(base)


def segmented(rows: DataFrame) -> DataFrame:
    """Points with their segment: breaks end a segment, breaks in a row or at the start count once or not at all."""
    w = Window.partitionBy(*track_key(rows)).orderBy("row_idx")
    numbered = rows.withColumn("brk", F.sum(F.col("is_break").cast("int")).over(w)).where("not is_break")
    change = F.coalesce((F.lag("brk").over(w) != F.col("brk")).cast("int"), F.lit(0))
    return numbered.withColumn("change", change).select(*track_key(rows), F.sum("change").over(w).cast("int").alias("segment_index"), "row_idx", "time", "x", "y", "z", "amplitude")


def ordered(points: DataFrame) -> DataFrame:
    """Points numbered by time inside their segment; ties keep the file's order."""
    w = Window.partitionBy(*segment_key(points)).orderBy("time", "row_idx")
    return points.select("*", (F.row_number().over(w) - 1).alias("point_idx"))


def numbered(points: DataFrame) -> DataFrame:
    """As ``ordered``, by ranges of the order: no task sees a whole segment."""
    key = segment_key(points)
    dealt = in_ranges(points, (*key, "time", "row_idx"))
    found = before(dealt, F.col("_range"), ("time", "row_idx"), key, point_idx=F.lit(1).cast("long"))
    return found.select(*points.columns, F.col("point_idx").cast("int").alias("point_idx"))


#: Rows of a file, and track numbers, that make a bucket of ``summary``.
BUCKET_ROWS, BUCKET_TRACKS = 1_000_000, 10_000


def segments(points: DataFrame, track_set: str = "track-set-1") -> DataFrame:
    """One row a segment: identity, parent, counts, finite ranges and its first row in the file."""
    amplitude = finite(F.col("amplitude"))
    source, segment = F.col("source_track_id"), F.col("segment_index")
    name = F.col("track_set") if sets(points) else track_set
    per = points.groupBy(*segment_key(points)).agg(
        F.min("row_idx").alias("first_row"), F.count("*").alias("point_count"), F.min("time").alias("time_start"), F.max("time").alias("time_end"), F.min(amplitude).alias("amp_min"), F.max(amplitude).alias("amp_max")
    )
    return per.select(track_id(name, source, segment).alias("track_id"), F.when(segment > 0, track_id(name, source, segment - 1)).alias("parent_id"), *per.columns)


def summary(points: DataFrame, track_set: str = "track-set-1") -> DataFrame:
    """``segments`` with internal ids by first appearance in the file, and offsets of points and polyline segments.

    Ids and offsets need one order over all segments, which buckets of rows and
    of track numbers give.
    """
    per, by = segments(points, track_set), sets(points)
    numbered = before(per, F.floor(F.col("first_row") / BUCKET_ROWS), ("first_row",), by, earlier=F.lit(1).cast("long"))
    placed = before(numbered, F.floor(F.col("source_track_id") / BUCKET_TRACKS), ("source_track_id", "segment_index"), by, point_offset=F.col("point_count"), segment_offset=F.col("point_count") - 1)
    return placed.withColumn("internal_id", F.col("earlier") + 1).select(
        "track_id", "parent_id", "source_track_id", "segment_index", "internal_id", "point_count", "time_start", "time_end", "amp_min", "amp_max", "point_offset", "segment_offset", *by
    )


def polyline(points: DataFrame) -> DataFrame:
    """Consecutive pairs of points of each segment."""
    w = Window.partitionBy(*segment_key(points)).orderBy("point_idx")
    pairs = ordered(points).select("*", *(F.lag(c).over(w).alias(f"from_{c}") for c in ("time", "x", "y", "z")))
    return pairs.where("from_time is not null").select(*segment_key(points), "point_idx", *(f"from_{c}" for c in ("time", "x", "y", "z")), *(F.col(c).alias(f"to_{c}") for c in ("time", "x", "y", "z")))


def centroids(points: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Mean position of each group of nearly equal times; a group is anchored at its first time.

    A gap of more than epsilon always begins a group.  Between such gaps lie runs
    of near times; a run no wider than epsilon is one group, and only the times
    of wider runs are walked through, run by run.  Points then meet the anchors by
    a window, and means come from an ordinary aggregate.
    """
    key = segment_key(points)
    w = Window.partitionBy(*key).orderBy("time")
    times = points.select(*key, "time").distinct()
    begins = F.coalesce(F.col("time") - F.lag("time").over(w) > epsilon, F.lit(True))
    run = times.withColumn("begin", F.when(begins, F.col("time"))).withColumn("run", F.last("begin", ignorenulls=True).over(w)).drop("begin")
    spans = run.groupBy(*key, "run").agg((F.max("time") - F.min("time") > epsilon).alias("wide"))
    wide = run.join(spans.where("wide"), [*key, "run"], "left_semi")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(frame["time"].to_numpy())
        found, at = [], 0
        while at < len(t):
            found.append(t[at])
            far = min(len(t), int(np.searchsorted(t, t[at] + epsilon, "right")) + 1)  # rounding may move the end by a place
            near = max(at, far - 3)
            at = near + int(np.argmax(np.r_[t[near:far] - t[at] > epsilon, True]))
        return frame.iloc[: len(found)].assign(time=found)

    walked = wide.groupBy(*key, "run").applyInPandas(walk, wide.schema).select(*key, F.col("time").alias("anchor"))
    anchors = spans.where("not wide").select(*key, F.col("run").alias("anchor")).unionByName(walked)
    marked = points.select(*key, "time", "x", "y", "z", "amplitude", F.lit(None).cast("double").alias("anchor")).unionByName(
        anchors.select(*key, F.col("anchor").alias("time"), *(F.lit(None).cast("double").alias(c) for c in ("x", "y", "z", "amplitude")), "anchor")
    )
    w = Window.partitionBy(*key).orderBy("time", F.col("anchor").asc_nulls_last())
    placed = marked.withColumn("group_time", F.last("anchor", ignorenulls=True).over(w)).where("anchor is null")
    return placed.groupBy(*key, "group_time").agg(*(F.avg(c).alias(c) for c in ("x", "y", "z", "amplitude")), F.count("*").alias("n_points"))


def smoothed(points: DataFrame, sigma: float, columns: tuple[str, ...] = COORDINATES, piece: int | None = None) -> DataFrame:
    """Gaussian means over neighbours by index; weights are renormalized at the ends.

    A point with a coordinate that isn't finite lends nothing, and stays itself
    where nothing is near.  With ``piece`` long segments are spread over tasks:
    points are numbered by ranges of the order, and each piece of so many points
    gets copies of the points within reach of its ends.
    """
    key, order = segment_key(points), ("time", "row_idx")
    still = not sigma > 0 or sigma == float("inf")
    p = ordered(points) if piece is None else numbered(points)
    if still:
        return p
    radius = max(1, math.ceil(3 * sigma))
    near, parts, own = p, (), None
    if piece is not None:
        at = lambda shift: F.floor((F.col("point_idx") + shift) / piece)
        own = F.col("_piece") == at(0)
        near, parts, order = p.withColumn("_piece", F.explode(F.sequence(F.greatest(F.lit(0), at(-radius)), at(radius)))), ("_piece",), ("point_idx",)
        near = near.repartition(*key, *parts)
    # one segment after the other, which the numbering has sorted already where there are no pieces
    near = near.sortWithinPartitions(*key, *parts, *order)
    found = near.mapInArrow(lambda batches: _smoothed(batches, sigma, radius, columns), near.schema)
    return (found if own is None else found.where(own)).select(*p.columns)


def _smoothed(batches, sigma: float, radius: int, columns: tuple[str, ...]):
    """Rows in order of segment and point; of the stream only ``2 * radius`` rows and a batch are held.

    A row k places on is the point k numbers on just where both are of one run:
    numbers begin anew, and lower, with the next.
    """
    weight = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(radius + 1)]

    def means(held: pa.Table, low: int, high: int) -> pa.Table:
        index = held["point_idx"].to_numpy()
        values = np.stack([pc.fill_null(held[c], math.nan).to_numpy() for c in COORDINATES])
        lends = np.isfinite(values).all(0)
        picked = np.where(lends, values[[COORDINATES.index(c) for c in columns]], 0.0)
        total, sums = np.zeros(len(index)), np.zeros_like(picked)
        for k in range(min(radius + 1, len(index))):
            n = len(index) - k
            w = np.where(index[k:] == index[:n] + k, weight[k], 0.0)
            total[:n] += w * lends[k:]
            sums[:, :n] += w * picked[:, k:]
            if k:
                total[k:] += w * lends[:n]
                sums[:, k:] += w * picked[:, :n]
        some = total[low:high] > 0
        out = held.slice(low, high - low)
        for c, s in zip(columns, sums, strict=True):
            mean = pa.array(s[low:high] / np.where(some, total[low:high], 1.0))
            out = out.set_column(out.schema.get_field_index(c), out.schema.field(c), pc.if_else(pa.array(some), mean, out[c]))
        return out

    held, done = None, 0
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
        high = max(done, held.num_rows - radius)
        yield from means(held, done, high).to_batches()
        keep = max(0, high - radius)
        held, done = held.slice(keep), high - keep
    if held is not None:
        yield from means(held, done, held.num_rows).to_batches()


def trail(points: DataFrame, at: float, length: float | None) -> DataFrame:
    """Points of the window [at - length, at], with tolerance; without a length all earlier ones."""
    low = F.lit(True) if length is None else F.col("time") >= at - length - EPSILON
    return points.where((F.col("time") <= at + EPSILON) & low)


def overlapping(segments: DataFrame, low: float, high: float) -> DataFrame:
    """Polyline segments that touch a window of time."""
    return segments.where((F.col("to_time") >= low - EPSILON) & (F.col("from_time") <= high + EPSILON))


def as_of(centroid_rows: DataFrame, at: float, trail_length: float | None = None) -> DataFrame:
    """Each segment's last centroid at or before a time; none where it is older than the trail."""
    before = centroid_rows.where(F.col("group_time") <= at + EPSILON)
    key = segment_key(centroid_rows)
    last = before.groupBy(*key).agg(F.max_by(F.struct("group_time", "x", "y", "z", "amplitude"), "group_time").alias("c")).select(*key, "c.*")
    return last if trail_length is None else last.where(F.col("group_time") >= at - trail_length - EPSILON)


def as_of_join(queries: DataFrame, centroid_rows: DataFrame) -> DataFrame:
    """``queries`` (source_track_id, segment_index, at) with the last centroid at or before ``at``.

    One window over both sides instead of a range join: rows meet by segment.
    """
    key = segment_key(centroid_rows)
    q = queries.select(*key, (F.col("at") + EPSILON).alias("time"), "at", F.lit(None).cast("struct<group_time:double,x:double,y:double,z:double>").alias("c"))
    c = centroid_rows.select(*key, F.col("group_time").alias("time"), F.lit(None).cast("double").alias("at"), F.struct("group_time", "x", "y", "z").alias("c"))
    w = Window.partitionBy(*key).orderBy("time", F.col("at").asc_nulls_first())
    return q.unionByName(c).withColumn("c", F.last("c", ignorenulls=True).over(w)).where("at is not null").select(*key, "at", "c.*")


def visible(tracks: DataFrame, overrides: DataFrame, default: bool = True) -> DataFrame:
    """Tracks with ``is_visible``, an override or the default."""
    return tracks.join(overrides.select("track_id", F.col("visible").alias("_o")), "track_id", "left").withColumn("is_visible", F.coalesce("_o", F.lit(default))).drop("_o")


def renderable(is_visible: Column, followed: Column, selected: Column, opacity: Column) -> Column:
    return (followed | is_visible | selected) & ((opacity > 0) | followed | selected)


def render_set(shown: DataFrame, followed: DataFrame, selected: DataFrame) -> DataFrame:
    """The union of three track lists, each track once, where it comes first: track_id, source."""
    every = shown.select("track_id", F.lit(0).alias("source")).unionByName(followed.select("track_id", F.lit(1).alias("source"))).unionByName(selected.select("track_id", F.lit(2).alias("source")))
    return every.groupBy("track_id").agg(F.min("source").alias("source"))


def extents(points: DataFrame, sigma: float, chosen: DataFrame) -> DataFrame:
    """Time and amplitude range of chosen segments over raw and smoothed points."""
    some = points.join(chosen, list(segment_key(points)), "left_semi")
    both = some.select("time", "amplitude").unionByName(smoothed(some, sigma, ("amplitude",)).select("time", "amplitude"))
    return both.agg(F.min("time").alias("time_min"), F.max("time").alias("time_max"), F.min("amplitude").alias("amp_min"), F.max("amplitude").alias("amp_max"))
