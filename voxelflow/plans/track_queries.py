"""Queries over particle tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scales import golden_hue, hsl
from ..operators import tracks
from ..operators.ranks import ranked
from ..sources import tracks_csv
from ..sources.adapters import table, track_rows, with_tables
from ..streaming.run import shared_folder
from .registry import query, r6, rounded

TRK = with_tables("trk")
SEG = """brk AS (SELECT *, sum(is_break::INT) OVER (PARTITION BY source_track_id ORDER BY row_idx) AS b FROM trk),
    chg AS (SELECT *, coalesce((lag(b) OVER (PARTITION BY source_track_id ORDER BY row_idx) <> b)::INT, 0) AS c FROM brk WHERE NOT is_break),
    seg AS (SELECT source_track_id, sum(c) OVER (PARTITION BY source_track_id ORDER BY row_idx)::INT AS segment_index, row_idx, time, x, y, z, amplitude FROM chg),
    pts AS (SELECT *, (row_number() OVER (PARTITION BY source_track_id, segment_index ORDER BY time, row_idx) - 1)::INT AS point_idx FROM seg)"""
SUM = """per AS (SELECT source_track_id, segment_index, min(row_idx) AS first_row, count(*) AS point_count, min(time) AS time_start, max(time) AS time_end, min(amplitude) AS amp_min, max(amplitude) AS amp_max FROM seg GROUP BY ALL),
    trs AS (SELECT 'track-set-1:' || source_track_id || CASE WHEN segment_index > 0 THEN '-' || segment_index ELSE '' END AS track_id,
        CASE WHEN segment_index > 0 THEN 'track-set-1:' || source_track_id || CASE WHEN segment_index > 1 THEN '-' || (segment_index - 1) ELSE '' END END AS parent_id,
        source_track_id, segment_index, row_number() OVER (ORDER BY first_row) AS internal_id, point_count, time_start, time_end, amp_min, amp_max,
        coalesce(sum(point_count) OVER o, 0)::BIGINT AS point_offset, coalesce(sum(point_count - 1) OVER o, 0)::BIGINT AS segment_offset FROM per
        WINDOW o AS (ORDER BY source_track_id, segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
CEN = "cen AS (SELECT source_track_id, segment_index, time AS group_time, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(amplitude) AS amplitude, count(*) AS n_points FROM seg GROUP BY ALL)"


def points(spark, d):
    return tracks.segmented(track_rows(spark, d))


def summary(spark, d):
    return tracks.summary(points(spark, d))


def segments(spark, d):
    return tracks.segments(points(spark, d))


def centroids(spark, d):
    return tracks.centroids(points(spark, d))


@query("track_points", f"{TRK}, {SEG} SELECT * FROM pts")
def track_points(spark, d):
    return tracks.ordered(points(spark, d))


@query("track_summary", f"{TRK}, {SEG}, {SUM} SELECT * FROM trs")
def track_summary(spark, d):
    return summary(spark, d)


@query("track_totals", f"{TRK}, {SEG}, {SUM} SELECT count(*) AS n_tracks, sum(point_count)::BIGINT AS n_points, min(time_start) AS time_min, max(time_end) AS time_max, min(amp_min) AS amp_min, max(amp_max) AS amp_max FROM trs")
def track_totals(spark, d):
    return segments(spark, d).agg(F.count("*").alias("n_tracks"), F.sum("point_count").alias("n_points"), F.min("time_start").alias("time_min"), F.max("time_end").alias("time_max"), F.min("amp_min").alias("amp_min"), F.max("amp_max").alias("amp_max"))


LINES = """lin AS (SELECT * FROM (SELECT source_track_id, segment_index, point_idx, lag(time) OVER w AS from_time, lag(x) OVER w AS from_x, lag(y) OVER w AS from_y, lag(z) OVER w AS from_z,
    time AS to_time, x AS to_x, y AS to_y, z AS to_z FROM pts WINDOW w AS (PARTITION BY source_track_id, segment_index ORDER BY point_idx)) WHERE from_time IS NOT NULL)"""


@query("track_polylines", f"{TRK}, {SEG}, {LINES} SELECT * FROM lin")
def track_polylines(spark, d):
    return tracks.polyline(points(spark, d))


@query("segments_in_window", f"{TRK}, {SEG}, {LINES} SELECT * FROM lin WHERE to_time >= 240 - 0.001 AND from_time <= 300 + 0.001")
def segments_in_window(spark, d):
    return tracks.overlapping(tracks.polyline(points(spark, d)), 240.0, 300.0)


@query("track_centroids", f"{TRK}, {SEG}, {CEN} SELECT source_track_id, segment_index, group_time, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(amplitude, 6) AS amplitude, n_points FROM cen")
def track_centroids(spark, d):
    return rounded(centroids(spark, d), "x", "y", "z", "amplitude")


SMOOTH = """wgt AS (SELECT a.source_track_id, a.segment_index, a.point_idx, exp(-((b.point_idx - a.point_idx) ^ 2)::DOUBLE / 12.5) AS w, b.x, b.y, b.z, b.amplitude
    FROM pts a JOIN pts b ON a.source_track_id = b.source_track_id AND a.segment_index = b.segment_index AND b.point_idx BETWEEN a.point_idx - 8 AND a.point_idx + 8),
    smo AS (SELECT source_track_id, segment_index, point_idx, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w * z) / sum(w) AS z, sum(w * amplitude) / sum(w) AS amplitude FROM wgt GROUP BY ALL)"""


@query("smoothed_tracks", f"{TRK}, {SEG}, {SMOOTH} SELECT source_track_id, segment_index, point_idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(amplitude, 6) AS amplitude FROM smo")
def smoothed_tracks(spark, d):
    return rounded(tracks.smoothed(points(spark, d), 2.5).select("source_track_id", "segment_index", "point_idx", "x", "y", "z", "amplitude"), "x", "y", "z", "amplitude")


@query("smoothed_amplitudes", f"{TRK}, {SEG}, {SMOOTH} SELECT source_track_id, segment_index, point_idx, p.x, round(s.amplitude, 6) AS amplitude FROM smo s JOIN pts p USING (source_track_id, segment_index, point_idx)")
def smoothed_amplitudes(spark, d):
    return rounded(tracks.smoothed(points(spark, d), 2.5, ("amplitude",)).select("source_track_id", "segment_index", "point_idx", "x", "amplitude"), "amplitude")


@query("smoothed_in_pieces", f"{TRK}, {SEG}, {SMOOTH} SELECT source_track_id, segment_index, point_idx, round(x, 6) AS x, round(amplitude, 6) AS amplitude FROM smo")
def smoothed_in_pieces(spark, d):
    """Long segments in pieces of 64 points, with copies of their neighbours' ends."""
    return rounded(tracks.smoothed(points(spark, d), 2.5, ("x", "amplitude"), piece=64).select("source_track_id", "segment_index", "point_idx", "x", "amplitude"), "x", "amplitude")


@query("track_trail", f"{TRK}, {SEG} SELECT source_track_id, segment_index, row_idx, time FROM seg WHERE time BETWEEN 360 - 48 - 0.001 AND 360 + 0.001")
def track_trail(spark, d):
    return tracks.trail(points(spark, d), 360.0, 48.0).select("source_track_id", "segment_index", "row_idx", "time")


@query("trail_counts", f"{TRK}, {SEG} SELECT row_idx, count(*) OVER (PARTITION BY source_track_id, segment_index ORDER BY time RANGE BETWEEN 24 PRECEDING AND CURRENT ROW) AS n_trail FROM seg")
def trail_counts(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source_track_id", "segment_index").orderBy("time").rangeBetween(-24, 0)
    return points(spark, d).select("row_idx", F.count("*").over(w).alias("n_trail"))


@query(
    "centroid_as_of",
    f"""{TRK}, {SEG}, {CEN}, l AS (SELECT source_track_id, segment_index, max(group_time) AS group_time FROM cen WHERE group_time <= 360 + 0.001 GROUP BY ALL)
    SELECT source_track_id, segment_index, group_time, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(amplitude, 6) AS amplitude FROM l JOIN cen USING (source_track_id, segment_index, group_time) WHERE group_time >= 360 - 200 - 0.001""",
)
def centroid_as_of(spark, d):
    return rounded(tracks.as_of(centroids(spark, d), 360.0, 200.0), "x", "y", "z", "amplitude")


@query(
    "centroid_as_of_join",
    f"""{TRK}, {SEG}, {CEN}, q AS (SELECT DISTINCT source_track_id, segment_index, unnest([100.0, 300.0, 500.0])::DOUBLE AS at_time FROM seg)
    SELECT q.source_track_id, q.segment_index, at_time, group_time, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM q ASOF LEFT JOIN cen ON q.source_track_id = cen.source_track_id AND q.segment_index = cen.segment_index AND at_time + 0.001 >= group_time""",
)
def centroid_as_of_join(spark, d):
    q = points(spark, d).select("source_track_id", "segment_index").distinct().select("*", F.explode(F.array(F.lit(100.0), F.lit(300.0), F.lit(500.0))).alias("at"))
    return rounded(tracks.as_of_join(q, centroids(spark, d)).withColumnRenamed("at", "at_time"), "x", "y", "z")


@query("long_tracks", f"{TRK}, {SEG}, {SUM} SELECT track_id, point_count FROM trs WHERE point_count >= 8")
def long_tracks(spark, d):
    return segments(spark, d).where("point_count >= 8").select("track_id", "point_count")


@query("named_tracks", f"{TRK}, {SEG}, {SUM} SELECT track_id, n_name AS set_name, r_name AS channel_name FROM trs LEFT JOIN nation ON n_nationkey = source_track_id % 30 LEFT JOIN region ON r_regionkey = n_regionkey")
def named_tracks(spark, d):
    """Tracks with the names of their set and channel, null where there is none."""
    t = segments(spark, d).withColumn("set_key", F.col("source_track_id") % 30)
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    named = t.join(n, t["set_key"] == n["n_nationkey"], "left").join(r, F.col("n_regionkey") == r["r_regionkey"], "left")
    return named.select("track_id", F.col("n_name").alias("set_name"), F.col("r_name").alias("channel_name"))


VIS = """vis AS (SELECT track_id, point_count, source_track_id, CASE WHEN segment_index % 3 = 0 THEN segment_index % 2 = 0 ELSE true END AS is_visible FROM trs)"""


def visible(spark, d):
    t = summary(spark, d)
    overrides = t.where("segment_index % 3 = 0").select("track_id", (F.col("segment_index") % 2 == 0).alias("visible"))
    return tracks.visible(t, overrides)


@query("track_visibility", f"{TRK}, {SEG}, {SUM}, {VIS} SELECT track_id, is_visible, (source_track_id = 3 OR is_visible OR source_track_id = 5) AND (source_track_id % 4 > 0 OR source_track_id = 3 OR source_track_id = 5) AS is_rendered FROM vis")
def track_visibility(spark, d):
    s = F.col("source_track_id")
    return visible(spark, d).select("track_id", "is_visible", tracks.renderable(F.col("is_visible"), s == 3, s == 5, s % 4).alias("is_rendered"))


@query("track_counts_by_set", f"{TRK}, {SEG}, {SUM}, {VIS} SELECT source_track_id % 10 AS set_key, count(*) AS n_tracks, count(*) FILTER (is_visible) AS n_visible FROM vis GROUP BY 1")
def track_counts_by_set(spark, d):
    return visible(spark, d).groupBy((F.col("source_track_id") % 10).alias("set_key")).agg(F.count("*").alias("n_tracks"), F.count_if("is_visible").alias("n_visible"))


@query("render_set", f"{TRK}, {SEG}, {SUM}, {VIS}, u AS (SELECT track_id, 0 AS source FROM vis WHERE is_visible AND point_count >= 8 UNION ALL SELECT track_id, 1 FROM vis WHERE source_track_id = 3 UNION ALL SELECT track_id, 2 FROM vis WHERE source_track_id = 5) SELECT track_id, min(source)::INT AS source FROM u GROUP BY track_id")
def render_set(spark, d):
    v = visible(spark, d)
    return tracks.render_set(v.where("is_visible and point_count >= 8"), v.where("source_track_id = 3"), v.where("source_track_id = 5"))


@query("stale_tracks", f"{TRK}, {SEG}, {SUM} SELECT track_id FROM trs EXCEPT SELECT track_id FROM trs WHERE point_count >= 8")
def stale_tracks(spark, d):
    t = segments(spark, d)
    return t.select("track_id").subtract(t.where("point_count >= 8").select("track_id"))


@query("kept_selection", f"{TRK}, {SEG}, {SUM} SELECT track_id FROM trs WHERE source_track_id < 20 INTERSECT SELECT track_id FROM trs WHERE point_count >= 8")
def kept_selection(spark, d):
    t = segments(spark, d)
    return t.where("source_track_id < 20").select("track_id").intersect(t.where("point_count >= 8").select("track_id"))


@query("display_order", f"{TRK}, {SEG}, {SUM} SELECT track_id, row_number() OVER (ORDER BY CASE WHEN source_track_id = 5 THEN segment_index ELSE 1000000000 END, point_count DESC, internal_id) AS place FROM trs")
def display_order(spark, d):
    """Selected tracks first, in order of selection, then by length. One row a track."""
    first = F.when(F.col("source_track_id") == 5, F.col("segment_index")).otherwise(1_000_000_000)
    lengths = summary(spark, d).select("track_id", first.alias("first"), (-F.col("point_count")).alias("length"), "internal_id")
    return ranked(lengths, ("first", "length", "internal_id")).select("track_id", "place")


@query("selected_extents", f"{TRK}, {SEG}, {SMOOTH}, b AS (SELECT time, amplitude FROM pts WHERE source_track_id = 5 UNION ALL SELECT time, s.amplitude FROM smo s JOIN pts p USING (source_track_id, segment_index, point_idx) WHERE source_track_id = 5) SELECT min(time) AS time_min, max(time) AS time_max, round(min(amplitude), 6) AS amp_min, round(max(amplitude), 6) AS amp_max FROM b")
def selected_extents(spark, d):
    p = points(spark, d)
    return rounded(tracks.extents(p, 2.5, p.where("source_track_id = 5").select("source_track_id", "segment_index").distinct()), "amp_min", "amp_max")


@query("parent_links", f"{TRK}, {SEG}, {SUM} SELECT a.track_id, a.parent_id, b.point_count AS parent_points FROM trs a JOIN trs b ON a.parent_id = b.track_id")
def parent_links(spark, d):
    """Segments with their parent; the parent is the segment before, so the key is computed."""
    t = segments(spark, d)
    parent = t.select("source_track_id", (F.col("segment_index") + 1).alias("segment_index"), F.col("point_count").alias("parent_points"))
    return t.join(parent, ["source_track_id", "segment_index"]).select("track_id", "parent_id", "parent_points")


@query("offset_points", f"{TRK}, {SEG} SELECT row_idx, x + coalesce(CASE WHEN source_track_id % 30 < 25 THEN source_track_id % 30 END, 0) AS x, y - coalesce(CASE WHEN source_track_id % 30 < 25 THEN source_track_id % 30 END, 0) AS y FROM seg")
def offset_points(spark, d):
    """Points moved by the offset of the channel their set is bound to; unbound sets stay."""
    o = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_nationkey").cast("double").alias("dx"))
    p = points(spark, d)
    j = p.join(o, p["source_track_id"] % 30 == o["k"], "left")
    return j.select("row_idx", (F.col("x") + F.coalesce("dx", F.lit(0.0))).alias("x"), (F.col("y") - F.coalesce("dx", F.lit(0.0))).alias("y"))


@query("track_colors", f"""{TRK}, {SEG}, {SUM}, h AS (SELECT DISTINCT source_track_id, ((abs(source_track_id) + 1) * 137.508::DOUBLE) % 360 AS hue FROM trs)
    SELECT source_track_id, round(hue, 6) AS hue FROM h""")
def track_colors(spark, d):
    return segments(spark, d).select("source_track_id").distinct().select("source_track_id", r6(golden_hue(F.col("source_track_id"))).alias("hue"))


@query(
    "track_color_bytes",
    f"""{TRK}, {SEG}, {SUM}, h AS (SELECT DISTINCT source_track_id, ((abs(source_track_id) + 1) * 137.508::DOUBLE) % 360 AS hue FROM trs),
    k AS (SELECT source_track_id, n, (n + hue / 30) % 12 AS k FROM h, (VALUES ('red', 0), ('green', 8), ('blue', 4)) v(c, n)),
    c AS (SELECT source_track_id, n, floor((0.55::DOUBLE - 0.75 * 0.45 * greatest(-1, least(k - 3, 9 - k, 1))) * 255 + 0.5)::INT AS byte FROM k)
    SELECT source_track_id, max(byte) FILTER (n = 0) AS red, max(byte) FILTER (n = 8) AS green, max(byte) FILTER (n = 4) AS blue FROM c GROUP BY source_track_id""",
)
def track_color_bytes(spark, d):
    t = segments(spark, d).select("source_track_id").distinct()
    return t.select("source_track_id", *(c.alias(n) for c, n in zip(hsl(golden_hue(F.col("source_track_id")), 0.75, 0.55), ("red", "green", "blue"), strict=True)))


@query("lod_transitions", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 3600000000.0 AS h, (event_id % 3)::INT AS level FROM events), l AS (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY h, event_id) AS prev FROM e),
    t AS (SELECT *, level < prev AS up FROM l WHERE prev IS NOT NULL AND prev <> level), b AS (SELECT *, lag(h) OVER (PARTITION BY user_id, up ORDER BY h, event_id) AS same FROM t)
    SELECT user_id, count(*) FILTER (up) AS promotions, count(*) FILTER (NOT up) AS demotions FROM t GROUP BY user_id""")
def lod_transitions(spark, d):
    """Detail-level changes by viewer: to finer and to coarser levels."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 3).alias("level"))
    t = e.withColumn("prev", F.lag("level").over(w)).where("prev is not null and prev <> level")
    return t.groupBy("user_id").agg(F.count_if(F.col("level") < F.col("prev")).alias("promotions"), F.count_if(F.col("level") > F.col("prev")).alias("demotions"))


@query("thrash_events", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, (event_id % 3)::INT AS level FROM events), l AS (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY s, event_id) AS prev FROM e),
    t AS (SELECT *, level < prev AS up FROM l WHERE prev IS NOT NULL AND prev <> level),
    o AS (SELECT *, max(s) FILTER (NOT up) OVER w AS down_at, max(s) FILTER (up) OVER w AS up_at FROM t WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, count(*) FILTER (s - CASE WHEN up THEN down_at ELSE up_at END <= 43200) AS n_thrash FROM o GROUP BY user_id""")
def thrash_events(spark, d):
    """Changes against the direction of one at most twelve hours before, by viewer."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("s"), (F.col("event_id") % 3).alias("level"))
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    t = e.withColumn("prev", F.lag("level").over(w)).where("prev is not null and prev <> level").withColumn("up", F.col("level") < F.col("prev"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    o = t.withColumn("other", F.when(F.col("up"), F.max(F.when(~F.col("up"), F.col("s"))).over(before)).otherwise(F.max(F.when(F.col("up"), F.col("s"))).over(before)))
    return o.groupBy("user_id").agg(F.count_if(F.col("s") - F.col("other") <= 43200).alias("n_thrash"))


@query(
    "track_files",
    f"""{TRK} SELECT 'track-set-' || (source_track_id % 4 + 1) AS track_set, row_number() OVER (PARTITION BY source_track_id % 4 ORDER BY row_idx) - 1 AS row_idx, source_track_id, is_break,
        CASE WHEN NOT is_break THEN greatest(0.0, time) END AS time, x, y, z, CASE WHEN NOT is_break THEN greatest(0.0, amplitude) END AS amplitude FROM trk""",
)
def track_files(spark, d):
    """Four CSV files, each a set of tracks, written in the order of their rows and read back in splits."""
    folder = shared_folder(spark, "track-files")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_track_id", "time", "x", "y", "z", "amplitude")]
    rows = track_rows(spark, d)
    for k in range(4):
        line = F.concat_ws(",", cells[0], F.lit("0"), *cells[1:5], F.coalesce(F.col("amplitude").cast("string"), F.lit("0")), F.lit("0"))
        rows.where(F.col("source_track_id") % 4 == k).orderBy("row_idx").select(line.alias("value")).coalesce(1).write.text(f"{folder}/{k}")
    return tracks_csv.read_tracks(spark, f"{folder}/*").drop("file")
