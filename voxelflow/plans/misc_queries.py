"""Queries for scalar functions, catalogues and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scales, text
from ..operators.ranks import ranked
from ..sources.adapters import table
from . import validation
from .registry import query, r6


@query("name_keys", "SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS name_key FROM part")
def name_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", text.name_key(F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("name_key"))


@query("duplicate_names", "SELECT lower(trim(p_name)) AS name_key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    return table(spark, d, "part").groupBy(text.name_key(F.col("p_name")).alias("name_key")).agg(F.count("*").alias("n")).where("n > 1")


@query("number_lists", "SELECT n_nationkey, [n_nationkey::DOUBLE, 2.5::DOUBLE, 1000.0::DOUBLE] AS numbers FROM nation")
def number_lists(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.number_list(F.concat(F.col("n_nationkey").cast("string"), F.lit("; 2.5;;1e3 "))).alias("numbers"))


@query("finite_numbers", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value WHEN event_id % 4 = 1 THEN (event_id)::DOUBLE END AS number FROM events")
def finite_numbers(spark, d):
    e = F.col("event_id") % 4
    raw = F.when(e == 0, F.col("value").cast("string")).when(e == 1, F.col("event_id").cast("string")).when(e == 2, "NaN").otherwise(F.lit("x12"))
    return table(spark, d, "events").select("event_id", text.finite_number(raw).alias("number"))


@query("track_ids", "SELECT event_id, 's' || user_id % 5 || ':' || user_id || CASE WHEN event_id % 3 > 0 THEN '-' || event_id % 3 ELSE '' END AS track_id, 's' || user_id % 5 AS set_id FROM events")
def track_ids(spark, d):
    segment = F.col("event_id") % 3
    base = F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string"), F.lit(":"), F.col("user_id").cast("string"))
    made = F.when(segment > 0, F.concat(base, F.lit("-"), segment.cast("string"))).otherwise(base)
    return table(spark, d, "events").select("event_id", made.alias("track_id")).withColumn("set_id", text.track_set_of(F.col("track_id")))


@query("region_names", "SELECT n_nationkey, lpad((floor((n_nationkey % 20 + 3) / 2 + 0.5) + 1)::INT::VARCHAR, 2, '0') || '-' || lpad((n_nationkey % 25 + 1)::VARCHAR, 2, '0') || '-' || lpad((n_nationkey * 2 % 64 + 1)::VARCHAR, 2, '0') AS roi_name FROM nation")
def region_names(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", text.region_name((k % 20 + 3) / 2, k % 25, k * 2 % 64, (20, 25, 64)).alias("roi_name"))


@query("hex_colors", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '#aabbcc' WHEN 1 THEN '#12ef56' WHEN 2 THEN '#00ff00' ELSE '#3b82f6' END AS color FROM nation")
def hex_colors(spark, d):
    k = F.col("n_nationkey") % 4
    raw = F.when(k == 0, "#ABC").when(k == 1, " 12EF56 ").when(k == 2, "#0f0").otherwise("teal")
    return table(spark, d, "nation").select("n_nationkey", text.hex_color(raw, "#3b82f6").alias("color"))


@query("export_names", "SELECT p_partkey, 'a-' || regexp_replace(p_name, '\\s+', '_', 'g') || '-b' AS file_base FROM part")
def export_names(spark, d):
    return table(spark, d, "part").select("p_partkey", text.file_base(F.concat(F.lit(" a/:"), F.col("p_name"), F.lit("?b.TIF "))).alias("file_base"))


@query("export_entries", "SELECT event_id, lpad((event_id + 1)::VARCHAR, greatest(3, length((SELECT count(*) FROM events)::VARCHAR))::INT, '0') AS entry FROM events")
def export_entries(spark, d):
    e = table(spark, d, "events")
    n = e.agg(F.greatest(F.lit(3), F.length(F.count("*").cast("string"))).alias("width"))
    return e.join(F.broadcast(n)).select("event_id", F.expr("lpad(cast(event_id + 1 as string), width, '0')").alias("entry"))


@query("natural_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM part")
def natural_order(spark, d):
    """Names with numbers in them, in the order people expect; one row a file."""
    p = table(spark, d, "part").select("p_partkey", text.natural_key(F.concat(F.lit("Scan_T"), F.col("p_partkey").cast("string"), F.lit(".tif"))).alias("k"))
    return ranked(p, ("k", "p_partkey")).select("p_partkey", "place")


@query("deduped_files", "SELECT p_brand AS path, min(p_partkey) AS first_key FROM part GROUP BY p_brand")
def deduped_files(spark, d):
    """The first file of each path."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.min("p_partkey").alias("first_key"))


@query("layer_groups", "SELECT split_part(p_type, ' ', 1) AS layer, count(*) AS n_files FROM part GROUP BY 1")
def layer_groups(spark, d):
    """Files by their top folder."""
    path = F.concat(F.split("p_type", " ")[0], F.lit("/"), F.col("p_name"))
    return table(spark, d, "part").groupBy(F.split(path, "/")[0].alias("layer")).agg(F.count("*").alias("n_files"))


@query("layer_seeds", """WITH RECURSIVE f AS (SELECT n_name, 0 AS i, 2166136261::BIGINT AS h FROM nation UNION ALL SELECT n_name, i + 1, (xor(h, ascii(substr(n_name, i + 1, 1))::BIGINT) * 16777619) & 4294967295 FROM f WHERE i < length(n_name))
    SELECT n_name, CASE WHEN h = 0 THEN 3735928559 ELSE h END AS seed FROM f WHERE i = length(n_name)""")
def layer_seeds(spark, d):
    return table(spark, d, "nation").select("n_name", text.fnv1a(F.col("n_name")).alias("seed"))


@query(
    "checksums",
    """WITH RECURSIVE f AS (SELECT p_partkey, p_name, 0 AS i, 4294967295::BIGINT AS c FROM part
        UNION ALL SELECT p_partkey, p_name, i + 1, list_reduce([xor(c, ascii(substr(p_name, i + 1, 1))::BIGINT), 0, 1, 2, 3, 4, 5, 6, 7], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM f WHERE i < length(p_name))
    SELECT p_partkey, xor(c, 4294967295) AS crc FROM f WHERE i = length(p_name)""",
)
def crc(spark, d):
    return table(spark, d, "part").select("p_partkey", F.crc32(F.col("p_name").cast("binary")).alias("crc"))


@query("zero_based_times", "SELECT event_id, (event_id % 50)::DOUBLE AS t FROM events")
def zero_based_times(spark, d):
    return table(spark, d, "events").select("event_id", text.zero_based((F.col("event_id") % 50 + 1).cast("double")).alias("t"))


@query("intensity_texts", "SELECT event_id, CASE WHEN value >= 1000 THEN printf('%.1f', value) WHEN value >= 1 THEN printf('%.3f', value) WHEN value >= 0.1 THEN printf('%.4f', value) ELSE printf('%.5f', value) END AS shown, floor(value + 0.5)::BIGINT::VARCHAR AS whole FROM events")
def intensity_texts(spark, d):
    return table(spark, d, "events").select("event_id", text.intensity_text(F.col("value"), False, zero="0.00000").alias("shown"), text.intensity_text(F.col("value"), True).alias("whole"))


@query("channel_values", "SELECT n_nationkey, [n_name || ' C1 1', n_name || ' C2 2'] AS shown FROM nation")
def channel_values(spark, d):
    values = F.array(F.lit(1.0), F.lit(2.0))
    shown = F.transform(values, lambda v, i: F.concat(F.col("n_name"), F.lit(" C"), (i + 1).cast("string"), F.lit(" "), text.intensity_text(v, True)))
    return table(spark, d, "nation").select("n_nationkey", shown.alias("shown"))


@query("nice_axes", """WITH a AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id), r AS (SELECT *, (hi - lo) / 5 AS raw FROM a), f AS (SELECT *, pow(10, floor(log10(raw))) AS e FROM r WHERE hi > lo),
    s AS (SELECT *, CASE WHEN raw / e <= 1 THEN 1 WHEN raw / e <= 2 THEN 2 WHEN raw / e <= 5 THEN 5 ELSE 10 END * e AS step FROM f) SELECT user_id, round(step, 6) AS step, round(floor(lo / step) * step, 6) AS low, round(ceil(hi / step) * step, 6) AS high FROM s""")
def nice_axes(spark, d):
    a = table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("hi > lo")
    low, high = scales.nice_bounds(F.col("lo"), F.col("hi"), 5)
    return a.select("user_id", r6(scales.nice_step(F.col("hi") - F.col("lo"), 5)).alias("step"), r6(low).alias("low"), r6(high).alias("high"))


@query("unit_lengths", "SELECT n_nationkey, round(10 * 1e-6 / (n_nationkey + 1.0) / [1e-10, 1e-9, 1e-6, 1e-3][n_nationkey % 4 + 1], 6) AS voxels, printf('%.2f', n_nationkey * 2.5::DOUBLE) || ' ms' AS shown FROM nation")
def unit_lengths(spark, d):
    k = F.col("n_nationkey")
    unit = F.element_at(F.array(*map(F.lit, scales.LENGTHS)), k % 4 + 1)
    return table(spark, d, "nation").select("n_nationkey", r6(scales.voxel_length(F.lit(10.0), F.lit("μm"), k + 1.0, unit)).alias("voxels"), scales.timepoint_text(k + 1, F.lit(2.5), F.lit("ms")).alias("shown"))


@query("signed_angles", "SELECT event_id, round(((value * 3 + 180) % 360 + 360) % 360 - 180, 6) AS angle FROM events")
def signed_angles(spark, d):
    return table(spark, d, "events").select("event_id", r6(scales.signed_degrees(F.col("value") * 3)).alias("angle"))


@query("display_coordinates", "SELECT event_id, least(63, floor(greatest(0, least(99, floor(value - 20 + 0.5))) / 100 * 64))::INT AS at FROM events".replace(" AS at", " AS place"))
def display_coordinates(spark, d):
    return table(spark, d, "events").select("event_id", scales.data_coordinate(F.col("value") - 20, 100, 64).alias("place"))


LOD = "greatest(0, least(4, log2(greatest(value / 20, 1.0)) * 1.1::DOUBLE))"


@query("detail_levels", f"SELECT event_id, round({LOD} * 0.95::DOUBLE, 6) AS iso, round({LOD} * (0.7::DOUBLE - 0.3::DOUBLE * 0.25), 6) AS absorbed, round({LOD} * 0.7::DOUBLE, 6) AS brightest FROM events")
def detail_levels(spark, d):
    level = lambda mode: r6(scales.detail_level(F.col("value") / 20, F.lit(0.0), F.lit(0.3), mode, 1.1, 4.0))
    return table(spark, d, "events").select("event_id", level("iso").alias("iso"), level("bl").alias("absorbed"), level("mip").alias("brightest"))


@query("detail_bands", "SELECT event_id, CASE WHEN l < 1 THEN 0 ELSE floor(l) END::INT AS low, CASE WHEN l < 1 THEN 0 ELSE least(floor(l) + 1, 4) END::INT AS high, round(CASE WHEN l < 1 OR floor(l) >= 4 THEN 0 ELSE l - floor(l) END, 6) AS blend FROM (SELECT event_id, least(4.0::DOUBLE, value / 60) AS l FROM events)")
def detail_bands(spark, d):
    low, high, blend = scales.detail_band(F.col("value") / 60, 4)
    return table(spark, d, "events").select("event_id", low.alias("low"), high.alias("high"), r6(blend).alias("blend"))


@query("downsample_sizes", "SELECT n_nationkey, round(cbrt((n_nationkey % 3 + 1) * 2 * (n_nationkey + 1)), 6) AS size FROM nation")
def downsample_sizes(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", r6(scales.downsample_size(k % 3 + 1, F.lit(2), k + 1)).alias("size"))


@query("ordered_channels", "SELECT p_brand AS channel, min(p_partkey) AS position, min(p_partkey) = (SELECT min(p_partkey) FROM part) AS is_default FROM part GROUP BY p_brand")
def ordered_channels(spark, d):
    """Distinct channels by first appearance; the first is shown at the start."""
    p = table(spark, d, "part")
    first = p.agg(F.min("p_partkey").alias("first"))
    return p.groupBy(F.col("p_brand").alias("channel")).agg(F.min("p_partkey").alias("position")).join(F.broadcast(first)).select("channel", "position", (F.col("position") == F.col("first")).alias("is_default"))


@query("visible_layers", "SELECT p_partkey, p_brand FROM part LEFT JOIN (SELECT n_nationkey, n_nationkey % 2 = 0 AS vis FROM nation) ON n_nationkey = p_size WHERE coalesce(vis, true)")
def visible_layers(spark, d):
    """Layers whose channel isn't hidden; channels without a setting are shown."""
    v = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 2 == 0).alias("vis"))
    p = table(spark, d, "part")
    return p.join(v, p["p_size"] == v["n_nationkey"], "left").where(F.coalesce("vis", F.lit(True))).select("p_partkey", "p_brand")


@query("prefetch_best", """WITH c AS (SELECT event_id, user_id AS t, event_id % 7 AS step, CASE WHEN event_id % 7 = 0 THEN 300 WHEN event_id % 7 <= 2 THEN 200 ELSE 100 END - 8 * (event_id % 7) AS score FROM events)
    SELECT t, score::BIGINT AS score, event_id FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, event_id) AS k FROM c) WHERE k = 1""")
def prefetch_best(spark, d):
    """The best candidate of each timepoint: what is seen now before what comes soon, near before far."""
    step = F.col("event_id") % 7
    score = (F.when(step == 0, 300).when(step <= 2, 200).otherwise(100) - 8 * step).alias("score")
    c = table(spark, d, "events").select("event_id", F.col("user_id").alias("t"), score)
    return c.groupBy("t").agg(F.max_by(F.struct("score", "event_id"), F.struct("score", -F.col("event_id"))).alias("b")).select("t", "b.score", "b.event_id")


@query("bricks_by_distance", "SELECT p_partkey, row_number() OVER (ORDER BY pow(p_size - 25, 2) + pow(p_partkey % 40 - 20, 2), p_partkey) AS place FROM part QUALIFY place <= 50")
def bricks_by_distance(spark, d):
    """The fifty bricks nearest the camera, ties by number: a top-k report."""
    p = table(spark, d, "part").select("p_partkey", (F.pow(F.col("p_size") - 25, 2) + F.pow(F.col("p_partkey") % 40 - 20, 2)).alias("distance"))
    near = p.orderBy("distance", "p_partkey").limit(50)
    return near.select("p_partkey", F.row_number().over(Window.orderBy("distance", "p_partkey")).cast("long").alias("place"))


@query("edit_history", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def edit_history(spark, d):
    """The last hundred edits, which undo can reach."""
    return table(spark, d, "events").select("event_id").orderBy(F.col("event_id").desc()).limit(100)


@query("access_diagnostics", "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS misses, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS miss_rate, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def access_diagnostics(spark, d):
    """Miss rates and latencies of a log of accesses."""
    miss = F.col("event_id") % 3 == 0
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(miss).alias("misses"), r6(F.count_if(miss) / F.count("*")).alias("miss_rate"), r6(F.avg("value")).alias("mean"), r6(F.median("value")).alias("median"), r6(F.percentile("value", 0.95)).alias("p95")
    )


@query("canonical_dims", "SELECT p_brand, max(p_size) AS width, max(p_partkey % 30)::BIGINT AS height FROM part GROUP BY p_brand")
def canonical_dims(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("width"), F.max(F.col("p_partkey") % 30).alias("height"))


@query("timepoint_mismatch", "SELECT count(DISTINCT n) FILTER (n > 0) > 1 AS mismatch FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def timepoint_mismatch(spark, d):
    n = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return n.agg((F.countDistinct(F.when(F.col("n") > 0, F.col("n"))) > 1).alias("mismatch"))


@query("props_at_timepoint", "SELECT n_nationkey, 7 BETWEEN least(n_nationkey, n_nationkey * 5 % 13) AND greatest(n_nationkey, n_nationkey * 5 % 13) AS is_visible FROM nation")
def props_at_timepoint(spark, d):
    """Annotations whose range, in either order, holds timepoint 7."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", F.lit(7).between(F.least(k, k * 5 % 13), F.greatest(k, k * 5 % 13)).alias("is_visible"))


@query(
    "brush_offsets",
    """WITH b AS (SELECT DISTINCT p_size % 5 AS radius FROM part), r AS (SELECT radius, unnest(range(-radius, radius + 1)) AS v FROM b)
    SELECT radius, a.v AS dz, b.v AS dy, c.v AS dx FROM r a JOIN r b USING (radius) JOIN r c USING (radius) WHERE a.v * a.v + b.v * b.v + c.v * c.v < greatest(1, radius * radius)""",
)
def brush_offsets(spark, d):
    """Offsets inside the ball of each brush in use."""
    ball = table(spark, d, "part").select((F.col("p_size") % 5).cast("long").alias("radius")).distinct()
    for c in ("dz", "dy", "dx"):
        ball = ball.select("*", F.explode(F.sequence(-F.col("radius"), F.col("radius"))).alias(c))
    return ball.where("dz * dz + dy * dy + dx * dx < greatest(1, radius * radius)")


@query("outline_vertices", "WITH i AS (SELECT unnest(range(48))::INT AS i) SELECT n_nationkey, i, round(n_nationkey + 3 * cos(2 * pi() * i / 48), 6) AS x, round(n_nationkey + 2 * sin(2 * pi() * i / 48), 6) AS y FROM nation, i")
def outline_vertices(spark, d):
    """Forty-eight points around each ellipse."""
    n = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("i"))
    angle = 2 * F.pi() * F.col("i") / 48
    return n.select("n_nationkey", "i", r6(F.col("n_nationkey") + 3 * F.cos(angle)).alias("x"), r6(F.col("n_nationkey") + 2 * F.sin(angle)).alias("y"))


@query("row_strides", "SELECT n_nationkey, [(n_nationkey + 2) * (n_nationkey + 3), n_nationkey + 3, 1]::BIGINT[] AS strides FROM nation")
def row_strides(spark, d):
    shape = F.array(*((F.col("n_nationkey") + i).cast("long") for i in (1, 2, 3)))
    tail = lambda i: F.aggregate(F.slice(shape, i + 2, F.lit(3)), F.lit(1).cast("long"), lambda a, b: a * b)
    return table(spark, d, "nation").select("n_nationkey", F.transform(F.sequence(F.lit(0), F.lit(2)), tail).alias("strides"))


# validation over derived manifests


def _manifest(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("key"),
        (k % 20).alias("channel"),
        F.array(k % 3 * 4 + 4, F.lit(8)).alias("shard"),
        F.array(F.when(k % 5 == 0, 3).otherwise(4), F.lit(8)).alias("chunk"),
        F.when(k % 6 == 0, 12).otherwise(16).alias("bz"),
        F.lit(64).alias("by"),
        F.when(k % 7 == 0, 128).otherwise(64).alias("bx"),
        (k % 4).alias("low"),
        (k % 3).alias("high"),
        F.col("n_regionkey").alias("region"),
    )


@query(
    "manifest_violations",
    """WITH m AS (SELECT n_nationkey AS k, n_nationkey % 20 AS channel, n_regionkey FROM nation)
    SELECT 'channel-unique' AS rule, channel::VARCHAR AS key FROM m GROUP BY channel HAVING count(*) > 1
    UNION ALL SELECT 'channel-region', n_regionkey::VARCHAR FROM m WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 4)
    UNION ALL SELECT 'shard-divides', k::VARCHAR FROM m WHERE (k % 3 * 4 + 4) % CASE WHEN k % 5 = 0 THEN 3 ELSE 4 END <> 0
    UNION ALL SELECT 'brick-size', k::VARCHAR FROM m WHERE k % 6 = 0 OR 16 * 64 * CASE WHEN k % 7 = 0 THEN 128 ELSE 64 END > 65536
    UNION ALL SELECT 'track-range', k::VARCHAR FROM m WHERE k % 4 > k % 3
    UNION ALL SELECT 'one-volume', c::VARCHAR FROM (SELECT unnest(range(25)) AS c) WHERE (SELECT count(*) FROM m WHERE channel = c) <> 1""",
)
def manifest_violations(spark, d):
    m = _manifest(spark, d)
    every = spark.range(25).select(F.col("id").cast("int").alias("channel"))
    found = [
        validation.unique(m, "channel-unique", "channel").select("rule", F.col("key").cast("string").alias("key")),
        validation.references(m, "channel-region", "region", table(spark, d, "region").where("r_regionkey < 4"), "r_regionkey"),
        validation.shards(m),
        validation.brick_sizes(m),
        validation.ranges(m, "track-range", "key", "low", "high"),
        validation.one_per_group(m, "one-volume", "channel", every),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query(
    "hierarchy_violations",
    """WITH l AS (SELECT n_nationkey AS key, level, CASE WHEN n_nationkey % 4 = 0 AND level = 2 THEN 3 ELSE level END AS lv, ceil(16 / pow(2, level))::INT + CASE WHEN n_nationkey % 5 = 0 AND level = 1 THEN 1 ELSE 0 END AS g FROM nation, (SELECT unnest(range(3)) AS level)),
    w AS (SELECT *, row_number() OVER o AS n, lag(g) OVER o AS p FROM l WINDOW o AS (PARTITION BY key ORDER BY lv))
    SELECT 'hierarchy' AS rule, key || '/' || lv AS key FROM w WHERE NOT (lv = n - 1 AND (n = 1 OR g = ceil(p / 2)))""",
)
def hierarchy_violations(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(k.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("l"))
    g = (F.ceil(16 / F.pow(F.lit(2.0), F.col("l"))) + F.when((F.col("key") % 5 == 0) & (F.col("l") == 1), 1).otherwise(0)).cast("int")
    levels = rows.select("key", F.when((F.col("key") % 4 == 0) & (F.col("l") == 2), 3).otherwise(F.col("l")).alias("level"), g.alias("gz"), g.alias("gy"), g.alias("gx"))
    return validation.hierarchy(levels)


@query(
    "payload_violations",
    """WITH v AS (SELECT l_suppkey % 10 AS brick, l_partkey % 70 AS o, l_orderkey % 50 AS label FROM lineitem)
    SELECT 'payload-offset' AS rule, brick || '/' || o AS key FROM v WHERE o > 63 UNION ALL SELECT 'payload-label', brick || '/' || o FROM v WHERE label = 0
    UNION ALL SELECT 'payload-twice', brick || '/' || o FROM v GROUP BY brick, o HAVING count(*) > 1""",
)
def payload_violations(spark, d):
    v = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("brick"), (F.col("l_partkey") % 70).alias("offset"), (F.col("l_orderkey") % 50).alias("label"))
    return validation.payload(v, 64)


@query("checksum_violations", "SELECT 'checksum' AS rule, p_partkey::VARCHAR AS key FROM part WHERE p_partkey % 17 = 0")
def checksum_violations(spark, d):
    stored = F.crc32(F.col("p_name").cast("binary")) + F.when(F.col("p_partkey") % 17 == 0, 1).otherwise(0)
    return validation.checksums(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("body"), stored.alias("crc")))


@query("page_violations", "SELECT 'page-slot' AS rule, n_nationkey::VARCHAR AS key FROM nation WHERE (n_nationkey % 3 > 0) <> (n_nationkey % 4 > 0)")
def page_violations(spark, d):
    k = F.col("n_nationkey")
    return validation.page_slots(table(spark, d, "nation").select(k.alias("brick"), (k % 3).alias("n_occupied"), F.when(k % 4 > 0, k).otherwise(-1).alias("slot")))


@query("timepoint_violations", "SELECT 'timepoints' AS rule, count(DISTINCT n) || '/' || min(n) AS key FROM (SELECT count(*) AS n FROM part GROUP BY p_brand) HAVING count(DISTINCT n) <> 1 OR min(n) <= 0")
def timepoint_violations(spark, d):
    return validation.equal_timepoints(table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("timepoints")))


@query("scale_levels", "SELECT DISTINCT o_orderpriority[1]::INT - 1 AS scale FROM orders ORDER BY 1")
def scale_levels(spark, d):
    """The distinct scale levels in use, in order."""
    return table(spark, d, "orders").select((F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("scale")).distinct().orderBy("scale")


@query("natural_order_long", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_partkey % 2 = 0 THEN 20240101000000 + p_partkey ELSE 9000000000000 - p_partkey END) AS place FROM part")
def natural_order_long(spark, d):
    """Names with time stamps of thirteen and fourteen digits; one row a file."""
    k = F.col("p_partkey")
    stamp = F.when(k % 2 == 0, F.lit(20240101000000) + k).otherwise(F.lit(9000000000000) - k)
    p = table(spark, d, "part").select("p_partkey", text.natural_key(F.concat(F.lit("f"), stamp.cast("string"), F.lit(".tif"))).alias("k"))
    return ranked(p, ("k", "p_partkey")).select("p_partkey", "place")


@query("warm_up_frames", "SELECT o_orderkey, o_custkey % 40 AS frame, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(target, 1000000), o_orderkey) AS place FROM orders LEFT JOIN (SELECT n_nationkey AS frame_key, n_nationkey * 7 % 25 AS target FROM nation) ON o_custkey % 40 = frame_key")
def warm_up_frames(spark, d):
    """Frames in the order of a target list, those that it lacks last."""
    targets = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("frame"), (F.col("n_nationkey") * 7 % 25).alias("target"))
    frames = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 40).alias("frame")).join(F.broadcast(targets), "frame", "left")
    w = Window.partitionBy("o_custkey").orderBy(F.coalesce("target", F.lit(1_000_000)), "o_orderkey")
    return frames.select("o_orderkey", "frame", F.row_number().over(w).cast("long").alias("place"))


FITTED = """w AS (SELECT event_id, greatest(0::DOUBLE, least(100::DOUBLE, value - 10)) AS a, greatest(0::DOUBLE, least(100::DOUBLE, value + event_id % 30 - 10)) AS b FROM events),
    f AS (SELECT event_id, CASE WHEN b - a < 1e-4 THEN greatest(0::DOUBLE, least(100 - 1e-4, (a + b) / 2 - 5e-5)) ELSE a END AS lo, CASE WHEN b - a < 1e-4 THEN greatest(0::DOUBLE, least(100 - 1e-4, (a + b) / 2 - 5e-5)) + 1e-4 ELSE b END AS hi FROM w)"""


def _windows(spark, d):
    start, end = scales.fitted_window(F.col("value") - 10, F.col("value") + F.col("event_id") % 30 - 10, 0.0, 100.0)
    return table(spark, d, "events").select("event_id", start.alias("lo"), end.alias("hi"))


#: Places of each slider in the queries below.
SLIDER_STEPS = 256


@query(
    "slider_places",
    f"""WITH {FITTED}, s AS (SELECT *, (hi - lo) / 100 AS share FROM f)
    SELECT event_id, least(255, floor(lo / 100 * 255 + 0.5))::INT AS low, least(255, floor(hi / 100 * 255 + 0.5))::INT AS high, least(256, floor((100 - (lo + (hi - lo) / 2)) / 100 * 256 + 0.5))::INT AS brightness,
        least(256, floor(CASE WHEN share < 1 THEN 256 - share * 128 ELSE 128 / share END + 0.5))::INT AS contrast FROM s""",
)
def slider_places(spark, d):
    """Where the sliders of each contrast window stand."""
    places = scales.slider_places(F.col("lo"), F.col("hi"), 0.0, 100.0, SLIDER_STEPS)
    return _windows(spark, d).select("event_id", *(c.alias(n) for n, c in places.items()))


@query(
    "moved_windows",
    f"""WITH {FITTED}, m AS (SELECT event_id, lo, hi, event_id % 257 AS k, 100 * (256 - event_id % 257) / 256.0::DOUBLE AS c, CASE WHEN event_id % 257 <= 128 THEN event_id % 257 / 128.0::DOUBLE WHEN event_id % 257 < 256 THEN 128.0::DOUBLE / (256 - event_id % 257) END AS slope FROM f),
    r AS (SELECT event_id, greatest(0::DOUBLE, c - (hi - lo) / 2) AS blo, least(100::DOUBLE, c + (hi - lo) / 2) AS bhi, greatest(0::DOUBLE, coalesce(lo + (hi - lo) / 2 - 50 / nullif(slope, 0), lo)) AS clo, least(100::DOUBLE, coalesce(lo + (hi - lo) / 2 + 50 / nullif(slope, 0), hi)) AS chi FROM m)
    SELECT event_id, round(CASE WHEN bhi - blo < 1e-4 THEN greatest(0::DOUBLE, least(100 - 1e-4, (blo + bhi) / 2 - 5e-5)) ELSE blo END, 6) AS bright_low, round(CASE WHEN bhi - blo < 1e-4 THEN greatest(0::DOUBLE, least(100 - 1e-4, (blo + bhi) / 2 - 5e-5)) + 1e-4 ELSE bhi END, 6) AS bright_high,
        round(clo, 6) AS contrast_low, round(chi, 6) AS contrast_high FROM r""",
)
def moved_windows(spark, d):
    """Windows after a move of the brightness slider, and of the contrast slider."""
    place, steps = F.col("event_id") % 257, SLIDER_STEPS
    bright = scales.at_brightness(F.col("lo"), F.col("hi"), place, 0.0, 100.0, steps)
    contrast = scales.at_contrast(F.col("lo"), F.col("hi"), place, 0.0, 100.0, steps)
    named = zip(("bright_low", "bright_high", "contrast_low", "contrast_high"), (*bright, *contrast), strict=True)
    return _windows(spark, d).select("event_id", *(r6(c).alias(n) for n, c in named))


@query(
    "skip_nodes",
    """WITH p AS (SELECT event_id, value AS v, (event_id % 3 - 1) * 0.5::DOUBLE AS step, 16 * pow(2, event_id % 4) AS w FROM events), n AS (SELECT *, greatest(0, least(ceil(150 / w) - 1, floor(greatest(0, least(149.999::DOUBLE, v)) / w)))::INT AS node FROM p)
    SELECT event_id, node, node * w AS first, least((node + 1) * w, 150) AS "end", round(CASE WHEN step > 0 THEN (least((node + 1) * w, 150) - v) / step WHEN step < 0 THEN (node * w - v) / step END, 6) AS steps FROM n""",
)
def skip_nodes(spark, d):
    """The hierarchy node of each place along an axis of 150 voxels, and a ray's steps until it leaves it."""
    level = F.col("event_id") % 4
    b = scales.node_bounds(F.col("value"), 150, 16, level, F.ceil(150 / (16 * F.pow(F.lit(2.0), level))))
    step = (F.col("event_id") % 3 - 1) * 0.5
    return table(spark, d, "events").select("event_id", *(c.alias(n) for n, c in b.items()), r6(scales.steps_to_exit(F.col("value"), step, b["first"], b["end"])).alias("steps"))


@query(
    "label_palettes",
    """WITH l AS (SELECT n_nationkey, unnest(range(64)) AS label FROM nation), s AS (SELECT *, (CASE WHEN n_nationkey = 0 THEN 1831565813 ELSE n_nationkey * 7919 END + label * 1831565813::BIGINT) & 4294967295 AS s FROM l),
    a AS (SELECT *, ((xor(s, s >> 15)::HUGEINT * (s | 1)) % 4294967296)::BIGINT AS t FROM s), b AS (SELECT *, xor(t, (t + (xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296)::BIGINT & 4294967295) AS u FROM a),
    h AS (SELECT n_nationkey, label, xor(u, u >> 14) / 4294967296.0::DOUBLE * 6 AS hue FROM b), k AS (SELECT *, floor(hue)::INT AS k, 1 - abs(hue % 2 - 1) AS m FROM h)
    SELECT n_nationkey, label::INT AS label, CASE WHEN label = 0 THEN 0 ELSE floor(CASE WHEN k IN (0, 5) THEN 1 WHEN k IN (1, 4) THEN m ELSE 0 END * 255 + 0.5)::INT END AS red, CASE WHEN label = 0 THEN 0 ELSE floor(CASE WHEN k IN (1, 2) THEN 1 WHEN k IN (0, 3) THEN m ELSE 0 END * 255 + 0.5)::INT END AS green,
        CASE WHEN label = 0 THEN 0 ELSE floor(CASE WHEN k IN (3, 4) THEN 1 WHEN k IN (2, 5) THEN m ELSE 0 END * 255 + 0.5)::INT END AS blue FROM k""",
)
def label_palettes(spark, d):
    """Colours of 64 labels in the palette of each seed."""
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("label"))
    colours = scales.label_palette(F.col("n_nationkey").cast("long") * 7919, F.col("label"))
    return rows.select("n_nationkey", "label", *(c.alias(n) for n, c in zip(("red", "green", "blue"), colours, strict=True)))


@query("payload_order_violations", "SELECT 'payload-order' AS rule, l_orderkey || '/' || l_linenumber AS key FROM (SELECT *, lag(l_partkey % 70) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 70) AS p FROM lineitem) WHERE p >= l_partkey % 70")
def payload_order_violations(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("brick"), F.col("l_linenumber").alias("place"), (F.col("l_partkey") % 70).alias("offset"))
    return validation.payload_order(v)


@query(
    "scale_violations",
    """WITH s AS (SELECT n_nationkey AS k, unnest(range(2)) AS level FROM nation)
    SELECT 'scale-base' AS rule, k || '/' || level AS key FROM s WHERE level = 0 AND k % 4 = 1 UNION ALL SELECT 'scale-shape', k || '/' || level FROM s WHERE k % 5 = 2
    UNION ALL SELECT 'scale-factor', k || '/' || level FROM s WHERE k % 6 = 3 AND level = 1 UNION ALL SELECT 'subcell-grid', k || '/' || level FROM s WHERE k % 7 = 4 OR k % 7 = 5""",
)
def scale_violations(spark, d):
    k = F.col("n_nationkey").cast("int")
    n = table(spark, d, "nation")
    layers = n.select(k.alias("key"), F.lit(3).alias("volumes"), (k + 8).alias("depth"), F.lit(40).alias("height"), F.lit(50).alias("width"), F.lit(1).alias("channels"))
    at = n.select(k.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("level"))
    key, level = F.col("key"), F.col("level")
    sized = at.select("key", "level", F.when((key % 4 == 1) & (level == 0), 7).otherwise(key + 8).alias("depth"), F.lit(40).alias("height"), F.lit(50).alias("width"), F.lit(1).alias("channels"))
    cells = F.when(key % 7 == 4, F.array(F.lit(4), F.lit(4), F.lit(4))).when(key % 7 == 5, F.array(F.lit(1), F.lit(1), F.lit(1))).when(key % 7 == 6, F.lit(None)).otherwise(F.array(F.lit(2), F.lit(4), F.lit(4)))
    chunk = F.when(key % 7 == 5, F.array(F.lit(1), F.lit(1), F.lit(1))).otherwise(F.array(F.lit(2), F.lit(8), F.lit(16)))
    shape = F.array(F.lit(3), F.col("depth"), F.col("height"), F.when(key % 5 == 2, 49).otherwise(F.col("width")), F.col("channels"))
    factor = F.array(F.lit(1), F.lit(2), F.when((key % 6 == 3) & (level == 1), 0).otherwise(2))
    return validation.scale_descriptors(sized.select("*", shape.alias("shape"), factor.alias("factor"), chunk.alias("chunk"), cells.alias("subcells")), layers)


@query(
    "mask_violations",
    "SELECT 'mask-values' AS rule, n_nationkey::VARCHAR AS key FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'mask-last', n_nationkey::VARCHAR FROM nation WHERE n_nationkey % 5 = 1 UNION ALL SELECT 'mask-levels', n_nationkey || '/1' FROM nation WHERE n_nationkey % 6 = 2 AND n_nationkey % 5 <> 1",
)
def mask_violations(spark, d):
    k = F.col("n_nationkey").cast("int")
    n = table(spark, d, "nation")
    masks = n.select(k.alias("key"), F.when(k % 4 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.0))).alias("mask_values"))
    key, level = F.col("key"), F.col("level")
    rows = n.select(k.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("level")).where(~((key % 5 == 1) & (level == 2)))
    side = F.when(level == 0, 4).when(level == 1, F.when((key % 6 == 2) & (key % 5 != 1), 1).otherwise(2)).otherwise(1)
    return validation.mask_descriptors(masks, rows.select("key", "level", side.alias("gz"), side.alias("gy"), side.alias("gx")))


@query(
    "catalog_violations",
    """SELECT 'catalog-text' AS rule, 'e' || n_nationkey AS key FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'catalog-address', 'e' || n_nationkey FROM nation WHERE n_nationkey % 5 = 2 UNION ALL SELECT 'catalog-timepoints', 'e' || n_nationkey FROM nation WHERE n_nationkey % 6 = 0
    UNION ALL SELECT 'catalog-size', 'e' || n_nationkey FROM nation WHERE n_nationkey % 7 = 3 UNION ALL SELECT 'catalog-id', 'e7'""",
)
def catalog_violations(spark, d):
    k = F.col("n_nationkey")
    url = F.when(k % 5 == 2, "sets/one").otherwise(F.concat(F.lit("https://sets.example/"), k.cast("string"), F.lit("/")))
    rows = table(spark, d, "nation").select(
        F.concat(F.lit("e"), k.cast("string")).alias("id"), F.when(k % 4 == 1, " ").otherwise("label").alias("label"), F.lit("text").alias("description"), url.alias("base_url"), (k % 6).cast("long").alias("timepoints"), F.when(k % 7 == 3, F.lit(-1)).when(k % 7 == 4, F.lit(9)).cast("long").alias("size_bytes")
    )
    twice = spark.range(1).select(F.lit(" e7 ").alias("id"), F.lit("l").alias("label"), F.lit("d").alias("description"), F.lit("https://sets.example").alias("base_url"), F.lit(1).cast("long").alias("timepoints"), F.lit(None).cast("long").alias("size_bytes"))
    return validation.catalog(rows.unionByName(twice))
