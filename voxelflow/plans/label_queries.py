"""Queries over the sparse label field and its edit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bricks, labels, sampling
from ..sources import tiff, tiff_export
from ..sources.adapters import LABEL_DIMS, label_voxels, table, with_tables
from ..sources.label_revisions import LabelRevisions
from ..streaming.run import shared_folder
from .registry import query, rounded

SIZE = (4, 16, 16)
LAB = with_tables("lab")


@query("canonical_labels", "SELECT event_id, CASE WHEN value - 5 <= 0 THEN 0 ELSE floor(value - 5 + 0.5) END::BIGINT AS lenient, floor(value)::BIGINT AS strict FROM events")
def canonical_labels(spark, d):
    return table(spark, d, "events").select("event_id", labels.lenient_label(F.col("value") - 5).alias("lenient"), labels.strict_label(F.floor("value").cast("double")).alias("strict"))


@query("foreground", f"{LAB} SELECT t, z, y, x, label FROM lab WHERE label <> 0")
def foreground(spark, d):
    return label_voxels(spark, d).where("label <> 0")


@query(
    "label_stats",
    f"""{LAB} SELECT label, count(*) AS n_voxels, min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x,
        round(sum(z) / count(*), 6) AS centroid_z, round(sum(y) / count(*), 6) AS centroid_y, round(sum(x) / count(*), 6) AS centroid_x, min(t) AS first_t, max(t) AS last_t FROM lab GROUP BY label""",
)
def label_stats(spark, d):
    return rounded(labels.label_stats(label_voxels(spark, d)), "centroid_z", "centroid_y", "centroid_x")


VOTES = f"""{LAB}, v AS (SELECT t, (z // 2)::INT AS z, (y // 2)::INT AS y, (x // 2)::INT AS x, label, count(*) AS n FROM lab GROUP BY ALL),
    b AS (SELECT *, sum(n) OVER (PARTITION BY t, z, y, x) AS filled, least(2, 7 - z * 2) * 4 AS valid, row_number() OVER (PARTITION BY t, z, y, x ORDER BY n DESC, label {{}}) AS k FROM v)
    SELECT t, z, y, x, label FROM b WHERE k = 1 AND n >= valid - filled"""


@query("downsample_sparse", VOTES.format("ASC"))
def downsample_sparse(spark, d):
    return labels.downsample_sparse(label_voxels(spark, d), LABEL_DIMS)


@query("downsample_dense", VOTES.format("DESC"))
def downsample_dense(spark, d):
    return labels.downsample_dense(label_voxels(spark, d), LABEL_DIMS)


DIRECTORY = f"""{LAB}, i AS (SELECT *, (z // 4)::INT AS gz, (y // 16)::INT AS gy, (x // 16)::INT AS gx, z % 4 AS lz, y % 16 AS ly, x % 16 AS lx FROM lab),
    r AS (SELECT *, coalesce(lag(lx) OVER w <> lx - 1 OR lag(label) OVER w <> label, true) AS start FROM i WINDOW w AS (PARTITION BY t, gz, gy, gx, lz, ly ORDER BY lx)),
    g AS (SELECT t, gz, gy, gx, count(*) AS n_voxels, count(*) FILTER (start) AS n_runs, min(label) AS label_min, max(label) AS label_max, min(lz)::INT AS min_z, max(lz)::INT AS max_z, min(ly)::INT AS min_y, max(ly)::INT AS max_y, min(lx)::INT AS min_x, max(lx)::INT AS max_x FROM r GROUP BY ALL),
    s AS (SELECT *, 16 + 6 * n_voxels AS c, 16 + 16 * n_runs AS u, 16 + 128 + 4 * n_voxels AS m, 16 + 4 * 1024 AS e FROM g),
    dir AS (SELECT * EXCLUDE (c, u, m, e), CASE least(c, u, m, e) WHEN c THEN 'coord-list' WHEN u THEN 'x-run' WHEN m THEN 'bitmask' ELSE 'dense' END AS codec, least(c, u, m, e)::BIGINT AS n_bytes FROM s)"""


@query("brick_directory", f"{DIRECTORY} SELECT * FROM dir")
def brick_directory(spark, d):
    return labels.brick_directory(label_voxels(spark, d), SIZE)


@query("bricks_on_slice", f"{DIRECTORY} SELECT t, gz, gy, gx, n_voxels FROM dir WHERE gy = 21 // 16 AND 21 - gy * 16 BETWEEN min_y AND max_y")
def bricks_on_slice(spark, d):
    return labels.bricks_on_slice(labels.brick_directory(label_voxels(spark, d), SIZE), "y", 21, SIZE).select("t", "gz", "gy", "gx", "n_voxels")


@query("x_runs", f"{LAB}, k AS (SELECT *, x - row_number() OVER (PARTITION BY t, z, y, label ORDER BY x) AS island FROM lab) SELECT t, z, y, label, min(x) AS x_start, count(*) AS length FROM k GROUP BY t, z, y, label, island")
def x_runs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("t", "z", "y", "label").orderBy("x")
    islands = label_voxels(spark, d).withColumn("island", F.col("x") - F.row_number().over(w))
    return islands.groupBy("t", "z", "y", "label", "island").agg(F.min("x").alias("x_start"), F.count("*").alias("length")).drop("island")


@query("occupancy_hierarchy", f"{LAB} SELECT DISTINCT k::INT AS level, t, ((z // 4) >> k)::INT AS gz, ((y // 16) >> k)::INT AS gy, ((x // 16) >> k)::INT AS gx FROM lab, (SELECT unnest(range(3))::INT AS k)")
def occupancy_hierarchy(spark, d):
    return labels.occupancy(label_voxels(spark, d), SIZE, 3)


@query(
    "label_lookup",
    f"{LAB}, p AS (SELECT event_id, (event_id % 7)::INT AS t, (event_id % 7)::INT AS z, (event_id % 67)::INT AS y, (event_id % 64)::INT AS x FROM events) SELECT event_id, t, z, y, x, coalesce(label, 0) AS label FROM p LEFT JOIN lab USING (t, z, y, x)",
)
def label_lookup(spark, d):
    e = F.col("event_id")
    p = table(spark, d, "events").select("event_id", *((e % m).cast("int").alias(c) for c, m in (("t", 7), ("z", 7), ("y", 67), ("x", 64))))
    return labels.label_at(label_voxels(spark, d), p).select("event_id", "t", "z", "y", "x", "label")


@query(
    "label_occupancy_samples",
    f"""{LAB}, p AS (SELECT event_id AS point_id, (event_id % 7)::INT AS t, (event_id % 13) / 2.0::DOUBLE AS pz, (event_id % 127) / 2.0::DOUBLE AS py, (event_id % 125) / 2.0::DOUBLE AS px FROM events),
    n AS (SELECT point_id, t, least(floor(pz) + k // 4, 6)::INT AS z, least(floor(py) + k // 2 % 2, 63)::INT AS y, least(floor(px) + k % 2, 63)::INT AS x,
        (CASE WHEN k // 4 = 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END) * (CASE WHEN k // 2 % 2 = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN k % 2 = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w
        FROM p, (SELECT unnest(range(8)) AS k))
    SELECT point_id, round(sum(CASE WHEN label IS NULL THEN 0 ELSE w END), 6) AS value FROM n LEFT JOIN lab USING (t, z, y, x) GROUP BY point_id""",
)
def label_occupancy_samples(spark, d):
    e = F.col("event_id")
    p = table(spark, d, "events").select(e.alias("point_id"), (e % 7).cast("int").alias("t"), *((e % m / 2.0).alias(c) for c, m in (("pz", 13), ("py", 127), ("px", 125))))
    return rounded(sampling.trilinear(label_voxels(spark, d).withColumn("value", F.lit(1.0)), p, LABEL_DIMS), "value")


COLOR = """h0 AS (SELECT DISTINCT label, (17 * 131 + (label & 255)) % 65521 AS h FROM sl), h1 AS (SELECT label, (h * 131 + ((label >> 8) & 255)) % 65521 AS h FROM h0), h2 AS (SELECT label, (h * 131 + ((label >> 16) & 255)) % 65521 AS h FROM h1),
    h3 AS (SELECT label, (h * 131 + ((label >> 24) & 255)) % 65521 AS h FROM h2), h4 AS (SELECT label, (h * 131 + 5) % 65521 AS h FROM h3), h5 AS (SELECT label, h * 131 % 65521 AS h FROM h4), h6 AS (SELECT label, h * 131 % 65521 AS h FROM h5),
    h7 AS (SELECT label, h * 131 % 65521 / 65521.0::DOUBLE * 6 AS s FROM h6), h8 AS (SELECT label, floor(s)::INT AS k, 0.78::DOUBLE * (1 - abs(s % 2 - 1)) AS m FROM h7),
    col AS (SELECT label, floor((CASE WHEN k IN (0, 5) THEN 0.78::DOUBLE WHEN k IN (1, 4) THEN m ELSE 0 END + 0.22::DOUBLE) * 255 + 0.5)::INT AS red, floor((CASE WHEN k IN (1, 2) THEN 0.78::DOUBLE WHEN k IN (0, 3) THEN m ELSE 0 END + 0.22::DOUBLE) * 255 + 0.5)::INT AS green,
        floor((CASE WHEN k IN (3, 4) THEN 0.78::DOUBLE WHEN k IN (2, 5) THEN m ELSE 0 END + 0.22::DOUBLE) * 255 + 0.5)::INT AS blue FROM h8)"""


@query("label_slice", f"{LAB}, sl AS (SELECT t, z AS v, x AS u, label FROM lab WHERE y = 9 AND label <> 0), {COLOR} SELECT t, v, u, label, red, green, blue FROM sl JOIN col USING (label)")
def label_slice(spark, d):
    return labels.slice_of(label_voxels(spark, d), "y", 9, 5)


@query("first_label", f"{LAB} SELECT t, y, x, min(z) AS z, arg_min(label, z) AS label FROM lab GROUP BY ALL")
def first_label(spark, d):
    return sampling.first_label(label_voxels(spark, d))


def edits(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(*((e * k % m).cast("int").alias(c) for c, k, m in (("t", 1, 7), ("z", 3, 7), ("y", 7, 64), ("x", 11, 64))), (e % 9).alias("label"), e.alias("seq"), F.floor(e / 500).alias("stroke"))


EDITS = "ed AS (SELECT (event_id % 7)::INT AS t, (event_id * 3 % 7)::INT AS z, (event_id * 7 % 64)::INT AS y, (event_id * 11 % 64)::INT AS x, event_id % 9 AS label, event_id AS seq, event_id // 500 AS stroke FROM events)"
LATEST = "SELECT t, z, y, x, coalesce(edit, label) AS label FROM lab FULL JOIN (SELECT t, z, y, x, arg_max(label, seq) AS edit FROM {} GROUP BY ALL) USING (t, z, y, x) WHERE coalesce(edit, label) <> 0"


@query("edited_labels", f"{LAB}, {EDITS} {LATEST.format('ed')}")
def edited_labels(spark, d):
    return labels.latest(label_voxels(spark, d), edits(spark, d))


@query("undone_labels", f"{LAB}, {EDITS}, un AS (SELECT * FROM ed WHERE stroke <= (SELECT max(stroke) FROM ed) - 3) {LATEST.format('un')}")
def undone_labels(spark, d):
    return labels.latest(label_voxels(spark, d), labels.undone(edits(spark, d), 3))


def _saved(spark, d):
    """Five revisions: the field, early edits, late edits (of which one stroke in three comes first), the whole compacted, and an older edit again."""
    store = LabelRevisions(spark, shared_folder(spark, "revisions"), SIZE, 3)
    e = edits(spark, d)
    store.save(label_voxels(spark, d))
    store.append(e.where("stroke % 3 = 0"))
    store.append(e.where("stroke % 3 <> 0"))
    store.compact()
    store.append(e.where("seq % 17 = 0"))
    return store


SAVED = f"""{LAB}, {EDITS}, sv AS (SELECT *, 2 AS save FROM ed WHERE stroke % 3 = 0 UNION ALL SELECT *, 3 FROM ed WHERE stroke % 3 <> 0 UNION ALL SELECT *, 5 FROM ed WHERE seq % 17 = 0),
    al AS (SELECT 1 + r AS revision, t, z, y, x, label, 1 AS save, 0::BIGINT AS seq FROM lab, range(5) AS n(r) UNION ALL SELECT 1 + r, t, z, y, x, label, save, seq FROM sv, range(5) AS n(r) WHERE save <= 1 + r),
    rv AS (SELECT revision::INT AS revision, t, z, y, x, arg_max(label, (save, seq)) AS label FROM al GROUP BY ALL)"""


@query("saved_revisions", f"{SAVED} SELECT * FROM rv WHERE label <> 0")
def saved_revisions(spark, d):
    """The field as of each of its revisions."""
    store = _saved(spark, d)
    found = [store.read(r).select(F.lit(r).alias("revision"), "*") for r in store.revisions()]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


@query("revision_changes", f"{SAVED} SELECT t, z, y, x, coalesce(a.label, 0) AS before, coalesce(b.label, 0) AS after FROM (SELECT * FROM rv WHERE revision = 1) a FULL JOIN (SELECT * FROM rv WHERE revision = 5) b USING (t, z, y, x) WHERE coalesce(a.label, 0) <> coalesce(b.label, 0)")
def revision_changes(spark, d):
    """Voxels that differ between the first revision and the last."""
    return _saved(spark, d).changes(1)


@query("revision_directory", f"{SAVED}, {DIRECTORY.removeprefix(LAB + ', ').replace('FROM lab', 'FROM rv WHERE revision = 3 AND label <> 0')} SELECT * FROM dir")
def revision_directory(spark, d):
    """The brick directory of a revision with edits."""
    return _saved(spark, d).table("directory", 3)


@query("exported_labels", f"{LAB} SELECT t - (SELECT min(t) FROM lab) AS t, z, y, x, label FROM lab WHERE label <> 0")
def exported_labels(spark, d):
    """Labels as stacks of 32-bit pages, a file for each year, read back."""
    folder = shared_folder(spark, "export")
    lab = label_voxels(spark, d)
    low, high = lab.agg(F.min("t"), F.max("t")).first()
    tiff_export.export_channel(lab.withColumn("t", F.col("t") - low), folder, LABEL_DIMS, high - low + 1, "labels", "uint32", "label")
    back = tiff.voxels_of(tiff.read_pages(spark, f"{folder}/labels"))
    return back.where("value <> 0").select("t", "z", "y", "x", F.col("value").cast("long").alias("label"))


LOG = """op AS (SELECT event_id % 9 AS layer, event_id AS seq, CASE WHEN event_id * 7919 % 11 < 6 THEN 'stroke' WHEN event_id * 7919 % 11 < 9 THEN 'undo' ELSE 'redo' END AS op, row_number() OVER (PARTITION BY event_id % 9 ORDER BY event_id) AS k FROM events),
    f AS (SELECT DISTINCT layer, 0::BIGINT AS k, []::BIGINT[] AS strokes, 0::BIGINT AS held FROM op
        UNION ALL SELECT layer, op.k, CASE WHEN op = 'stroke' THEN list_append(strokes[1:held], seq) ELSE strokes END,
            CASE op WHEN 'stroke' THEN held + 1 WHEN 'undo' THEN greatest(0, held - 1) ELSE least(len(strokes), held + 1) END FROM f JOIN op USING (layer) WHERE op.k = f.k + 1),
    held AS (SELECT layer, unnest(strokes[1:held]) AS stroke, unnest(range(1, held + 1)) AS depth FROM f WHERE (layer, k) IN (SELECT (layer, max(k)) FROM op GROUP BY layer))"""


def _log(spark, d):
    """Strokes, undos and redos of nine layers."""
    e, turn = F.col("event_id"), F.col("event_id") * 7919 % 11
    return table(spark, d, "events").select((e % 9).alias("layer"), e.alias("seq"), F.when(turn < 6, "stroke").when(turn < 9, "undo").otherwise("redo").alias("op"))


@query("applied_strokes", f"WITH RECURSIVE {LOG} SELECT layer, stroke, depth FROM held")
def applied_strokes(spark, d):
    return labels.applied(_log(spark, d), "layer")


@query("redone_labels", f"{LAB.replace('WITH', 'WITH RECURSIVE', 1)}, {EDITS}, {LOG}, un AS (SELECT * FROM ed WHERE seq IN (SELECT stroke FROM held)) {LATEST.format('un')}")
def redone_labels(spark, d):
    """The field with the edits that hold after all undos and redos."""
    held = labels.applied(_log(spark, d), "layer").select(F.col("stroke").alias("seq"))
    return labels.latest(label_voxels(spark, d), edits(spark, d).join(held, "seq", "left_semi"))


@query("deleted_label", f"{LAB} SELECT t, z, y, x, CASE WHEN label > 12 THEN label - 1 ELSE label END AS label FROM lab WHERE label <> 12")
def deleted_label(spark, d):
    return labels.without_label(label_voxels(spark, d), 12)


@query("largest_label", f"{LAB} SELECT t, max(label) AS largest, count(*) FILTER (label = 7) > 0 AS has_seven FROM lab GROUP BY t")
def largest_label(spark, d):
    return label_voxels(spark, d).groupBy("t").agg(F.max("label").alias("largest"), F.some(F.col("label") == 7).alias("has_seven"))


@query("label_page_slots", f"{LAB}, b AS (SELECT DISTINCT t, ((z // 4) * 4 + y // 16) * 4 + x // 16 AS brick FROM lab) SELECT t, brick, row_number() OVER (PARTITION BY t ORDER BY brick) - 1 AS slot FROM b")
def label_page_slots(spark, d):
    used = label_voxels(spark, d).groupBy("t", *bricks.brick_of(SIZE)).agg(F.count("*").alias("n_occupied"))
    return bricks.page_table(used, LABEL_DIMS, SIZE)


@query("has_label", f"{LAB} SELECT n_nationkey AS label, EXISTS (SELECT 1 FROM lab WHERE label = n_nationkey * 3) AS found FROM nation")
def has_label(spark, d):
    """Whether there is any voxel of a label, for a list of labels."""
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").alias("label"), (F.col("n_nationkey") * 3).cast("long").alias("key"))
    there = label_voxels(spark, d).select(F.col("label").alias("key")).distinct().withColumn("there", F.lit(True))
    return wanted.join(there, "key", "left").select("label", F.coalesce("there", F.lit(False)).alias("found"))


@query("strict_labels", "SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber)::BIGINT AS label FROM lineitem")
def strict_labels(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", labels.strict_label((F.col("l_orderkey") * 7 + F.col("l_linenumber")).cast("double")).alias("label"))
