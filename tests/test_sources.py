"""Files written by the tests themselves, and read back."""

import json
import shutil
import struct

import numpy as np
import pytest

from voxelflow.operators import tracks
from voxelflow.sources import layers, storage, tiff, tracks_csv
from voxelflow.streaming import statistics


def test_track_csv_with_a_break(spark, tmp_path):
    f = tmp_path / "tracks.csv"
    f.write_text("8, 2.0, 21.0, 4.25, 5.5, 6.75, 0, 3\n\n8, 2.0, , , , , 0, 3\n8, 2.0, 17.0, 1.5, 2.5, 3.5, -2, 3\n")
    rows = tracks_csv.read_tracks(spark, str(f))
    got = tracks.summary(tracks.segmented(rows)).orderBy("segment_index").collect()
    assert [(r.track_id, r.parent_id, r.time_start, r.amp_min) for r in got] == [("track-set-1:8", None, 21.0, 0.0), ("track-set-1:8-1", "track-set-1:8", 17.0, 0.0)]


def test_track_csv_with_a_header(spark, tmp_path):
    f = tmp_path / "tracks.csv"
    f.write_text("T,Start,Track_ID,X,Y,Z,A,extra\n3,10,7,1,2,3,4,0\n")
    r = tracks_csv.read_tracks(spark, str(f), one_based=True).first()
    assert (r.source_track_id, r.time, r.x, r.amplitude) == (7, 12.0, 1.0, 4.0)


@pytest.mark.parametrize(("line", "message"), [("1,0,NaN,NaN,NaN,NaN,0,0", "invalid t value"), ("1,2,3", "8 columns")])
def test_track_csv_errors(spark, tmp_path, line, message):
    f = tmp_path / "bad.csv"
    f.write_text(line + "\n")
    with pytest.raises(Exception, match=message):
        tracks_csv.read_tracks(spark, str(f)).collect()


def test_track_files_are_sets(spark, tmp_path):
    for k in (10, 9):
        (tmp_path / f"t{k}.csv").write_text(f"1,0,{k},1,1,1,0,0\n1,0,{k + 1},2,2,2,0,0\n")
    points = tracks.segmented(tracks_csv.read_tracks(spark, str(tmp_path)))
    got = tracks.summary(points).orderBy("track_id").collect()
    assert [(r.track_id, r.point_count, r.time_start, r.internal_id, r.point_offset) for r in got] == [("track-set-1:1", 2, 9.0, 1, 0), ("track-set-2:1", 2, 10.0, 1, 0)]
    assert tracks.ordered(points).count() == 4 and tracks.polyline(points).count() == 2
    c = tracks.centroids(points)
    assert sorted((r.track_set, r.group_time) for r in c.collect()) == [("track-set-1", 9.0), ("track-set-1", 10.0), ("track-set-2", 10.0), ("track-set-2", 11.0)]
    assert sorted((r.track_set, r.group_time) for r in tracks.as_of(c, 10.0).collect()) == [("track-set-1", 10.0), ("track-set-2", 10.0)]
    assert tracks.smoothed(points, 1.0).groupBy("track_set").count().count() == 2


def test_track_files_in_splits(spark, tmp_path):
    lines = [f"{k % 7},0,{k},{k},0,0,1,0" for k in range(3000)]
    (tmp_path / "a.csv").write_text("\ufefftrack_id,start,t,x,y,z,a,q\r\n" + "\r\n \r\n".join(lines) + "\r\n")
    (tmp_path / "b.csv").write_text("\n\n" + "\n".join(lines[:5]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = tracks_csv.read_lines(spark, str(tmp_path))
        rows = tracks_csv.parse(raw).orderBy("track_set", "row_idx").collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = [r for r in rows if r.track_set == "track-set-1"]
    assert [(r.row_idx, r.source_track_id, r.x) for r in first] == [(k + 1, k % 7, float(k)) for k in range(3000)]
    assert [(r.row_idx, r.x) for r in rows if r.track_set == "track-set-2"] == [(k, float(k)) for k in range(5)]


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "float32"])
def test_tiff_stacks(spark, tmp_path, kind):
    stack = (np.arange(3 * 4 * 5) * 3).reshape(3, 4, 5).astype(kind)
    (tmp_path / "t1.tif").write_bytes(tiff.encode(stack, "ImageJ=1\nimages=3\nslices=3\nhyperstack=true"))
    pages = tiff.read_pages(spark, str(tmp_path))
    got = pages.orderBy("page").collect()
    assert [r.data_type for r in got] == [kind] * 3
    assert np.array_equal(np.array([r.pixels for r in got]).reshape(stack.shape), stack)
    assert tuple(pages.select(tiff.hyperstack(pages["description"]).alias("h")).where("h is not null").first().h) == (1, 3, 1)
    v = tiff.voxels_of(pages).where("z = 2 and y = 1 and x = 3").first()
    assert (v.t, v.value) == (0, float(stack[2, 1, 3]))
    with pytest.raises(tiff.TiffError):
        list(tiff.pages(b"no tiff"))


def test_volumes_by_scale_and_time(spark, tmp_path):
    rows = [("a", s, t, 0, 0, x, x * 10 + s) for s in range(2) for t in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "layer_key string, scale int, t int, z int, y int, x int, code int")
    storage.write_volume(df, str(tmp_path / "v"))
    got = storage.read_volume(spark, str(tmp_path / "v"), "a", 1, 2)
    assert sorted(r.code for r in got.collect()) == [1, 11, 21, 31]
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().executedPlan().toString()


def test_regions_and_measurements(spark, tmp_path):
    rois = {"rois": [{"id": "r1", "shape": "ellipse", "mode": "3d", "start": {"x": 0, "y": 0, "z": 0}, "end": {"x": 1, "y": 1, "z": 1}}, {"id": "r1", "name": "again"}, {"id": "r2", "name": "two"}]}
    (tmp_path / "r.json").write_text(json.dumps(rois))
    got = storage.read_rois(spark, str(tmp_path / "r.json")).orderBy("roi_order").collect()
    assert [(r.id, r.name, r.shape, r.mode) for r in got] == [("r1", "r1", "ellipse", "3d"), ("r2", "two", "rectangle", "2d")]
    storage.write_measurements(spark.createDataFrame([('say "x"', 1.5)], "name string, mean double"), str(tmp_path / "m"))
    (part,) = (tmp_path / "m").glob("part-*.csv")
    body = part.read_text().splitlines()
    assert body == ['"name","mean"', '"say ""x""","1.5"']


def test_manifests(spark, tmp_path):
    layer = {"layer_key": "a", "channel_id": "c", "kind": "intensity", "volume_count": 3, "width": 4, "height": 5, "depth": 6, "data_type": "uint8", "stored_type": "uint8", "norm_min": 0.0, "norm_max": 255.0}
    (tmp_path / "m.json").write_text(json.dumps({"format": "f", "layers": [layer]}))
    m = storage.read_manifest(spark, str(tmp_path / "m.json"))
    assert m.first().width == 4
    changed = m.withColumn("width", m["width"] * 2)
    both = storage.upserted(m, changed)
    assert [r.width for r in both.collect()] == [8]
    storage.write_manifest(both.drop("format"), str(tmp_path / "out"))
    assert storage.read_manifest(spark, str(tmp_path / "out")).first().width == 8


@pytest.mark.parametrize(
    ("change", "path"),
    [
        ({"volume_count": -3}, r"layers\[1\].volume_count"),
        ({"channel_id": "other"}, r"layers\[1\].channel_id"),
        ({"layer_key": "a"}, r"layers\[0\].layer_key.*layers\[1\].layer_key"),
        ({"data_type": "complex"}, r"layers\[1\].data_type"),
        ({"norm_min": 4.0, "norm_max": 4.0, "width": 0}, r"layers\[1\].width.*layers\[1\].norm_max"),
    ],
)
def test_manifests_that_break_a_rule(spark, tmp_path, change, path):
    layer = {"layer_key": "a", "channel_id": "c", "kind": "intensity", "volume_count": 3, "width": 4, "height": 5, "depth": 6, "data_type": "uint8", "stored_type": "uint8", "norm_min": 0.0, "norm_max": 255.0}
    good = {"format": "f", "channels": [{"id": "c", "name": "C"}], "layers": [layer, layer | {"layer_key": "b"}]}
    (tmp_path / "m.json").write_text(json.dumps(good))
    assert storage.read_manifest(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "bad.json").write_text(json.dumps(good | {"layers": [layer, layer | {"layer_key": "b"} | change]}))
    with pytest.raises(Exception, match=path):
        storage.read_manifest(spark, str(tmp_path / "bad.json")).select("format").collect()


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ('{"rois": [{"id": "r1"', "Malformed|FAILFAST"),
        ('{"other": 1}', "rois: expected a list"),
        ('{"rois": [{"name": "x"}]}', r"rois\[0\].id"),
        ('{"rois": [{"id": "a", "start": {"x": 0, "y": 0, "z": 0}, "end": {"x": 9, "y": 1, "z": 1}}]}', r"rois\[0\].end.x: expected 0 to 7"),
    ],
)
def test_regions_that_break_a_rule(spark, tmp_path, text, message):
    (tmp_path / "r.json").write_text(text)
    with pytest.raises(Exception, match=message):
        storage.read_rois(spark, str(tmp_path / "r.json"), (8, 8, 8)).collect()


def test_regions_are_saved(spark, tmp_path):
    rows = [(k, f"r{k}", f"name {k}", "ellipse", "3d", "#0f0f0f", (0.0, 1.0, float(k)), (2.0, 3.0, 4.0)) for k in range(4)]
    rois = spark.createDataFrame(rows, "roi_order int, id string, name string, shape string, mode string, color string, start struct<x:double,y:double,z:double>, `end` struct<x:double,y:double,z:double>")
    storage.write_rois(rois.repartition(3), str(tmp_path / "rois"))
    assert sorted(map(tuple, storage.read_rois(spark, str(tmp_path / "rois")).collect())) == sorted(map(tuple, rois.collect()))


def test_tracks_masks_and_labels(spark, tmp_path):
    points = spark.createDataFrame([(1, 0, 0.5, 1.25, 2.0, 3.0, 4.0)], "source_track_id long, segment_index int, time double, x double, y double, z double, amplitude double")
    storage.write_tracks(points, str(tmp_path / "t"))
    assert storage.read_tracks(spark, str(tmp_path / "t")).collect() == points.collect()
    mask = spark.createDataFrame([("a", 0, 0, 0, x, x > 1) for x in range(4)], "layer_key string, scale int, z int, y int, x int, masked boolean")
    storage.write_mask(mask, str(tmp_path / "m"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [2, 3]
    labels = spark.createDataFrame([(0, 0, 0, x, x % 3) for x in range(9)], "t int, z int, y int, x int, label long")
    storage.write_labels(labels, str(tmp_path / "l"), (4, 4, 4))
    assert spark.read.parquet(str(tmp_path / "l" / "voxels")).count() == 6
    assert {(r.label, r.n_voxels) for r in spark.read.parquet(str(tmp_path / "l" / "labels")).collect()} == {(1, 3), (2, 3)}
    assert spark.read.parquet(str(tmp_path / "l" / "directory")).count() == 3


def test_tiff_channels_and_probe(spark, tmp_path):
    stack = np.arange(4 * 2 * 3).reshape(4, 2, 3).astype("uint8")
    (tmp_path / "c1.tif").write_bytes(tiff.encode(stack, "ImageJ=1\nimages=4\nchannels=2\nslices=2\nhyperstack=true"))
    got = {(r.z, r.y, r.x, r.channel): r.value for r in tiff.channel_voxels_of(tiff.read_pages(spark, str(tmp_path))).collect()}
    assert got == {(p // 2, y, x, p % 2): float(stack[p, y, x]) for p in range(4) for y in range(2) for x in range(3)}
    r = tiff.probe(spark, str(tmp_path)).first()
    assert (r.pages, r.width, r.height, r.data_type) == (4, 3, 2, "uint8")
    (tmp_path / "d1.tif").write_bytes(tiff.encode(stack[:1, :1]))
    with pytest.raises(Exception, match="another shape"):
        tiff.voxels_of(tiff.read_pages(spark, str(tmp_path)), "single-3d-volume").collect()


def test_tiff_colour_and_packed(spark, tmp_path):
    stack = (np.arange(2 * 3 * 4 * 3) * 5 % 251).reshape(2, 3, 4, 3).astype("uint8")
    (tmp_path / "c.tif").write_bytes(tiff.encode(stack, "colour", packed=True))
    read = tiff.read_pages(spark, str(tmp_path))
    got = {(r.z, r.y, r.x, r.channel): r.value for r in tiff.channel_voxels_of(read).collect()}
    assert got == {(z, y, x, c): float(stack[z, y, x, c]) for z in range(2) for y in range(3) for x in range(4) for c in range(3)}
    with pytest.raises(Exception, match="several samples"):
        tiff.voxels_of(read).agg({"value": "sum"}).collect()
    gray = (np.arange(60) * 7).reshape(3, 4, 5).astype("uint16")
    assert np.array_equal(np.stack([p for p, _ in tiff.pages(tiff.encode(gray, packed=True))]), gray)


def _tiled(page, order, packing, pack, predictor=1):
    """One page in tiles of 16 x 16, as other programs write it."""
    height, width = page.shape
    tiles = []
    for y in range(0, height, 16):
        for x in range(0, width, 16):
            tile = np.zeros((16, 16), page.dtype)
            part = page[y : y + 16, x : x + 16]
            tile[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                tile[:, 1:] -= tile[:, :-1].copy()
            tiles.append(pack(tile.astype(page.dtype.newbyteorder(order)).tobytes()))
    fields = [(256, width), (257, height), (258, page.dtype.itemsize * 8), (259, packing), (317, predictor), (322, 16), (323, 16)]
    n = len(fields) + 2
    lists = 8 + 2 + 12 * n + 4
    at = lists + 8 * len(tiles)
    starts = [at + sum(map(len, tiles[:k])) for k in range(len(tiles))]
    out = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIH", 42, 8, n)
    out += b"".join(struct.pack(order + "HHII", tag, 4, 1, v) for tag, v in fields)
    out += struct.pack(order + "HHII", 324, 4, len(tiles), lists) + struct.pack(order + "HHII", 325, 4, len(tiles), lists + 4 * len(tiles)) + struct.pack(order + "I", 0)
    return out + struct.pack(order + f"{len(tiles)}I", *starts) + struct.pack(order + f"{len(tiles)}I", *map(len, tiles)) + b"".join(tiles)


def _lzw(body):
    """A plain LZW writer, to read back."""
    known, width, codes, held = {bytes([k]): k for k in range(256)}, 9, [(256, 9)], b""
    size = 258
    for k in body:
        if held + bytes([k]) in known:
            held += bytes([k])
            continue
        codes.append((known[held], width))
        known[held + bytes([k])] = size
        size, held = size + 1, bytes([k])
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            codes.append((256, 12))
            known, width, size = {bytes([k]): k for k in range(256)}, 9, 258
    codes.append((known[held], width))
    size += 1
    codes.append((257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_tiff_tiles_and_packings():
    import zlib

    page = (np.arange(20 * 37) * 977 % 60_013).reshape(20, 37).astype("uint16")
    for order in "<>":
        for packing, pack in ((1, bytes), (8, zlib.compress), (5, _lzw)):
            for predictor in (1, 2):
                ((got, _),) = tiff.pages(_tiled(page, order, packing, pack, predictor))
                assert np.array_equal(got, page), (order, packing, predictor)
    assert tiff.unpack_bits(bytes([2, 7, 8, 9, 254, 5, 128, 0, 1])) == bytes([7, 8, 9, 5, 5, 5, 1])
    long = bytes(np.random.default_rng(5).integers(0, 256, 30_000, dtype=np.uint8))
    assert tiff.unpack_lzw(_lzw(long)) == long
    assert tiff.unpack_lzw(_lzw(b"a" * 9_000)) == b"a" * 9_000
    with pytest.raises(tiff.TiffError, match="short"):
        list(tiff.pages(_tiled(page, "<", 1, lambda b: b[:-1])))


def big_tiff(stack):
    """The same pages with 64-bit offsets, as other programs write large files."""
    out = bytearray(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16))
    for k, page in enumerate(stack):
        body = page.astype("<u2").tobytes()
        fields = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, 16), (259, 3, 1), (273, 16, 0), (277, 3, 1), (279, 16, len(body)), (339, 3, 1)]
        start = len(out) + 8 + 20 * len(fields) + 8
        out += struct.pack("<Q", len(fields)) + b"".join(struct.pack("<HHQQ", tag, kind, 1, start if tag == 273 else v) for tag, kind, v in fields)
        out += struct.pack("<Q", start + len(body) if k + 1 < len(stack) else 0) + body
    return bytes(out)


def test_tiff_pages_in_pieces(spark, tmp_path):
    stack = (np.arange(40 * 32 * 64) % 65_521).reshape(40, 32, 64).astype("uint16")
    (tmp_path / "a.tif").write_bytes(tiff.encode(stack, "forty"))
    (tmp_path / "b.tif").write_bytes(big_tiff(stack[:3]))
    read = tiff.read_pages(spark, str(tmp_path), piece_bytes=20_000)
    assert read.rdd.getNumPartitions() >= 11
    by = {(r.path[-5:], r.page): r.pixels for r in read.collect()}
    assert len(by) == 43
    for (name, k), v in by.items():
        assert np.array_equal(np.array(v).reshape(32, 64), stack[k]), (name, k)
    pushed = lambda: tiff.read_pages(spark, str(tmp_path), piece_bytes=20_000, one_scan=True)
    one = pushed().where("page = 7")
    assert [(r.path[-5:], r.page) for r in one.collect()] == [("a.tif", 7)] and one.rdd.getNumPartitions() == 2
    assert sorted((r.path[-5:], r.page) for r in pushed().where("page >= 1 and page < 3 and width = 64").select("path", "page").collect()) == [("a.tif", 1), ("a.tif", 2), ("b.tif", 1), ("b.tif", 2)]
    assert {(r.path[-5:], r.pages, r.width, r.height, r.data_type, r.description) for r in tiff.probe(spark, str(tmp_path)).collect()} == {("a.tif", 40, 64, 32, "uint16", "forty"), ("b.tif", 3, 64, 32, "uint16", "")}
    assert tiff.read_pages(spark, str(tmp_path / "b*.tif")).count() == 3
    some = tiff.read_pages(spark, str(tmp_path), 20_000, pages=[2, 39])
    assert sorted((r.path[-5:], r.page) for r in some.collect()) == [("a.tif", 2), ("a.tif", 39), ("b.tif", 2)] and some.rdd.getNumPartitions() <= 3
    assert read.where("page = 0").select("path").join(read, "path").count() == 43


def test_tiff_reads_only_what_is_asked(tmp_path):
    from pyspark.sql.datasource import EqualTo, StringContains

    stack = np.ones((40, 64, 64), "uint16")
    (tmp_path / "a.tif").write_bytes(tiff.encode(stack))
    page, directories = 64 * 64 * 2, 40 * 200 + 16

    def run(pixels, *filters):
        reader = tiff.TiffReader({"path": str(tmp_path), "pieceBytes": "30000", "pixels": pixels, "oneScan": "true"})
        left = list(reader.pushFilters(list(filters)))
        before = tiff.Ranges.total
        parts = reader.partitions()
        rows = sum(b.num_rows for p in parts for b in reader.read(p))
        return len(parts), rows, tiff.Ranges.total - before, left

    other = StringContains(("description",), "x")
    assert run("true", EqualTo(("page",), 7), other)[:2] == (1, 1) and run("true", other)[3] == [other]
    assert page <= run("true", EqualTo(("page",), 7))[2] <= page + directories
    parts, rows, read, _ = run("true")
    assert parts >= 13 and rows == 40 and 40 * page <= read <= 40 * page + 3 * directories
    assert run("false")[1] == 40 and run("false")[2] <= 3 * directories


def test_tiff_interpretations(spark, tmp_path):
    for k in (10, 9, 1):
        (tmp_path / f"p{k}.tif").write_bytes(tiff.encode(np.full((1, 2, 3), k, "uint8")))
    pages = tiff.read_pages(spark, str(tmp_path))
    as_z = tiff.voxels_of(pages, "single-3d-volume")
    assert sorted({(r.t, r.z, r.value) for r in as_z.collect()}) == [(0, 0, 1.0), (0, 1, 9.0), (0, 2, 10.0)]
    (tmp_path / "movie").mkdir()
    (tmp_path / "movie" / "m.tif").write_bytes(tiff.encode(np.arange(12).reshape(2, 2, 3).astype("uint8")))
    movie = tiff.voxels_of(tiff.read_pages(spark, str(tmp_path / "movie")), "2d-movie")
    assert sorted((r.t, r.z, r.y, r.x, r.value) for r in movie.collect()) == [(t, 0, y, x, float(t * 6 + y * 3 + x)) for t in range(2) for y in range(2) for x in range(3)]


def test_catalogues(spark, tmp_path):
    e = {"id": " a ", "label": "A", "description": "d", "baseUrl": "https://sets.example/a//", "timepoints": 3}
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"version": 1, "examples": [e, e | {"id": "b", "sizeBytes": 5}]}))
    got = storage.read_catalog(spark, str(f)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", "A", "d", "https://sets.example/a", 3, None), ("b", "A", "d", "https://sets.example/a", 3, 5)]
    for k, (bad, message) in enumerate([({"version": 2, "examples": []}, "version 2"), ({"version": 1, "examples": [e, e]}, "catalog-id"), ({"version": 1, "examples": [e | {"timepoints": 0}]}, "catalog-timepoints")]):
        g = tmp_path / f"bad{k}.json"
        g.write_text(json.dumps(bad))
        with pytest.raises(Exception, match=message):
            storage.read_catalog(spark, str(g)).collect()


def layer_rows(seed, dims=(64, 16, 16), holes=False):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 40, dims)
    v[5, 3, 4], v[40:44] = 250, rng.integers(200, 255, (4, *dims[1:]))
    rows = [(0, z, y, x, int(v[z, y, x])) for z in range(dims[0]) for y in range(dims[1]) for x in range(dims[2])]
    return [r for r in rows if r[1] % 3 or (r[2] + r[3]) % 5] if holes else rows


@pytest.mark.parametrize("holes", [False, True])
def test_layers_open_the_best_bricks_first(spark, tmp_path, holes):
    rows = layer_rows(3, holes=holes)
    if holes:
        rows = [r for r in rows if not (r[2:4] == (0, 0) and 32 <= r[1] < 48)]
    codes = spark.createDataFrame(rows, "t int, z int, y int, x int, code int")
    layer = layers.write_layer(codes, str(tmp_path / "a"), (4, 8, 8))
    want = {}
    for _, _, y, x, c in rows:
        want[y, x] = max(c, want.get((y, x), 0))
    assert {(r.y, r.x): r.code for r in layer.project_max().collect()} == want
    n_bricks = layer.table("bricks").count()
    assert n_bricks == 64 and sum(layer.opened) < n_bricks / 2
    assert layer.table("histogram").groupBy().sum("n").first()[0] == len(rows)
    assert sorted(map(tuple, layer.above(240).collect())) == sorted(r for r in rows if r[4] > 240)
    assert layer.table("hierarchy").where("level = 3").count() == 2


def test_layer_reads_only_the_folders_it_needs(spark, tmp_path):
    codes = spark.createDataFrame(layer_rows(4), "t int, z int, y int, x int, code int")
    layer = layers.write_layer(codes, str(tmp_path / "a"), (4, 8, 8))
    rows = layer.above(100)
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()
    some = layer.inside(layer.table("bricks").where("gz = 10"))
    for folder in (tmp_path / "a" / "voxels" / "t=0").glob("gz=*"):
        if folder.name != "gz=10":
            shutil.rmtree(folder)  # the files are listed already: to open one is an error
    assert sorted({r.z for r in some.collect()}) == [40, 41, 42, 43]


def test_an_empty_layer(spark, tmp_path):
    layer = layers.write_layer(spark.createDataFrame([(0, 0, 0, 0, 7)], "t int, z int, y int, x int, code int"), str(tmp_path / "a"), (4, 8, 8))
    assert [tuple(r) for r in layer.project_max().collect()] == [(0, 0, 0, 7)] and layer.opened == [1]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    kept = statistics.RunningStatistics(spark, str(tmp_path / "s"))
    assert kept.read() is None
    one = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "key string, value double")
    two = spark.createDataFrame([("a", -1.0), ("c", 2.0)], "key string, value double")
    want = [("a", 3, -1.0, 3.0, 3.0), ("b", 0, None, None, None), ("c", 1, 2.0, 2.0, 2.0)]
    got = lambda: sorted(tuple(r) for r in kept.read().collect())
    kept.add(one, 0)
    kept.add(two, 1)
    kept.add(two, 1)
    assert got() == want
    kept.compact()
    assert kept._parts() == ["base-1"] and got() == want
    kept.add(one, 0)
    assert got() == want
    kept.add(two, 2)
    assert [r[1] for r in got()] == [4, 0, 2]
