"""Channels exported as TIFF stacks."""

import numpy as np
import pytest

from voxelflow.sources import tiff, tiff_export


def volume(spark, rows):
    return spark.createDataFrame(rows, "t int, z int, y int, x int, value double")


@pytest.mark.parametrize(("kind", "big", "piece"), [("uint8", None, 1), ("uint16", True, 400), ("uint32", None, 1 << 20), ("float32", True, 700)])
def test_stacks_are_read_back(spark, tmp_path, kind, big, piece):
    rng = np.random.default_rng(2)
    want = rng.integers(0, 250, (3, 7, 5, 3)).astype(kind)
    want[1] = 0  # a timepoint without voxels
    want[0, 2:5] = 0
    want[2, 6] = 0
    if kind == "float32":
        want[0, 0, 0] = (-1.5, 0.25, 1e30)
    rows = [(*map(int, i), float(v)) for i, v in np.ndenumerate(want) if v]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    done = tiff_export.export_channel(volume(spark, rows), str(tmp_path), (7, 5, 3), 3, "a b", kind, piece_bytes=piece, big=big)
    assert [r.entry for r in done.orderBy("t").collect()] == ["a_b/001.tif", "a_b/002.tif", "a_b/003.tif"]
    for r in done.collect():
        data = (tmp_path / r.entry).read_bytes()
        assert (len(data), r.n_pages) == (r.n_bytes, 7) and data[2] == (43 if big else 42)
        stack = np.array([page for page, _ in tiff.pages(data)])
        assert stack.dtype == kind and np.array_equal(stack, want[r.t])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_entries", "a_b"] and len(list((tmp_path / "a_b").iterdir())) <= 6
    assert not [p for p in (tmp_path / "a_b").iterdir() if p.suffix not in (".tif", ".crc")]


def test_one_stack_and_odd_rows(spark, tmp_path):
    rows = [(0, 0, 0, 0, 3.0), (0, 0, 0, 0, 9.0), (0, 0, 0, 0, 4.0), (0, 0, 0, 1, None), (None, 0, 0, 0, 300.0)]
    for _ in range(2):  # an existing file is replaced
        done = tiff_export.export_channel(volume(spark, rows), str(tmp_path), (1, 1, 2), 1, "one.tif")
    assert [(r.t, r.entry) for r in done.collect()] == [(0, "one.tif")]
    assert np.array_equal([p for p, _ in tiff.pages((tmp_path / "one.tif").read_bytes())], [[[9, 0]]])
    assert tiff_export.export_channel(volume(spark, []), str(tmp_path), (2, 1, 1), 1).first().entry == "channel-export.tif"


@pytest.mark.parametrize(("row", "message"), [((0, 1, 0, 0, 1.0), "outside"), ((1, 0, 0, 0, 1.0), "outside"), ((0, 0, 0, 0, 256.0), "no uint8"), ((0, 0, 0, 0, 0.5), "no uint8"), ((0, 0, 0, 0, float("nan")), "no uint8")])
def test_what_a_file_cannot_hold(spark, tmp_path, row, message):
    with pytest.raises(Exception, match=message):
        tiff_export.export_channel(volume(spark, [row]), str(tmp_path), (1, 1, 1), 1, "bad")
    assert not [p for p in tmp_path.iterdir() if p.name != "_entries"]


def test_no_volumes(spark, tmp_path):
    with pytest.raises(ValueError, match="without volumes"):
        tiff_export.export_channel(volume(spark, []), str(tmp_path), (1, 1, 1), 0)


def test_a_large_stack_is_many_pieces(spark, tmp_path):
    rows = spark.range(64 * 32 * 32).selectExpr("0 as t", "cast(id div 1024 as int) as z", "cast(id div 32 % 32 as int) as y", "cast(id % 32 as int) as x", "double(id % 251) as value")
    stack = tiff_export.Stack(64, 32, 32, "uint8")
    per_piece = 8192 // stack.page
    tiff_export.export_channel(rows, str(tmp_path), (64, 32, 32), 1, "large", piece_bytes=8192)
    assert -(-64 // per_piece) == 10  # so many pieces, of which tasks take some each
    data = (tmp_path / "large.tif").read_bytes()
    assert np.array_equal(np.array([p for p, _ in tiff.pages(data)]).ravel(), np.arange(64 * 32 * 32) % 251)
