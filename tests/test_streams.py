"""Streams with state against their batch form."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelflow.operators import bricks
from voxelflow.sources import layers
from voxelflow.streaming import layer_sink, operators, pyramid


def volume(spark, dims):
    rng = random.Random(sum(dims))
    cells = [(t, z, y, x, rng.randrange(256)) for t in range(2) for z in range(dims[0]) for y in range(dims[1]) for x in range(dims[2])]
    return spark.createDataFrame(cells, "t int, z int, y int, x int, code int")


def arriving(spark, table, folder, files, **options):
    """The rows as a stream of files in a random order, each a batch."""
    table.repartition(files, F.rand(3)).write.parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("dims", [(7, 11, 9), (1, 3, 5), (8, 8, 8)])
def test_pyramid_of_a_stream(spark, tmp_path, dims):
    codes = volume(spark, dims)
    stream = arriving(spark, pyramid.tiles(codes, 4), str(tmp_path / "in"), 4)
    out = pyramid.pyramid(stream, 3, 4, dims[0]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    query = out.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal == 0
    got = pyramid.voxels(spark.read.parquet(str(tmp_path / "out")), 4)
    want = bricks.pyramid(codes, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def settled(query, count, wanted, seconds=60):
    end = time.time() + seconds
    while time.time() < end and count() < wanted:
        time.sleep(0.2)
    query.stop()


def test_tails_of_a_stack_of_unknown_depth(spark, tmp_path):
    codes = volume(spark, (5, 4, 4)).where("t = 0")
    stream = arriving(spark, pyramid.tiles(codes, 4), str(tmp_path / "in"), 3)
    query = pyramid.pyramid(stream, 3, 4, idle_ms=3000).writeStream.format("memory").queryName("tails").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    want = bricks.pyramid(codes, 3)
    settled(query, lambda: spark.table("tails").count(), 5 + 3 + 2)
    got = pyramid.voxels(spark.table("tails"), 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_a_slice_without_partner_is_handed_on(spark, tmp_path):
    rows = spark.createDataFrame([(z, z * 10) for z in range(5)], "z int, best int")
    query = operators.slice_pairs(arriving(spark, rows, str(tmp_path / "in"), 3), idle_ms=3000).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    settled(query, lambda: spark.table("pairs").count(), 3)
    assert sorted(map(tuple, spark.table("pairs").collect())) == [(0, 10), (1, 30), (2, 40)]


def test_tiles_that_do_not_halve(spark):
    with pytest.raises(ValueError, match="halved"):
        pyramid.pyramid(None, 4, 4)


def test_a_layer_from_a_stream(spark, tmp_path):
    kind = "t int, z int, y int, x int, code int"
    source, rows = tmp_path / "in", [(0, z, y, x, 10 * z + y + x) for z in range(4) for y in range(3) for x in range(3)]
    whole = layers.write_layer(spark.createDataFrame(rows, kind), str(tmp_path / "whole"), (2, 2, 2))
    sink = layer_sink.LayerSink(spark, str(tmp_path / "out"), (2, 2, 2))
    assert sink.layer().voxels().count() == 0
    spark.createDataFrame([r for r in rows if r[1] < 2], kind).write.parquet(str(source))
    spark.createDataFrame([(0, 3, 0, 0, 99), (0, None, 0, 0, 1)], kind).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(kind).parquet(str(source))
    first = sink.drain(stream, str(tmp_path / "state"))
    assert first.voxels().count() == 19 and {(r.z, r.n_voxels) for r in sink.slices().collect()} == {(0, 9), (1, 9), (3, 1)}
    late = spark.createDataFrame([r for r in rows if r[1] >= 2], kind)
    late.write.mode("append").parquet(str(source))  # slice 3 comes again, and is replaced whole
    done = sink.drain(stream, str(tmp_path / "state"))
    sink.add(late, 1)  # the batch runs again
    for layer in (done, sink.layer()):
        for name in ("bricks", "histogram", "columns", "hierarchy"):
            names = whole.table(name).columns
            assert sorted(map(str, layer.table(name).select(*names).collect())) == sorted(map(str, whole.table(name).collect()))
        assert sorted((r.z, r.y, r.x, r.code) for r in layer.voxels().collect()) == [r[1:] for r in rows]


@pytest.mark.parametrize("dims", [(7, 6, 9), (6, 9, 5), (3, 8, 8)])
def test_pyramid_of_slices_with_missing_voxels(spark, tmp_path, dims):
    """A last slice that ends early, a tile and a slice that are lost, gaps inside and a repeated voxel."""
    codes = volume(spark, dims).where(f"(z < {dims[0] - 1} or y < 3) and not (z = 1 and y >= 4) and (x * 7 + y * 5 + z) % 11 <> 0 and not (t = 1 and z = 0)")
    codes = codes.union(codes.where("x = 1 and y = 1").withColumn("code", F.lit(1)))
    stream = arriving(spark, pyramid.tiles(codes, 4, dims[0]), str(tmp_path / "in"), 3)
    out = pyramid.pyramid(stream, 3, 4, dims[0]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    query = out.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal == 0
    got = pyramid.voxels(spark.read.parquet(str(tmp_path / "out")), 4)
    want = bricks.pyramid(codes.groupBy("t", "z", "y", "x").agg(F.max("code").alias("code")), 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_slices_share_a_state_in_blocks(spark, tmp_path):
    """Pairs across batches, repeated slices and negative numbers; a state is a block of many pairs."""
    rows = [(z, z * 31 % 251) for z in range(-5, 20_000) if z % 1000 != 7] + [(4, 900), (5, 1), (9, -1)]
    stream = arriving(spark, spark.createDataFrame(rows, "z int, best int"), str(tmp_path / "in"), 3)
    out = operators.slice_pairs(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    query = out.trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress.stateOperators[0]
    assert last.numRowsTotal <= 20_005 // (2 * operators.PAIRS_IN_BLOCK) + 2
    largest = {}
    for z, best in rows:
        largest[z] = max(best, largest.get(z, best))
    got = {r.pair: r.best for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.pair not in (2, 4)}  # those that came again may be handed on before
    assert got == {z // 2: max(v, largest[z + 1]) for z, v in largest.items() if z % 2 == 0 and z + 1 in largest and z // 2 not in (2, 4)}


def test_joined_slices():
    z, best, since = np.array([5, 3, 2, 3, 9, 5, -1, -2]), np.array([1, 2, 9, 4, 6, 8, 0, 7]), np.array([70, 20, 30, 40, 50, 60, 1, 2])
    pair, most, waits = operators.join_slices(z, best, since)
    assert (pair.tolist(), most.tolist(), waits.tolist()) == ([-1, 1], [7, 9], [[5, 9], [8, 6], [60, 50]])
    assert [len(x) for x in operators.join_slices(*np.empty((3, 0), np.int64))] == [0, 0, 3]
