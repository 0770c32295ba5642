"""Revisions of saved label layers."""

import numpy as np
import pytest

from voxelflow.operators import labels as ops
from voxelflow.sources import storage
from voxelflow.sources.label_revisions import LabelRevisions, StaleRevision

SIZE = (2, 4, 4)


def field(spark, rows):
    return spark.createDataFrame(rows, "t int, z int, y int, x int, label long")


def edit(spark, rows):
    return spark.createDataFrame(rows, "t int, z int, y int, x int, label long, seq long")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("t", "z", "y", "x", "label").collect())


@pytest.fixture
def store(spark, tmp_path):
    s = LabelRevisions(spark, str(tmp_path / "layer"), SIZE, 2)
    s.save(field(spark, [(0, 0, 0, x, 1 + x % 2) for x in range(6)] + [(1, 0, 0, 0, 9)]), "first")
    return s


def test_later_saves_hold(spark, store):
    assert store.append(edit(spark, [(0, 0, 0, 0, 7, 50), (0, 0, 0, 0, 8, 60), (0, 0, 0, 1, 0, 1)])) == 2
    assert store.append(edit(spark, [(0, 0, 0, 0, 5, 2), (0, 3, 3, 3, 4, 1), (None, 0, 0, 0, 3, 9), (0, 0, 0, 2, None, 9)])) == 3
    assert rows_of(store.read())[:2] == [(0, 0, 0, 0, 5), (0, 0, 0, 2, 1)]  # the later save, though its seq is smaller
    assert (0, 0, 0, 0, 8) in rows_of(store.read(2)) and (0, 0, 0, 1, 2) not in rows_of(store.read(2))
    assert rows_of(store.read(1)) == [(0, 0, 0, x, 1 + x % 2) for x in range(6)] + [(1, 0, 0, 0, 9)]
    assert sorted(tuple(r) for r in store.changes(2).collect()) == [(0, 0, 0, 0, 8, 5), (0, 3, 3, 3, 0, 4)]


def test_edits_against_a_dictionary(spark, store):
    rng = np.random.default_rng(5)
    want = {r[:4]: r[4] for r in rows_of(store.read())}
    for save in range(3):
        batch = [(int(a), int(b), int(c), int(e), int(f), k) for k, (a, b, c, e, f) in enumerate(zip(*(rng.integers(0, n, 60) for n in (2, 3, 5, 5, 4)), strict=True))]
        for r in batch:
            want[r[:4]] = r[4]
        store.append(edit(spark, batch[::-1]))
        if save == 1:
            store.compact()
    kept = sorted((*k, v) for k, v in want.items() if v)
    assert rows_of(store.read()) == kept
    for name, rows in storage.label_tables(field(spark, kept), SIZE, 2).items():
        assert sorted(map(str, store.table(name).select(*rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_readers_of_an_older_revision_are_undisturbed(spark, store):
    old = store.read(1)
    before = rows_of(old)
    store.append(edit(spark, [(0, 0, 0, 0, 0, 1)]))
    store.compact()
    store.save(field(spark, [(0, 0, 0, 0, 3)]))
    assert rows_of(old) == before and store.revisions() == [1, 2, 3, 4]
    assert rows_of(store.read()) == [(0, 0, 0, 0, 3)]


def test_a_save_that_stops_half_way_is_not_seen(spark, store, monkeypatch):
    before = rows_of(store.read())
    broken = field(spark, [(0, 0, 0, 0, 1)]).selectExpr("t", "z", "y", "x", "cast(raise_error('lost') as long) as label")
    with pytest.raises(Exception, match="lost"):
        store.save(broken)

    def fails(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(ops, "label_stats", fails)
    with pytest.raises(RuntimeError, match="stopped"):
        store.save(field(spark, [(0, 0, 0, 0, 1)]))
    assert store.revisions() == [1] and rows_of(store.read()) == before
    assert len(store.vacuum(older_than=0)) == 2
    assert rows_of(store.read()) == before


def test_the_second_of_two_savers_is_refused(spark, store):
    other = LabelRevisions(spark, store.path, SIZE)
    seen = store.manifest()["revision"]
    other.append(edit(spark, [(0, 0, 0, 0, 2, 1)]), parent=seen)
    with pytest.raises(StaleRevision):
        store.append(edit(spark, [(0, 0, 0, 0, 3, 1)]), parent=seen)
    with pytest.raises(StaleRevision):  # both looked before either committed
        store._commit(seen, "base-x", [], "")
    assert store.revisions() == [1, 2] and (0, 0, 0, 0, 2) in rows_of(store.read())


def test_vacuum_keeps_what_is_named(spark, store):
    store.append(edit(spark, [(0, 0, 0, 0, 2, 1)]))
    want = rows_of(store.read())
    assert store.vacuum(older_than=0) == ["revisions/1.json"]  # its base is that of revision 2
    store.compact()
    assert store.vacuum() == ["revisions/2.json"]  # young folders stay
    assert len(store.vacuum(older_than=0)) == 2
    assert rows_of(store.read()) == want and store.revisions() == [3]
    with pytest.raises(ValueError, match="no revision 1"):
        store.read(1)


def test_a_timepoint_opens_its_own_folders(spark, store):
    store.append(edit(spark, [(0, 0, 0, 0, 2, 1), (1, 1, 1, 1, 6, 1)]))
    one = store.read().where("t = 1")
    assert rows_of(one) == [(1, 0, 0, 0, 9), (1, 1, 1, 1, 6)]
    assert len(one.inputFiles()) >= 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(t") == 2


def test_an_empty_layer(spark, tmp_path):
    store = LabelRevisions(spark, str(tmp_path / "none"), SIZE)
    with pytest.raises(ValueError, match="no revision"):
        store.read()
    with pytest.raises(ValueError, match="before its edits"):
        store.append(edit(spark, []))
    store.save(field(spark, []))
    assert rows_of(store.read()) == [] and store.table("occupancy").count() == 0
    store.append(edit(spark, []))
    assert rows_of(store.read()) == []
    store.append(edit(spark, [(4, 0, 0, 0, 1, 1)]))
    assert rows_of(store.read()) == [(4, 0, 0, 0, 1)]
