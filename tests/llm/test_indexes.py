"""Incremental use of the two indexes of repeated text, their plans, and spans of long texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from voxelflow.llm import anchors, levels, substring_dedup, suffix_dedup

PLAIN = "doc_id long, text string"


def repeats(texts, window, split):
    """Of texts in order, the units of windows that start earlier too, and those that start anywhere else."""
    places = {}
    for i, t in enumerate(texts):
        u = split(t)
        for a in range(len(u) - window + 1):
            places.setdefault(tuple(u[a : a + window]), []).append((i, a))
    later, every = [set() for _ in texts], [set() for _ in texts]
    for found in places.values():
        for k, (i, a) in enumerate(found):
            if k:
                later[i].update(range(a, a + window))
            if len(found) > 1:
                every[i].update(range(a, a + window))
    return later, every


def batch_texts(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice("red green blue lime teal navy".split()) + str(rng.randint(0, 30)) for _ in range(n))
    passages = [prose(rng.randint(30, 70)) for _ in range(3)]
    return [[" ".join(rng.choice([*passages, prose(rng.randint(5, 60))]) for _ in range(rng.randint(1, 3))) for _ in range(8)] for _ in range(3)]


def units(row):
    return {i for s, n in (row.found or []) for i in range(s, s + n)}


@pytest.mark.parametrize("seed", [1])
def test_batches_with_the_same_ids(spark, seed):
    """Three batches use the same ids: each is held against all before it."""
    batches = batch_texts(seed)
    words, strings = substring_dedup.FingerprintRuns(spark), suffix_dedup.SuffixArrays(spark)
    marked = [set() for _ in range(24)]
    for k, texts in enumerate(batches):
        docs = spark.createDataFrame(list(enumerate(texts)), PLAIN)
        so_far = [t for b in batches[: k + 1] for t in b]
        later, _ = repeats(so_far, 20, str.split)
        _, every = repeats(so_far, 200, lambda t: t.encode())
        got = {r.doc_id: units(r) for r in words.add_batch(docs).collect()}
        assert got == dict(enumerate(later[k * 8 :])), k
        got = {r.doc_id: units(r) for r in strings.add_batch(docs).collect()}
        assert got == dict(enumerate(every[k * 8 :])), k
        for number, doc_id, found in ((r.batch, r.doc_id, units(r)) for r in strings.changes().collect()):
            marked[number * 8 + doc_id] |= found
        for i, t in enumerate(got.values()):
            marked[k * 8 + i] |= t
        assert marked == every + [set() for _ in range(24 - len(every))], k
        assert not words.changes().count()
    assert sorted(words.runs) == sorted(strings.runs) == [0, 1]
    arrays = strings.table(1).select("shard", "suffix").collect()
    numbers = strings.shards()
    by_range = sorted(arrays, key=lambda r: (list(numbers).index(r.shard), bytes(r.suffix)))
    order = [bytes(r.suffix) for r in by_range]
    assert order == sorted(order), "shards are ranges of text"


@pytest.mark.parametrize("make", [substring_dedup.FingerprintRuns, suffix_dedup.SuffixArrays])
def test_history_is_not_shuffled(spark, make):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = make(spark)
        for texts in batch_texts(3):
            index.add_batch(spark.createDataFrame(list(enumerate(texts)), PLAIN))
        docs = spark.createDataFrame([(0, 1, 0, "some text")], "born int, doc_id long, sub long, text string")
        with levels.as_bucketed(spark):
            plan = index.batch_plan(docs)._jdf.queryExecution().executedPlan().toString()
        assert sorted(index.runs) == [0, 1]
        assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1, plan
        assert plan.count("Sort [") == 1, "only the batch is sorted\n" + plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [40, 97, 500])
def test_spans_of_a_long_text(most):
    rng = random.Random(most)
    text = " ".join("w" * rng.randint(1, 9) + str(i) for i in range(300)) + " " + "x" * 700 + " end of it"
    column = pa.array([text])
    whole = next(substring_dedup.word_spans(column))[0]
    seen = {}
    for u, bounds, base, _ in substring_dedup.word_spans(column, 20, most):
        assert bounds.tolist() == [0, len(u)]
        for a in range(len(u) - 19):
            assert base + a not in seen
            seen[base + a] = u[a : a + 20].tolist()
    assert seen == {a: whole[a : a + 20].tolist() for a in range(len(whole) - 19)}
    seen = {}
    for u, _, base, raw in suffix_dedup.byte_spans(column, 50, most):
        assert (anchors.KEY.symbols[raw] == u).all()
        for a in range(len(u) - 49):
            assert base + a not in seen
            seen[base + a] = bytes(raw[a : a + 50])
    data = text.encode()
    assert seen == {a: data[a : a + 50] for a in range(len(data) - 49)}


def test_leads_sort_as_text():
    raw = np.frombuffer("zebra ünder Apfel \x00\x01 the quick".encode() + bytes(8), np.uint8)
    at = np.arange(len(raw) - 8)
    by_lead = np.argsort(suffix_dedup.leads(raw, at), kind="stable")
    assert by_lead.tolist() == sorted(at.tolist(), key=lambda a: raw[a : a + 8].tobytes())
    assert suffix_dedup.prefix_column(raw, at[:3], 4).to_pylist() == [raw[a : a + 4].tobytes() for a in range(3)]


def test_a_later_batch_marks_an_earlier_one(spark):
    passage = "".join(f"word{k} " for k in range(60))
    strings = suffix_dedup.SuffixArrays(spark)
    assert not strings.changes().count()
    strings.add_batch(spark.createDataFrame([(1, passage + "unique end"), (None, "short")], PLAIN)).count()
    assert not strings.changes().count()
    own = strings.add_batch(spark.createDataFrame([(2, passage)], PLAIN)).first()
    (r,) = strings.changes().collect()
    assert (r.batch, r.doc_id, r.text) == (0, 1, passage + "unique end") and units(r) == units(own) == set(range(len(passage)))
