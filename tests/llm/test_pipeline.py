"""The stages of the corpus pipeline, each on what the one before has kept."""

import random
import re
import zlib

import pytest

import corpus_pipeline
from voxelflow.llm.common import read_table, shared_folder, workspace


def plain(text):
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, table, odd_rows):
    """Odd rows, near copies, a passage of many documents, and benchmark items in some, beside clean prose."""
    rng = random.Random(12)
    word = lambda: rng.choice("stone river lamp green quiet window market yellow paper morning house garden".split()) + rng.choice("abcdefghij")
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(25)) for k in range(4)]
    passage = prose(60)
    rows = [*odd_rows]
    rows += [(100 + k, prose(120)) for k in range(10)]
    base = prose(300)
    rows += [(200 + k, base.replace(" ", f" x{k} ", 1)) for k in range(4)]
    rows += [(300 + k, prose(80) + " " + passage + " " + prose(70)) for k in range(3)]
    rows += [(400 + k, prose(50) + " " + items[k][1] + " " + prose(40)) for k in range(4)]
    rows += [(500, "0123 --- 456"), (501, None), (None, prose(90)), (None, prose(95))]
    path = tmp_path_factory.mktemp("corpus")
    table(rows).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items, passage


def stages(spark, path, docs):
    """What each stage keeps."""
    ws, kept = workspace(spark, "test"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = ws.write(stage(spark, docs, path), f"s{k}")
        kept.append(docs)
    return kept


@pytest.fixture(scope="module")
def kept_by_stage(spark, folder):
    return stages(spark, folder[0], read_table(spark, folder[0], "documents"))


def test_stages(spark, folder, kept_by_stage):
    path, rows, items, passage = folder
    docs = read_table(spark, path, "documents")
    language, near, strings, leaks, packed = kept_by_stage
    assert language.columns == near.columns == strings.columns == leaks.columns == docs.columns
    lettered = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    kept = [(r.doc_id, r.text) for r in language.collect()]
    assert sorted(kept, key=str) == sorted((x for x in lettered if x in set(kept)), key=str)
    clean = set(range(100, 110)) | {200, 201, 202, 203} | set(range(300, 303)) | set(range(400, 404))
    assert clean <= {d for d, _ in kept}
    by = {r.doc_id for r in near.collect()}
    assert {200} == by & {200, 201, 202, 203} and set(range(100, 110)) <= by
    assert sum(r.doc_id is None for r in near.collect()) == sum(d is None for d, _ in kept)
    texts = {r.doc_id: r.text for r in strings.collect()}
    assert set(texts) == by
    assert all(passage not in texts[300 + k] for k in range(3))
    assert all(texts[100 + k] == dict(lettered)[100 + k] for k in range(10))
    left = {r.doc_id for r in leaks.collect()}
    hit = {d for d, t in texts.items() if any(plain(i) in plain(t) for _, i in items)}
    assert {400, 401, 402, 403} <= hit and left == set(texts) - hit
    pieces = packed.groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == left


def test_run_is_the_stages(spark, folder, kept_by_stage):
    path, *_ = folder
    got = corpus_pipeline.run(spark, path)
    want = kept_by_stage[-1]
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)
    assert all(0 <= r.ids_crc32 < 1 << 32 for r in got.collect()) and zlib.crc32(b"") == 0


def test_run_of_unlabelled_and_empty_tables(spark, folder, table, tmp_path):
    path, *_ = folder
    items = read_table(spark, path, "benchmark")
    for name, rows in (("none", []), ("unlabelled", [(1, "abc def ghi", None), (2, "12 ?", None), (None, "xyz words", None), (3, None, None)])):
        table(rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()}
        assert got == ({1, None} if rows else set()), name


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
