import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from voxelflow.llm import decontamination, language_id, license_scan, quality
from voxelflow.llm.common import buffer_of, read_table


def shingles(text, k=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return set(), 0
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, n


def brute_contained(docs, items, t=0.8):
    out = []
    for d, text, *_ in docs:
        for i, item in items:
            s, n = shingles(item)
            if not s:
                continue
            w, _ = shingles(text, n) if n else (set(), 0)
            w = {x for x in w if len(x) == n}
            found = len(s & w)
            if found >= math.ceil(t * len(s) - 1e-9):
                out.append((d, i, len(s), found))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 60)))) for i in range(40)]
    return items + [(40, None), (41, ""), (42, "?!"), (None, items[5][1]), (43, items[5][1]), (44, "one two three"), (45, "w1 " * 30)]


def test_containment_against_brute_force(spark, table, odd_rows, benchmark_rows):
    rng = random.Random(4)
    docs = list(odd_rows)
    for k in range(60):
        _, item = rng.choice(benchmark_rows[:40])
        w = item.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        filler = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice([5, 200, 3000]))]
        at = rng.randrange(len(filler))
        docs.append((200 + k, " ".join([*filler[:at], *[x.upper() for x in w], *filler[at:]])))
    docs.append((300, "so one, TWO; three!"))
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    got = decontamination.contained_items(table(docs), items).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got), key=str) == brute_contained(docs, benchmark_rows)
    kept = decontamination.decontaminate(table(docs), items)
    hit = {r.doc_id for r in got}
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted((d or -1) for d, *_ in docs if d not in hit)


def test_only_the_row_that_is_hit_goes(spark, table):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(None, "so " + item), (None, "clean text without id"), (3, item), (3, "clean text of a shared id")]
    kept = decontamination.decontaminate(table(rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == ["clean text of a shared id", "clean text without id"]


def test_items_in_blocks(spark, table, benchmark_rows, monkeypatch):
    docs = [(i, t) for i, t in benchmark_rows if t]
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    whole = sorted(map(tuple, decontamination.contained_items(table(docs), items).collect()), key=str)
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 30)
    assert sorted(map(tuple, decontamination.contained_items(table(docs), items).collect()), key=str) == whole


def test_many_equal_items(spark, table, monkeypatch):
    """Equal items are one text in a block, and all reported."""
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    text = "six words that are the same"
    rows = [(i, text) for i in range(50)] + [(90 + i, f"{text} but {i} more " * 3) for i in range(9)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = [(1, "so " + text + " again"), (2, rows[-1][1]), (3, "clean")]
    got = decontamination.contained_items(table(docs), items).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got), key=str) == brute_contained(docs, rows)
    assert [r.doc_id for r in decontamination.decontaminate(table(docs), items).collect()] == [3]


def test_containment_of_empty_tables(spark, table, benchmark_rows):
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    assert decontamination.contained_items(table([]), items).collect() == []
    assert decontamination.contained_items(table([(1, "w1 w2")]), items.limit(0)).collect() == []


def licenses(spark, docs):
    got = license_scan.scan(docs)
    c = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()
    c.register("documents", frame)
    names = sorted(got.columns)
    want = [tuple(r) for r in c.sql(f"SELECT {', '.join(names)} FROM ({license_scan.oracle()})").fetchall()]
    return sorted(map(tuple, got.select(*names).collect()), key=str), sorted(want, key=str)


def test_licenses_against_sql(spark, table, odd_rows):
    seen, rows = set(), []
    for r in [*odd_rows, (70, "cc by cc-by CC, by\nGeneral Public\nLicense all rights Reserved"), (71, "Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (72, "this WORK is licensed under the GNU public license, version 3")]:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    got, want = licenses(spark, table(rows))
    assert got == want


def test_licenses_of_repeated_rows_and_null_ids(spark, table, odd_rows):
    assert license_scan.scan(table(odd_rows)).count() == len(odd_rows)
    assert license_scan.scan(table([])).collect() == []
    by = {r.doc_id: r for r in license_scan.scan(table(odd_rows)).collect()}
    assert by[61].labels.split(",") == ["mit", "reserved", "rights-reserved"] and by[61].score == 1.0
    assert (by[1].n_words, by[1].first_word, by[1].labels, by[1].score) == (0, None, "", 0.0)


def test_templates_are_found_over_line_ends(spark, table):
    """Each template, wrapped behind comment marks, in the middle of prose."""
    rows = []
    for k, text in enumerate(license_scan.TEMPLATES.values()):
        lines, line = [], "#"
        for w in ("so it was said " + text + " and the rest of the file follows").split():
            if len(line) + len(w) > 40:
                lines.append(line)
                line = "#"
            line += " " + w.capitalize()
        rows.append((k, "\n".join([*lines, line])))
    rows.append((100, "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License"))
    by = {r.doc_id: r.labels.split(",") for r in license_scan.scan(table(rows)).collect()}
    for k, label in enumerate(license_scan.TEMPLATES):
        assert label in by[k], label
    assert by[100] == ["gpl", "gpl-notice"]
    got, want = licenses(spark, table(rows))
    assert got == want


def test_other_versions_are_other_licenses(spark, table):
    texts = ["Licensed under the Apache License Version 1.0", "This source code form is subject to the terms of the Mozilla Public License version 1.1", "This work is licensed under the GNU General Public License version 2"]
    texts += ["Licensed under the Apache License Version 2.0", "work is licensed under the GNU general public license, version 3", "Licensed under the Apache License, Version 1.0 or 2.0"]
    rows = list(enumerate(texts))
    found = {r.doc_id: set(r.labels.split(",")) for r in license_scan.scan(table(rows)).collect()}
    versions = [found[k] & {"apache-2.0", "mpl-2.0", "gpl-3.0"} for k in range(6)]
    assert versions == [set(), set(), set(), {"apache-2.0"}, {"gpl-3.0"}, {"apache-2.0"}]
    got, want = licenses(spark, table(rows))
    assert got == want


def test_scattered_words_are_no_license(spark, table):
    rng = random.Random(6)
    spread = [w for t in license_scan.TEMPLATES.values() for w in t.split()]
    rng.shuffle(spread)
    filler = lambda: " ".join(f"f{rng.randint(0, 999)}" for _ in range(15))
    rows = [(1, "Released under the Apache License"), (2, "he sat under the tree and the driving license was later released by the office"), (3, " ".join(w + " " + filler() for w in spread))]
    assert [(r.labels, r.score) for r in license_scan.scan(table(rows)).collect()] == [("", 0.0)] * 3
    got, want = licenses(spark, table(rows))
    assert got == want


def test_license_query_is_native(spark, sf_dir):
    plan = license_scan.op2_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_languages_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in read_table(spark, d, "documents").select("doc_id", "lang").collect()}
    out = [r for r in language_id.op4_language_id(spark, d).collect() if r.held_out]
    assert len(out) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) >= 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_languages_of_odd_rows(spark, table, odd_rows):
    rows = [(d, t, "en" if (d or 0) % 2 else "de") for d, t in odd_rows] + [(90, "null language", None)]
    docs = table(rows)
    model = language_id.train(docs)
    out = language_id.identify(docs, model).collect()
    assert len(out) == len(rows)
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert {1, 2, 3, 4} <= und and 5 not in und and 60 not in und
    same = {(r.lang_pred, r.score) for r in out if r.doc_id in (6, 7, 13)}
    assert len(same) == 1
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in rows} - und


def test_kernel_against_sets(odd_rows):
    """The presence kernel is the number of common n-grams over the geometric mean of their own."""
    texts = [t for _, t in odd_rows if t and language_id.has_letter(t)][:12]
    vectors = [np.frombuffer(v, np.int32) for v in language_id.gram_sets(pa.array(texts))]
    model = language_id.fit(vectors, ["a", "b"] * 6, landmarks=6)

    def spectrum(text):
        symbols, out = [], set()
        for b in text.encode().lower():
            x = chr(b) if chr(b) in "abcdefghijklmnopqrstuvwxyz" else b if b > 127 else " "
            if x != " " or not symbols or symbols[-1] != " ":
                symbols.append(x)
        for n in (1, 2, 3):
            out |= {(n, *symbols[i : i + n]) for i in range(len(symbols) - n + 1)}
        return out

    sets = [spectrum(t) for t in texts]
    marks = [s for i, s in enumerate(sets) if i % 2 == 0][:3] + [s for i, s in enumerate(sets) if i % 2][:3]
    known = set().union(*marks)
    got = model.kernel(*buffer_of(pa.array(texts)))
    want = [[len(s & m) / math.sqrt(max(1, len(s & known)) * len(m)) for m in marks] for s in sets]
    assert np.allclose(got, want, atol=1e-5)


def test_votes_against_a_full_sort():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (60, 3)).astype(float)
    vectors[np.linalg.norm(vectors, axis=1) == 0] = 1
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)  # many ties
    model = quality.Model(np.ones(8), rng.standard_normal((8, 3)), vectors, rng.integers(0, 2, 60).astype(float), 0.5)
    counts = rng.random((20, 8)).astype(np.float32)
    near = model.latent(counts) @ vectors.T
    for row, score in zip(near, model.scores(counts, 7), strict=True):
        best = sorted(range(60), key=lambda j: (-row[j], j))[:7]
        w = [max(row[j], 0) ** 8 + 1e-9 for j in best]
        assert abs(score - sum(a * model.labels[j] for a, j in zip(w, best, strict=True)) / sum(w)) < 1e-9


def test_copies_of_an_id_do_not_crowd_the_sample(spark, table):
    rows = [(1, "copies of the one document", "en")] * 400 + [(d, f"text {d} of others", "en" if d % 2 else "de") for d in range(10, 310)]
    known = table(rows).select("doc_id", "text", "lang").where("doc_id is not null")
    got = language_id.training_rows(known, "lang", 80, language_id.gram_sets)
    assert len({r["doc_id"] for r in got}) == len(got)
    by = {x: sum(r["lang"] == x for r in got) for x in ("en", "de")}
    assert by == {"en": 40, "de": 40}


def test_more_labels_than_are_learned(spark, table, monkeypatch):
    monkeypatch.setattr(language_id, "LABELS", 5)
    docs = table([(d, f"some text {d}", f"l{d % 9}" if d > 40 else "often") for d in range(90)])
    model = language_id.train(docs)
    assert len(model.labels) == 5 and "often" in model.labels


def test_texts_like_no_language_go(spark, table):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(docs)
    junk = [(1, "xqzj9 kkvv qwrtp zzxq jjqk vbnmz qqq xkcd zxcvb " * 5), (2, "ѫѭѯѱ ѳѵѷѹ ѻѽѿ " * 4), (3, "0123 4567"), (4, "ok")]
    assert [r.doc_id for r in language_id.keep_identified(table(junk), model).collect()] == [4]
    assert language_id.keep_identified(docs, model, languages={"de"}).where("lang = 'en'").count() < docs.where("lang = 'en'").count() * 0.05


def test_languages_without_training_rows(spark, table):
    assert language_id.train(table([])) is None
    assert [r.lang_pred for r in language_id.identify(table([(1, "abc")]), None).collect()] == ["und"]


def test_documents_without_any_language_stay(spark, table):
    docs = table([(1, "abc", None), (2, "12 ?", None), (3, None, None), (4, "é", None)])
    assert sorted(r.doc_id for r in language_id.keep_identified(docs, language_id.train(docs)).collect()) == [1, 4]


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in read_table(spark, d, "labels").collect()}
    out = [r for r in quality.op9_quality_classifier(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) >= 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in out)


def test_quality_of_odd_rows(spark, table, odd_rows):
    docs = table(odd_rows)
    labels = spark.createDataFrame([(d, (d or 0) % 2, 0) for d, *_ in odd_rows] + [(6, 1, None), (20, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score_quality(docs, model).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (6, 7, 13)}) == 1
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5}
    assert quality.score_quality(table([]), model).collect() == []


def test_fits_read_whole_texts(spark, table):
    """What tells the labels apart lies after 25,000 characters."""
    head = "the same clean words " * 1200
    tail = ("zażółć gęślą jaźń ", "QX!! 77 ## ")
    docs = table([(d, head + tail[d % 2] * 4000, f"l{d % 2}") for d in range(24)])
    labels = spark.createDataFrame([(d, d % 2) for d in range(24)], "doc_id long, quality int")
    assert all(r.lang_pred == f"l{r.doc_id % 2}" for r in language_id.identify(docs, language_id.train(docs)).collect())
    assert all((r.score > 0.7) == (r.doc_id % 2 == 1) for r in quality.score_quality(docs, quality.train(docs, labels)).collect())


def test_numerals_are_no_letters():
    assert [language_id.has_letter(x) for x in ("", "12 ² ½ Ⅷ _", "² é", "ا", "語")] == [False, False, True, True, True]
