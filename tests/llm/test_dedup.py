import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from voxelflow.llm import simhash, similar_pairs, substring_dedup, suffix_dedup


def pieces(rows):
    """One text for each doc_id, as the operators see repeated rows."""
    return sorted({(-(1 << 63) if d is None else d, t or "") for d, t, *_ in rows})


def brute_words(rows, window):
    seen, out = set(), {}
    for d, t in pieces(rows):
        w = t.encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, length):
    count, out = Counter(), {}
    texts = [(d, t.encode()) for d, t in pieces(rows)]
    for _, b in texts:
        count.update(b[a : a + length] for a in range(len(b) - length + 1))
    for d, b in texts:
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if count[b[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def random_rows(seed, n=40):
    """Few words, so that windows repeat in every way: inside a text, overlapping, periodic, across many texts."""
    rng = random.Random(seed)
    passage = [" ".join(rng.choice("a b cc d".split()) for _ in range(rng.randint(25, 60))) for _ in range(4)]
    rows = []
    for d in range(n):
        parts = [rng.choice([*passage, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 40))), "ab " * rng.randint(5, 40)]) for _ in range(rng.randint(1, 4))]
        rows.append((d * 3, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_against_brute_force(spark, table, seed):
    rows = random_rows(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated_windows(table(rows)).collect()}
    assert got == brute_words(rows, 20)


@pytest.mark.parametrize("seed", [3, 4])
def test_strings_against_brute_force(spark, table, seed):
    rows = random_rows(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_strings(table(rows)).collect()}
    assert got == brute_bytes(rows, 200)


def test_windows_of_odd_rows(spark, table, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None or r[1].startswith("lonely")]
    out = substring_dedup.remove_repeated_windows(table(rows)).collect()
    assert len(out) == len(rows)
    want = brute_words(rows, 20)
    for r in out:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[-(1 << 63) if r.doc_id is None else r.doc_id], r.doc_id
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_strings_of_odd_rows(spark, table, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None or r[1].startswith("lonely")]
    out = suffix_dedup.repeated_strings(table(rows)).collect()
    assert len(out) == len(rows)
    want = brute_bytes(rows, 200)
    for r in out:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[-(1 << 63) if r.doc_id is None else r.doc_id], r.doc_id


def test_null_ids_are_one_document(spark, table, odd_rows):
    assert substring_dedup.remove_repeated_windows(table(odd_rows)).count() == len(odd_rows)
    assert suffix_dedup.repeated_strings(table(odd_rows)).count() == len(odd_rows)


def test_rows_without_id_are_cut_each_for_itself(spark, table):
    """Rows without id, and texts of one id, neither pass on their cuts nor count as one place."""
    rng = random.Random(8)
    prose = lambda: " ".join(f"p{rng.randint(0, 99999)}" for _ in range(90))
    copy, twice, clean, other, same = prose(), prose(), prose(), prose(), prose()
    rows = [(None, copy), (None, copy), (None, twice + " " + twice), (None, clean), (5, same), (5, other), (5, other), (6, same)]
    strings = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.repeated_strings(table(rows)).collect()), key=str)
    gone = lambda t: (len(t), len(t))
    want = [(None, *gone(copy)), (None, *gone(copy)), (None, 2 * len(twice) + 1), (None, len(clean), 0), (5, *gone(same)), (5, len(other), 0), (5, len(other), 0), (6, *gone(same))]
    want[2] = (None, 2 * len(twice) + 1, 2 * len(twice))
    assert strings == sorted(want, key=str)
    kept = sorted(r.text for r in suffix_dedup.drop_repeated(table(rows)).collect())
    assert kept == sorted(["", "", " ", clean, "", other, other, ""])
    words = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeated_windows(table(rows)).collect()), key=str)
    assert words == sorted([(None, 90, 0), (None, 90, 90), (None, 180, 90), (None, 90, 0), (5, 90, 0), (5, 90, 0), (5, 90, 0), (6, 90, 90)], key=str)


def test_cut_texts_keep_their_columns(spark, table, odd_rows):
    docs = table(odd_rows)
    out = suffix_dedup.drop_repeated(docs)
    assert out.schema == docs.schema or out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert [r.text for r in rows if r.doc_id == 7] == [""] or all("shared" not in (r.text or "") for r in rows)


def test_empty_tables(spark, table):
    none = table([])
    assert substring_dedup.remove_repeated_windows(none).collect() == []
    assert suffix_dedup.repeated_strings(none).collect() == []
    assert suffix_dedup.drop_repeated(none).collect() == []
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.drop_near_duplicates(none).collect() == []


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    fps = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    distinct = sorted({f for _, f in fps})
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    least = defaultdict(list)
    for d, f in fps:
        if d is not None:
            least[root(f)].append(d)
    return sorted(((d, f"{f:016x}", min(least[root(f)], default=None)) for d, f in fps), key=str)


def near_rows():
    """Long texts with one word changed, so that fingerprints differ by a few bits, in chains."""
    rng = random.Random(5)
    base = [rng.choice("red green blue white black grey pink".split()) + str(rng.randint(0, 99)) for _ in range(400)]
    rows = [(100, " ".join(base))]
    for k in range(60):
        base = list(base)
        base[rng.randrange(400)] = f"new{k}"
        rows.append((99 - k, " ".join(base)))
    return rows


def test_simhash_against_brute_force(spark, table, odd_rows):
    rows = odd_rows + near_rows()
    out = simhash.near_duplicates(table(rows))
    from pyspark.sql import functions as F

    got = out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    want = brute_components(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want}), "the fixture has links between different fingerprints"


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return bool(x) and len(x & y) >= 0.8 * len(x | y) - 1e-9


def edited_rows(groups=25, copies=5):
    """Groups of a text and copies with a few words changed, and texts that share only a passage."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows, doc_id, passage = [], 0, [word() for _ in range(80)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(60, 400))]
        for c in range(copies):
            text = list(base)
            for _ in range(c and rng.randint(1, max(1, len(base) // 60))):
                text[rng.randrange(len(text))] = word()
            rows.append((doc_id, " ".join(text)))
            doc_id += 1
        rows.append((doc_id, " ".join(passage + [word() for _ in range(60)])))
        doc_id += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [4096, 2])
def test_similar_texts_against_brute_force(spark, table, odd_rows, monkeypatch, tile):
    monkeypatch.setattr(similar_pairs, "TILE", tile)
    rows = edited_rows() + [(d if d is None else d + 1000, t) for d, t, *_ in odd_rows]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(rows), similar=True).where("doc_id is not null").collect()}
    texts = {d: t for d, t in rows if d is not None}
    up = {d: d for d in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    by_fp = brute_components(rows)
    for d, _, c in by_fp:
        if d is not None:
            up[root(d)] = root(c)
    links = 0
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if alike(texts[a], texts[b]):
                links += texts[a] != texts[b]
                up[root(a)] = root(b)
    least = {}
    for d in ids:
        least[root(d)] = min(least.get(root(d), d), d)
    assert links > 30
    assert got == {d: least[root(d)] for d in ids}


def test_texts_of_one_fingerprint_link_each_for_itself(spark, table):
    """The repeated start fixes the fingerprint of all but the last of each three; only the second is like the last."""
    rng = random.Random(2)
    tail = lambda: " ".join(f"t{rng.randint(0, 9999)}" for _ in range(300))
    a, b, c = tail(), tail(), tail()
    head = "x y z " * 1000
    rows = [(1, head + a), (2, head + b), (3, b), (None, head + c), (4, c)]
    assert len({brute_fingerprint(t) for _, t in rows}) == 3
    assert alike(rows[1][1], b) and not alike(rows[0][1], b)
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(table(rows), similar=True).collect())
    assert got == [("1", 1), ("2", 1), ("3", 1), ("4", 1), ("None", 1)]
    alone = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(table([(None, head + c), (8, c)]), similar=True).collect()}
    assert alone == {(None, 8), (8, 8)}


def templated_rows(seed, crowd=150, words=1500):
    """Many edits of one text at a similarity just under 0.8 to each other, and one more text that only number 75 is like."""
    rng = random.Random(seed)
    base = [f"b{rng.randint(0, 99999)}" for _ in range(words)]
    spots = lambda n: rng.sample(range(0, words, 6), n)
    edits = [{i: f"n{d}.{i}" for i in spots(21)} for d in range(crowd)]
    partner = dict(list(edits[75].items())[:6]) | {i: f"p{i}" for i in spots(18)}
    return [(d, " ".join(e.get(i, w) for i, w in enumerate(base))) for d, e in enumerate([*edits, partner])]


@pytest.mark.parametrize(("cell", "tile"), [(1 << 19, 4096), (20_000, 4096), (20_000, 16)])
def test_a_pair_in_a_crowd_below_the_threshold(spark, table, monkeypatch, cell, tile):
    monkeypatch.setattr(similar_pairs, "CELL", cell)
    monkeypatch.setattr(similar_pairs, "TILE", tile)
    rows = templated_rows(1)
    sets = [shingle_set(t) for _, t in rows]
    near = {(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near == {(75, 150)}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(rows), similar=True).collect()}
    want = {d: c for d, _, c in brute_components(rows)}
    pair = {want[75], want[150]}
    assert len(pair) == 2, "the radius does not join them"
    assert got == {d: min(pair) if c in pair else c for d, c in want.items()}


def test_nearest_links_hold_over_blocks(monkeypatch):
    import numpy as np

    monkeypatch.setattr(similar_pairs, "SIDE", 7)
    rng = np.random.default_rng(3)
    wide = rng.integers(0, 1 << 64, (2, 40), dtype=np.uint64)
    wide[:, 20:] = wide[:, :20] ^ np.uint64(5)
    got = set(map(tuple, similar_pairs.nearest(wide, 31).T.tolist()))
    d = np.bitwise_count(wide[:, :, None] ^ wide[:, None, :]).astype(int).sum(0)
    assert {(i, i + 20) for i in range(20)} <= got
    assert all(d[a, b] <= 31 for a, b in got)


def test_other_texts_of_a_repeated_id_stay(spark, table):
    text, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, text), (7, text + " more"), (7, other), (7, None), (9, other), (None, other)]
    kept = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(table(rows)).collect()), key=str)
    assert kept == sorted([(3, text), (7, other), (7, None), (None, other)], key=str)


def test_one_document_of_each_component_stays(spark, table):
    rows = edited_rows(6, 4) + [(907, "x"), (908, "x"), (None, "x"), (907, "x"), (909, None), (910, "")]
    kept = [r.doc_id for r in simhash.drop_near_duplicates(table(rows)).collect()]
    want = {r.component_id for r in simhash.near_duplicates(table(rows), similar=True).collect()}
    assert set(kept) == want | {None}
    assert kept.count(907) == 2 and 908 not in kept and 909 in kept and 910 not in kept


def test_radius_holds_over_random_fingerprints(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(300)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(3)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links_within(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    mask = (1 << 64) - 1
    assert all(((r.u ^ r.v) & mask).bit_count() <= 2 for r in links)
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for r in links:
        up[root(r.u & mask)] = root(r.v & mask)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                assert root(a) == root(b)
