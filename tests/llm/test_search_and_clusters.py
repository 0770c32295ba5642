"""Centroid clustering, ranked search and the n-gram join, against brute force and DuckDB."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from voxelflow.llm import centroids, lexical_search, ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same_as_sql(spark, sf_dir, query, sql):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    want = c.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    rows = [tuple(r) for r in got.select(*names).collect()]
    assert rows and sorted(rows) == sorted(want)


# Centroid clustering


def brute_clusters(rows, k=centroids.K, rounds=centroids.ROUNDS):
    ok = lambda v: v is not None and len(v) == 64 and all(x is not None and abs(x) <= centroids.FLOAT_MAX for x in v)
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if ok(v)]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    c = [v for _, v in sorted(((digest(f"1:{i}"), v) for i, v in kept if i is not None))][:k]
    near = lambda v: min((sum((p - q) ** 2 for p, q in zip(v, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else y for j, y in enumerate(c)]
    found = [(i, *near(v)) for i, v in kept]
    most = (1 << 63) - 1
    sums = Counter()
    for _, d, j in found:
        sums[j] += d
    long = lambda x, parts: x if x <= most and max(parts) <= most else None
    out = []
    for i, d, j in found:
        out.append((i, j, long(d, [d]), long(sums[j], [x for _, x, y in found if y == j]), long(sum(sums.values()), [x for _, x, _ in found]), digest(",".join(map(str, c[j])))))
    return out


VECTORS = "vec_id long, embedding array<double>, v string, short long, cluster string, n int, hash string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None, None, None) for r in rows], VECTORS).repartition(3)


def clustered(spark, rows):
    return [tuple(r) for r in centroids.cluster(vectors(spark, rows)).collect()]


def vector_rows(seed, n=150):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middle)]) for i in range(n)]


def order(rows):
    return sorted(rows, key=str)


def test_clusters_against_brute_force(spark):
    rows = vector_rows(3)
    rows += [rows[4], (None, rows[5][1]), (1000, [0.0] * 64), (1001, [0.0] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [math.inf] * 64), (907, [1e300] * 64)]
    assert order(clustered(spark, rows)) == order(brute_clusters(rows))


def test_clusters_of_wide_components(spark):
    rows = [*vector_rows(4, 40), (500, [1e7] * 64), (501, [-3e30, *[0.5] * 63]), (502, [3.4e38] * 64)]
    got = clustered(spark, rows)
    assert order(got) == order(brute_clusters(rows))


def test_few_and_no_vectors(spark):
    rows = [(7, [0.1] * 64), (8, [0.2] * 64)]
    assert order(clustered(spark, rows)) == order(brute_clusters(rows))
    assert clustered(spark, [(1, None)]) == []


def test_bounds_never_exceed_distances_and_prune():
    rng = np.random.default_rng(5)
    middle = rng.integers(-200, 200, (16, 64))
    v = middle[rng.integers(0, 16, 3000)] + rng.integers(-30, 30, (3000, 64))
    exact = np.square(v[:, None] - middle[None]).sum(2)
    assert (centroids.lower_bounds(centroids.compressed(v), centroids.compressed(middle)) <= exact).all()
    nearest = centroids.Assigner(middle.tolist())
    number, distance = nearest(v.astype(np.float64), centroids.compressed(v))
    assert (number == exact.argmin(1)).all() and distance == exact.min(1).tolist()
    assert nearest.measured < exact.size / 4


def test_limbs():
    for x in (0, 1, -1, 5 << 33, -(7 << 90) - 3, (1 << 140) + 9):
        assert sum(p << 32 * j for j, p in enumerate(centroids.limbs(x))) == x


def test_clusters_against_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, centroids.op11_centroid_clustering, centroids.oracle())


# Ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, top=lexical_search.TOP):
    held = [(d, Counter(terms(t))) for d, t, *_ in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, words in asked.items():
        found = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:top])]
    return out


def test_search_against_brute_force(spark, table, odd_rows):
    items = [(1, "alpha straße Licensed"), (2, "the The THE of"), (3, None), (4, "..."), (5, "nowhere"), (6, odd_rows[5][1]), (6, "12 gamma"), (7, "Ünïcödé 😀"), (None, "beta word")]
    asked = spark.createDataFrame([(*x, "x", 1) for x in items], "item_id long, text string, score string, doc_id int")
    for parts in (1, 5):
        got = lexical_search.search(table(odd_rows, parts), asked).collect()
        assert order(map(tuple, got)) == order(brute_search(odd_rows, items))


def test_search_of_nothing(spark, table):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical_search.search(table([(1, None), (2, "  ")]), items).collect() == []
    assert lexical_search.search(table([(1, "alpha")]), items.limit(0)).collect() == []


def test_variable_length_numbers():
    rng = np.random.default_rng(2)
    x = np.r_[0, 127, 128, 16383, 16384, (1 << 62) + 5, rng.integers(0, 1 << 40, 500)]
    raw, ends = lexical_search.encoded(x)
    assert (lexical_search.decoded(raw) == x).all() and ends[-1] == len(raw)
    assert not len(lexical_search.encoded(np.zeros(0, np.int64))[0])


@pytest.mark.parametrize("window", [1, 7, 4096])
def test_windows_of_the_merge(window):
    rng = np.random.default_rng(window)
    lists = [(np.sort(rng.choice(900, n, replace=False)), rng.integers(1, 50, n)) for n in (1, 30, 400)]
    want = np.zeros(900, np.int64)
    for docs, points in lists:
        want[docs] += points
    seen = [(int(d), int(x)) for docs, points in lexical_search.by_window(lists, window) for d, x in zip(docs, points, strict=True)]
    assert seen == [(d, x) for d, x in enumerate(want.tolist()) if x]


def test_bounded_heap():
    rng = np.random.default_rng(8)
    best, every = lexical_search.Best(10), []
    for _ in range(20):
        ids, points = rng.permutation(5000)[:100], rng.integers(1, 30, 100)
        best.add(ids, points)
        every += zip((-points).tolist(), ids.tolist(), strict=True)
    assert sorted((-x, -i) for x, i in best.heap) == sorted(every)[:10]


def test_search_against_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, lexical_search.op12_ranked_search, lexical_search.oracle())


# N-gram join


def brute_join(rows):
    held = []
    for d, t, *_ in rows:
        w = (t or "").translate(LOWER).encode().split()
        held.append((d, frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()))
    classes = sorted({s for _, s in held if s}, key=len)
    up = {s: s for s in classes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(classes):
        for b in classes[:i]:
            both = len(a & b)
            if 100 * both >= 85 * (len(a) + len(b) - both):
                up[root(a)] = root(b)
    least = {}
    for d, s in held:
        if s and d is not None:
            least[root(s)] = min(d, least.get(root(s), d))
    return [(d, len(s), least.get(root(s)) if s else d) for d, s in held]


def joined(docs):
    return [tuple(r) for r in ngram_join.jaccard_components(docs).collect()]


def edited(seed, groups=12, copies=9):
    """Groups of near copies around the threshold, of every length, and chains of them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        text = [rng.choice(words) for _ in range(rng.choice([4, 8, 9, 10, 12, 15, 20, 30, 60, 120, 300, 900]))]
        for _ in range(copies):
            now = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, len(now) // 30])):
                p = rng.randrange(len(now))
                now[p : p + 1] = rng.choice([[], [rng.choice(words)], [now[p], "extra"]])
            rows.append((len(rows), " ".join(now)))
            if rng.random() < 0.3:
                text = now
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_brute_force(spark, table, seed):
    rows = edited(seed)
    want = brute_join(rows)
    assert 20 < len({c for *_, c in want}) < len(rows) - 20
    assert sorted(joined(table(rows))) == sorted(want)


def test_join_of_odd_rows(spark, table, odd_rows):
    assert order(joined(table(odd_rows))) == order(brute_join(odd_rows))


def test_join_of_nothing(spark, table):
    assert joined(table([(1, "x")]).limit(0)) == []
    assert sorted(joined(table([(1, None), (2, " ")]))) == [(1, 0, 1), (2, 0, 2)]


def test_a_large_group_of_near_copies(spark, table):
    """All linked to one text, few to one another."""
    rng = random.Random(9)
    text = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for d in range(300):
        now = list(text)
        for _ in range(2):
            now[rng.randrange(len(now))] = f"x{d}"
        rows.append((d, " ".join(now)))
    assert sorted(joined(table(rows))) == sorted(brute_join(rows))


def test_every_pair_of_linked_sets_shares_a_key():
    rng = np.random.default_rng(11)
    for _ in range(400):
        n = int(rng.integers(6, 400))
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        drop = int(rng.integers(0, n // 6 + 1))
        b = np.r_[a[drop:], rng.integers(0, 1 << 64, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        keys, ends, left = ngram_join.keys_of(np.r_[a, b], np.r_[0, len(a), len(a) + len(b)])
        shared = np.intersect1d(keys[: ends[1]], keys[ends[1] :])
        kinds = np.bincount((shared & np.uint64(3)).astype(int), minlength=3)
        assert kinds[2] or (kinds[:2] > left.max(1)).any()


def test_parities_never_exceed_differences():
    rng = np.random.default_rng(12)
    for n in (1, 10, 300, 4000):
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        b = np.r_[a[n // 9 :], rng.integers(0, 1 << 64, n // 7, dtype=np.uint64)]
        w = ngram_join.parities(np.r_[a, b], np.r_[0, len(a), len(a) + len(b)]).view(np.uint64)
        assert np.bitwise_count(w[:, 0] ^ w[:, 1]).sum() <= len(np.setxor1d(a, b))


def test_differences_bound_every_pair():
    for most in (12, 40, 97, 300):
        assert ngram_join.most_apart(most) == most - 2 * ngram_join.needed(most, 0)
        assert ngram_join.differences(most) == max(a + b - 2 * ngram_join.needed(a, b) for a in range(1, most) for b in range(1, most - a + 1))


def test_sets_of_a_block():
    h, bounds = ngram_join.shingle_sets(pa.array([None, "a", "a b c", "a b c d", "A b c D e", "a a a a a a a", ""]))
    assert np.diff(bounds).tolist() == [0, 1, 1, 1, 2, 1, 0]
    assert len(np.intersect1d(h[bounds[3] : bounds[4]], h[bounds[4] : bounds[5]])) == 1
